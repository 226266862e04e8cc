"""Writers: cleaned/processed copies, partitioned sales table, exports."""
