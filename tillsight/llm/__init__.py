"""Operators of a training-data pipeline (dedup, filters, tokenisation, scoring)."""
