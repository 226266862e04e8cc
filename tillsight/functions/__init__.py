"""Scalar column helpers built on pyspark.sql.functions."""
from .columns import (as_double, ci_equals, currency, output_frame, parse_number,
                      parse_timestamp, pct_of, strip_ws, thousands)

__all__ = ["as_double", "ci_equals", "currency", "output_frame", "parse_number",
           "parse_timestamp", "pct_of", "strip_ws", "thousands"]
