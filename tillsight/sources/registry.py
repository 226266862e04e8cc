"""Dataset registry views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def list_datasets(registry: DataFrame, user_id: int) -> DataFrame:
    """A tenant's datasets, newest first."""
    return (registry.where(F.col("user_id") == user_id)
            .orderBy(F.desc("uploaded_at"), F.desc("id")))
