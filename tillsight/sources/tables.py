"""Lazy access to the parquet tables of one scale-factor folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


class Tables:
    """``Tables(spark, dir).lineitem`` reads ``dir/lineitem.parquet`` lazily.

    A read is only a plan; Catalyst prunes columns and pushes filters into the
    parquet scan of whatever the caller selects.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        single = os.path.join(self.root, f"{name}.parquet")
        return single

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(self.path(name))
        return self._cache[name]
