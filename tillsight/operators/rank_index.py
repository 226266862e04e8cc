"""Rank index of a ledger: a stored copy in sort order, for pages at any depth.

Building sorts once: the rows are range-partitioned by (tenant, sort key) and written as
one file per range, beside a small table with each range's rows per tenant and the
position of its first row in the tenant's ledger. A page then opens the ranges that hold
its rows (one or two per tenant) and sorts these only, whatever its depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..schema import LEDGER_PAGE_SIZE
from .ledger import sort_key

RANGE_ROWS = 1_000_000   # rows of one range (a file)


@dataclass
class RankIndex:
    rows: DataFrame       # the ledger and ``_range``
    ranges: DataFrame     # tenant, _range, n (rows), before (rows of earlier ranges), total
    column: str
    ascending: bool
    by: tuple


def build_rank_index(df: DataFrame, column: str, path: str, ascending: bool = True, by=("user_id",),
                     range_rows: int = RANGE_ROWS, ranges: int | None = None) -> RankIndex:
    """Write the index of a ledger sorted by ``column`` under ``path``."""
    spark, by = df.sparkSession, tuple(by)
    order = [*[F.col(b).asc() for b in by], *sort_key(df, column, ascending)]
    n = ranges or max(1, -(-df.count() // range_rows))
    (df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
     .write.partitionBy("_range").parquet(f"{path}/rows"))
    rows = spark.read.schema(df.withColumn("_range", F.lit(0)).schema).parquet(f"{path}/rows")
    # ranges follow the order of (tenant, key), so earlier ranges hold earlier rows
    counts = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy(*by)   # a tenant's ranges: its rows / range_rows
    earlier = of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    (counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
     .withColumn("total", F.sum("n").over(of)).coalesce(1).write.parquet(f"{path}/ranges"))
    return open_rank_index(spark, path, column, ascending, by)


def open_rank_index(spark: SparkSession, path: str, column: str, ascending: bool = True,
                    by=("user_id",)) -> RankIndex:
    return RankIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/ranges"), column, ascending,
                     tuple(by))


def indexed_page(index: RankIndex, page: int = 1, page_size: int = LEDGER_PAGE_SIZE,
                 tenant: DataFrame | None = None) -> DataFrame:
    """Page ``page`` of every tenant's ledger (or of the tenants given), with ``pos`` and
    the ``x to y of n`` caption; a page past the end shows the last page. Only the ranges
    that hold rows of the pages are read: their numbers become a partition filter."""
    by = list(index.by)
    ranges = index.ranges if tenant is None else index.ranges.join(F.broadcast(tenant.select(*by)), by, "left_semi")
    last = F.greatest(F.ceil(F.col("total") / F.lit(page_size)), F.lit(1))
    current = F.least(F.lit(page), last)
    wanted = (ranges.withColumn("lo", (current - 1) * page_size + 1).withColumn("hi", current * page_size)
              .where((F.col("before") < F.col("hi")) & (F.col("before") + F.col("n") >= F.col("lo"))))
    numbers = sorted(r["_range"] for r in wanted.select("_range").distinct().collect())   # two per tenant at most
    rows = index.rows.where(F.col("_range").isin(numbers))
    data = rows.drop("_range")
    rank = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(
        *sort_key(data, index.column, index.ascending)))   # within one range
    held = (rows.withColumn("_r", rank).join(F.broadcast(wanted), [*by, "_range"])
            .withColumn("pos", (F.col("before") + F.col("_r")).cast("bigint"))
            .where((F.col("pos") >= F.col("lo")) & (F.col("pos") <= F.col("hi"))))
    caption = F.format_string("%d to %d of %d", F.col("lo"), F.least("hi", "total"), F.col("total"))
    return held.select(*[F.col(c) for c in data.columns], "pos", caption.alias("caption"))
