"""Sinks. Every write is a distributed write of a lazy plan; the sales table
is partitioned by ``user_id, dataset_id`` so that loading an upload replaces
only its own partition (dynamic partition overwrite) and tenant filters
prune partitions at read time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import output_frame
from ..operators.filters import apply_filters
from ..schema import ANALYTICS_COLUMNS, MAX_UPLOAD_MB, SALES_COLUMNS
from ..session import TABLE_OPTIONS, freed_shuffles

# A quote inside a quoted field is doubled, as readers of plain CSV expect.
CSV_OPTIONS = {"header": True, "escape": '"'}
PARTITION_COLUMNS = ["user_id", "dataset_id"]


def write_copy(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1/K2: cleaned or processed copy of an upload (one folder per file)."""
    options = TABLE_OPTIONS
    if fmt == "csv":
        df, options = output_frame(df), CSV_OPTIONS
    with freed_shuffles(df.sparkSession):
        df.write.mode("overwrite").format(fmt).options(**(options if fmt in ("csv", "parquet") else {})).save(path)


def _csv_bytes(df: DataFrame) -> Column:
    """The most bytes a row takes as a CSV record: every field quoted, quotes doubled."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    return sum((F.octet_length(t) + F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit(""))) + 3 for t in texts),
               F.lit(0)).cast("bigint")


def land_uploads(df: DataFrame, landing_dir: str, max_bytes: int = MAX_UPLOAD_MB * 1024 * 1024) -> None:
    """Add the uploads in ``df`` to a landing folder as CSV (a folder per upload). An upload
    has as many files as it takes for each to pass admission: the widest row, found by one
    aggregate, bounds the rows of a file (a single wider row is left to admission)."""
    cells = df.drop(*PARTITION_COLUMNS)
    widest = cells.agg(F.max(_csv_bytes(cells))).first()[0] or 1
    header = sum(2 * len(c.encode()) + 3 for c in cells.columns)
    with freed_shuffles(df.sparkSession):
        (df.hint("rebalance", *PARTITION_COLUMNS).write.mode("append").options(**CSV_OPTIONS)
         .option("maxRecordsPerFile", max(1, (max_bytes - header) // widest))
         .partitionBy(*PARTITION_COLUMNS).csv(landing_dir))


def load_sales(df: DataFrame, table_dir: str, gather: bool = True) -> None:
    """K3: replace the rows of the written (user, dataset) partitions only.

    The ``rebalance`` hint lets AQE size the write tasks per partition
    value: small partitions are merged into one file, a hot tenant's
    partition is split over several tasks instead of one. It shuffles every row once;
    with ``gather=False`` tasks write the rows where they are, up to one file per task and
    partition. That suits rows that lie together already, such as those read from a table."""
    rows = df.select(*SALES_COLUMNS)
    if gather:
        rows = rows.hint("rebalance", *PARTITION_COLUMNS)
    with freed_shuffles(df.sparkSession):
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**TABLE_OPTIONS)
         .partitionBy(*PARTITION_COLUMNS).parquet(table_dir))


def read_sales(spark: SparkSession, table_dir: str, schema=None) -> DataFrame:
    """The sales table with its stored column types (partition values are
    read as bigint, not inferred) in canonical column order."""
    if schema is None:
        first = spark.read.parquet(table_dir)
        fields = [f for f in first.schema.fields if f.name not in PARTITION_COLUMNS]
        from pyspark.sql import types as T
        schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in PARTITION_COLUMNS])
    return spark.read.schema(schema).parquet(table_dir).select(*SALES_COLUMNS)


def export_csv(sales: DataFrame, user_id: int, path: str, single_file: bool = False) -> None:
    """K5: a tenant's 14 analytics columns as CSV with header; an error when
    the tenant has no rows (checked with a one-row probe)."""
    t = sales.where(F.col("user_id") == user_id).select(*ANALYTICS_COLUMNS)
    if not t.take(1):
        raise ValueError("No sales data available to export.")
    out = output_frame(t)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def export_csv_all(sales: DataFrame, path: str) -> None:
    """K5 for all tenants in one job: ``path/user_id=<id>/`` per tenant
    (a tenant without rows simply has no folder)."""
    out = output_frame(sales.select("user_id", *ANALYTICS_COLUMNS))
    with freed_shuffles(out.sparkSession):
        out.write.mode("overwrite").options(**CSV_OPTIONS).partitionBy("user_id").csv(path)


def export_filtered_csv(df: DataFrame, filters: dict, path: str) -> None:
    """K6: the filtered ledger with every field quoted and nulls as ''."""
    out = output_frame(apply_filters(df, filters))
    out = out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns])
    out.write.mode("overwrite").options(**CSV_OPTIONS).option("quoteAll", True).csv(path)
