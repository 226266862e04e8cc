"""Upload ETL: clean -> map -> impute -> canonical sales rows.

One lazy plan; the actions are the statistics passes inside cleaning
(numeric detection, means/modes/quartiles) and the writes. The row count
comes from an ``Observation`` on the final write, not from a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..operators.clean import ORDER_COL, CleaningProfile, clean_upload
from ..operators.impute import canonicalise, impute_fields
from ..operators.ledger import positions_by, with_positions
from ..operators.mapping import map_columns
from ..sources.headers import FILE_COL, PLACE_COL, UPLOAD_KEY


def with_row_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """Attach ``_row``: the dense 1-based position of each row in ``order``
    (the upload's row order; computed without a single-partition window)."""
    return with_positions(df, order, name=ORDER_COL)


def file_order(df: DataFrame) -> DataFrame:
    """Row order of a file read: file name, then position within the file
    (partitions of one file come in split order)."""
    tagged = (df.withColumn("_file", F.input_file_name())
              .withColumn("_mid", F.monotonically_increasing_id()))
    return with_row_order(tagged, [F.col("_file"), F.col("_mid")]).drop("_file", "_mid")


def transform_upload(raw: DataFrame, user_id: int | None, dataset_id: int | None, now: str,
                     exact_quantiles: bool = True, by=(), profile: CleaningProfile | None = None
                     ) -> tuple[DataFrame, DataFrame, dict]:
    """Returns (cleaned, canonical, mapping) for a raw upload that carries
    ``_row``; with ``by=UPLOAD_KEY``, for many uploads of one header at once
    (types and statistics per upload)."""
    cleaned, _ = clean_upload(raw, ORDER_COL, by, exact_quantiles=exact_quantiles, profile=profile)
    mapped, mapping = map_columns(cleaned, keep=(ORDER_COL, *by))
    present = {k for k, v in mapping.items() if v}
    canonical = canonicalise(impute_fields(mapped, present, now, by=by, profile=profile), user_id, dataset_id)
    return cleaned, canonical, mapping


def upload_order(df: DataFrame, by=UPLOAD_KEY) -> DataFrame:
    """``_row``: position of each row within its upload (file, then place in it; frames
    read by :func:`..sources.headers.read_by_name` carry both)."""
    if FILE_COL not in df.columns:
        df = (df.withColumn(FILE_COL, F.input_file_name())
              .withColumn(PLACE_COL, F.monotonically_increasing_id()))
    return positions_by(df, list(by), [F.col(FILE_COL), F.col(PLACE_COL)], ORDER_COL).drop(
        FILE_COL, PLACE_COL, "_n")


def run_etl(raw: DataFrame, user_id: int, dataset_id: int, now: str, table_dir: str,
            cleaned_dir: str | None = None, processed_dir: str | None = None,
            fmt: str = "parquet") -> DataFrame:
    """Whole upload flow. Writes the cleaned and processed copies (when
    folders are given) and loads the canonical rows into the sales table
    (replacing only this dataset's partition). Returns a one-row status."""
    from ..sinks.writers import load_sales, write_copy

    cleaned, canonical, _ = transform_upload(raw, user_id, dataset_id, now)
    if cleaned_dir:
        write_copy(cleaned.drop(ORDER_COL), cleaned_dir, fmt)
    if processed_dir:
        write_copy(canonical, processed_dir, fmt)
    obs = Observation("etl")
    spark = raw.sparkSession
    if processed_dir and fmt == "parquet":
        canonical = spark.read.schema(canonical.schema).parquet(processed_dir)   # made once
    # one upload is one partition: no shuffle brings its rows nearer
    load_sales(canonical.observe(obs, F.count(F.lit(1)).alias("rows")), table_dir, gather=False)
    rows = obs.get["rows"]
    return spark.createDataFrame(
        [("processed", int(rows), cleaned_dir, processed_dir)],
        "status string, row_count bigint, cleaned_path string, processed_path string")
