"""Raw uploads: CSV with unknown headers, landing-folder admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import ALLOWED_EXTENSIONS, MAX_UPLOAD_MB

# Text that reads as missing in a raw CSV (pandas defaults).
CSV_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


# Quoted fields may hold commas, line breaks and doubled quotes. A file with
# line breaks in fields is read by one task; admission bounds its size.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "inferSchema": False}


def missing_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing-value tokens of text columns as null."""
    columns = df.columns if columns is None else columns
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*CSV_NA_TOKENS), F.col(f"`{c}`")).alias(c)
                       if c in columns else F.col(f"`{c}`") for c in df.columns])


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text (type detection happens in cleaning), header
    row, missing-value tokens as null."""
    return missing_to_null(spark.read.options(**CSV_OPTIONS).csv(path))


READABLE_EXTENSIONS = [".csv"]   # of the allowed ones, those this library has a reader for


def refusal(path: str = "path", length: str = "length", max_mb: int = MAX_UPLOAD_MB) -> Column:
    """Why a file is refused; null if it is admitted."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return (F.when(~ext.isin(*ALLOWED_EXTENSIONS), F.lit("unsupported file type"))
            .when(~ext.isin(*READABLE_EXTENSIONS), F.concat(F.lit("no reader for "), ext, F.lit(" files")))
            .when(F.col(length) > F.lit(max_mb * 1024 * 1024),
                  F.format_string("file larger than %d MB", F.lit(max_mb))))


def landing_manifest(spark: SparkSession, folder: str, max_mb: int = MAX_UPLOAD_MB) -> DataFrame:
    """One row per file with its extension and whether it is admitted
    (allowed and readable type, size <= max_mb). Only file metadata is
    read: the ``content`` column is pruned."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
             .select("path", "length", "modificationTime"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", ext.alias("ext"), F.col("length").alias("bytes"),
                        refusal(max_mb=max_mb).isNull().alias("accepted"),
                        refusal(max_mb=max_mb).alias("reason"))
