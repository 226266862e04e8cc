"""Files with different headers: which columns each new file has, and reading them by name.

The first record of every file is taken from the file's first bytes; the rest of a file,
of any length, is not read for it. Only headers reach the driver: one entry per distinct header, with
the paths of its files (a micro-batch bounds their number). Files of one header are
read by one scan; scans of headers with the same names, in any order, are united by
name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import hadoop_path
from .raw import CSV_OPTIONS

HEADER_BYTES = 1 << 16   # a header record is no longer than this
UPLOAD_KEY = ("user_id", "dataset_id")
FILE_COL, PLACE_COL = "_file", "_mid"


def header_of(content: Column) -> Column:
    """Cells of the first CSV record of a file's bytes: fields may be quoted and hold
    commas, line breaks and doubled quotes; a byte order mark is left out."""
    text = F.make_valid_utf8(F.substring(content, 1, HEADER_BYTES).cast("string"))
    record = F.regexp_extract(text, '^﻿?((?:[^"\\r\\n]++|"(?:[^"]++|"")*+")*+)', 1)
    cells = F.regexp_extract_all(record, F.lit('(?:^|,)((?:"(?:[^"]++|"")*+")|[^,]*+)'), F.lit(1))
    plain = lambda c: F.when(c.startswith('"'), F.replace(
        F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(cells, lambda c: F.regexp_replace(plain(c), r"^\s+|\s+$", ""))


def _head(spark: SparkSession, path: str) -> bytearray:
    """A file's first record, or its first ``HEADER_BYTES`` if the record ends nowhere there."""
    fs, p = hadoop_path(spark, path)
    stream, content = fs.open(p), bytearray()
    try:
        for size in (HEADER_BYTES >> 4, HEADER_BYTES):
            content += stream.readNBytes(size - len(content))
            quoted = False
            for m in re.finditer(rb'["\r\n]', content):
                if m[0] == b'"':
                    quoted = not quoted
                elif not quoted:
                    return content[:m.end()]
    finally:
        stream.close()
    return content


def with_heads(files: DataFrame) -> DataFrame:
    """``files`` (path and the upload's key; a micro-batch bounds their number) with the
    first bytes of each as ``content``."""
    spark = files.sparkSession
    rows = files.select("path", *UPLOAD_KEY).collect()   # one small row per file of the batch
    return spark.createDataFrame([(*r, _head(spark, r["path"])) for r in rows],
                                 "path string, user_id bigint, dataset_id bigint, content binary")


def unique_names(header: list[str]) -> list[str]:
    """Names as one table needs them: a blank name is ``Unnamed: <place>``, a repeated one
    gets ``.1``, ``.2``, ..."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def header_groups(files: DataFrame) -> list[tuple[tuple[str, ...], dict]]:
    """Uploads by the set of their column names, given ``files`` (path, content and the
    upload's key): ``(names, {header: paths})`` for each set. An upload whose files differ
    has the names of all of them."""
    rows = (files.select("path", *UPLOAD_KEY, header_of(F.col("content")).alias("header"))
            .collect())   # one small row per file of the batch
    names: dict[tuple, set] = {}
    for r in rows:
        names.setdefault((r["user_id"], r["dataset_id"]), set()).update(unique_names(r["header"]))
    groups: dict[tuple, dict] = {}
    for r in sorted(rows, key=lambda r: r["path"]):
        own = groups.setdefault(tuple(sorted(names[r["user_id"], r["dataset_id"]])), {})
        own.setdefault(tuple(unique_names(r["header"])), []).append(r["path"])
    return sorted(groups.items())


def read_by_name(spark: SparkSession, names: tuple[str, ...], headers: dict, base: str) -> DataFrame:
    """The files of a group as text columns ``names``, with the upload's key (from the
    folder), the file and the place in it. Columns a file lacks are null."""
    out = None
    for header, paths in headers.items():
        schema = T.StructType([*(T.StructField(c, T.StringType()) for c in header),
                               *(T.StructField(c, T.LongType()) for c in UPLOAD_KEY)])
        part = spark.read.schema(schema).options(**CSV_OPTIONS).option("basePath", base).csv(paths)
        part = part.select(
            *[F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c) for c in names],
            *UPLOAD_KEY, F.col("_metadata.file_path").alias(FILE_COL),
            F.monotonically_increasing_id().alias(PLACE_COL))
        out = part if out is None else out.union(part)
    return out
