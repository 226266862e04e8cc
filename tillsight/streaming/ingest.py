"""Upload ingest as a stream (optional form of the upload flow).

The landing folder holds one folder per upload,
``user_id=<tenant>/dataset_id=<upload>/``, with any number of CSV files; a folder is
moved into place when it is complete. Files may have any header, with columns in any
order: a micro-batch reads the headers of its uploads' files, groups the uploads by their
column names, and cleans and loads all uploads of a group by the same few jobs. Types,
statistics and row order are per upload, and the tenant comes from the folder.

A micro-batch holds a bounded number of files, so it may hold some of an upload's only.
The first one that meets an upload takes the files of its whole folder; that these were
settled is kept under the checkpoint folder, and later batches with the others go past them.

With an upload log, every upload's states are recorded. An upload with a file that is
not admitted (type, size) is refused as a whole; a group that cannot be processed
fails, and the other groups go on.

``trigger(availableNow=True)`` processes what is there and stops; progress is kept in
the checkpoint folder, so a restarted job resumes after the last committed batch.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.etl import transform_upload, upload_order
from ..session import path_exists
from ..sinks import uploads as log
from ..sinks.writers import load_sales
from ..sources.headers import UPLOAD_KEY, header_groups, read_by_name, with_heads
from ..sources.raw import missing_to_null, refusal

FILES_PER_BATCH = 1000
FILE_SCHEMA = ("path string, modificationTime timestamp, length bigint, content binary, "
               "user_id bigint, dataset_id bigint")
SETTLED_SCHEMA = "user_id bigint, dataset_id bigint, files bigint, mark bigint, batch bigint"


def _whole_uploads(spark: SparkSession, landing_dir: str, keys: list) -> DataFrame:
    """All files in the folders of some uploads: path, length, the upload's key and why
    the file is refused (contents are not read)."""
    folders = [f"{landing_dir}/user_id={u}/dataset_id={d}" for u, d in keys]
    return (spark.read.format("binaryFile").schema(FILE_SCHEMA).option("basePath", landing_dir).load(folders)
            .select("path", "length", "modificationTime", *UPLOAD_KEY, refusal().alias("reason")))


def _uploads_of(files: DataFrame) -> DataFrame:
    """One row per upload: why it is refused, its number of files and a mark of their names,
    sizes and times."""
    return files.groupBy(*UPLOAD_KEY).agg(
        F.min("reason").alias("reason"), F.count(F.lit(1)).alias("files"),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("mark"))


def _unsettled(spark: SparkSession, uploads: DataFrame, settled_dir: str) -> DataFrame:
    """Uploads whose folder does not hold the same files as when it was last settled."""
    if not path_exists(spark, settled_dir):
        return uploads
    last = (spark.read.schema(SETTLED_SCHEMA).parquet(settled_dir)
            .groupBy(*UPLOAD_KEY).agg(F.max_by(F.struct("files", "mark"), "batch").alias("_last")))
    known = last.select(*UPLOAD_KEY, "_last.files", "_last.mark")
    return uploads.join(known, [*UPLOAD_KEY, "files", "mark"], "left_anti")


def _finish(spark, log_dir, keys, table_dir, when) -> None:
    """``processed`` with the rows that were loaded, for some uploads at once."""
    from ..sinks.writers import read_sales
    wanted = log.events_of(spark, keys, "processed", when).drop("row_count")
    rows = (read_sales(spark, table_dir).join(F.broadcast(wanted.select(*UPLOAD_KEY)), list(UPLOAD_KEY))
            .groupBy(*UPLOAD_KEY).agg(F.count(F.lit(1)).alias("row_count")))   # keys: one batch's uploads
    log.record(wanted.join(rows, list(UPLOAD_KEY), "left")
               .withColumn("row_count", F.coalesce("row_count", F.lit(0))), log_dir)


def ingest_landing(spark: SparkSession, landing_dir: str, table_dir: str, checkpoint: str, now: str,
                   log_dir: str | None = None, files_per_batch: int = FILES_PER_BATCH):
    """Start the stream and return the query handle (call
    ``awaitTermination()`` on it)."""
    when = dt.datetime.fromisoformat(now)
    landing_dir = landing_dir.rstrip("/")
    settled_dir = f"{checkpoint.rstrip('/')}/uploads"
    stream = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
              .option("maxFilesPerTrigger", files_per_batch).load(landing_dir)
              .select(*UPLOAD_KEY))   # a batch holds what it selects: no file's content

    def note(keys, status, **values):
        if log_dir and keys:
            log.move(spark, log_dir, [(u, d, f"upload_{d}") for u, d in keys], status, when, **values)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        keys = sorted(tuple(r) for r in batch.distinct().collect())   # one row per upload of the batch
        if not keys:
            return
        files = _whole_uploads(spark, landing_dir, keys)
        found = _unsettled(spark, _uploads_of(files), settled_dir).collect()
        if not found:
            return
        load(files, found)
        spark.createDataFrame([(r["user_id"], r["dataset_id"], r["files"], r["mark"], batch_id) for r in found],
                              SETTLED_SCHEMA).coalesce(1).write.mode("append").parquet(settled_dir)

    def load(files: DataFrame, found: list) -> None:
        good = [(r["user_id"], r["dataset_id"]) for r in found if r["reason"] is None]
        if log_dir:
            events = log.events_of(spark, [(r["user_id"], r["dataset_id"], f"upload_{r['dataset_id']}")
                                           for r in found], "uploaded", when)
            log.record(events, log_dir)   # an upload sent again is known already
        for reason in sorted({r["reason"] for r in found if r["reason"]}):
            note([(r["user_id"], r["dataset_id"]) for r in found if r["reason"] == reason], "failed", error=reason)
        if not good:
            return
        chosen = spark.createDataFrame(good, "user_id bigint, dataset_id bigint")
        groups = header_groups(with_heads(files.join(F.broadcast(chosen), list(UPLOAD_KEY))))
        for names, headers in groups:
            keys = sorted({key for paths in headers.values() for key in map(_key_of, paths)})
            note(keys, "processing")
            try:
                raw = missing_to_null(upload_order(read_by_name(spark, names, headers, landing_dir)), list(names))
                _, canonical, _ = transform_upload(raw, None, None, now, by=UPLOAD_KEY)
                load_sales(canonical, table_dir)
            except Exception as e:   # recorded: the other groups' uploads go on
                if not log_dir:
                    raise
                note(keys, "failed", error=f"{type(e).__name__}: {e}")
                continue
            if log_dir:
                _finish(spark, log_dir, [(u, d, f"upload_{d}") for u, d in keys], table_dir, when)

    return (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _key_of(path: str) -> tuple[int, int]:
    """The upload's key from the folders of a path."""
    parts = dict(p.split("=", 1) for p in path.split("/") if "=" in p)
    return int(parts["user_id"]), int(parts["dataset_id"])
