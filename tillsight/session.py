"""Spark session and cluster-setting helpers."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import NullType


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app: str = "tillsight", extra: dict | None = None) -> SparkSession:
    """Session for tests and local runs.

    On a cluster, the submitter's session is used as is; this builder only
    sets what a local run lacks. The UI stays off (no server is started).
    """
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is used as is; a
    cluster session without it is refused, since executors could not read each
    other's files. Only a local master gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="tillsight-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediate tables, under the checkpoint
    folder (see :func:`ensure_checkpoint_dir`)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TABLE_OPTIONS = {"compression": "zstd"}   # stored tables


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Writes in this context delete their shuffle files when they end. Else these stay on the
    executors' disks until the driver's garbage collection meets the plan."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the checkpoint folder and read it: cuts
    lineage, survives lost executors and holds no executor memory."""
    path = scratch_path(df.sparkSession, name)
    void = {f.name for f in df.schema.fields if isinstance(f.dataType, NullType)}   # Parquet has no such type
    kept = df.drop(*void)
    with freed_shuffles(df.sparkSession):
        kept.write.options(**TABLE_OPTIONS).parquet(path)
    out = df.sparkSession.read.schema(kept.schema).parquet(path)
    if void:
        out = out.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns])
    out.stored_at = path
    return out


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return bool(fs.exists(p))


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all it holds; whether there was one."""
    fs, p = hadoop_path(spark, path)
    return bool(fs.exists(p) and fs.delete(p, True))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none where it does not exist."""
    fs, p = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def discard(df: DataFrame) -> None:
    """Delete a stored table that no later plan reads."""
    delete_path(df.sparkSession, df.stored_at)
