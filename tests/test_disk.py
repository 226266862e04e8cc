"""What stays on the executors' disks: shuffles of whole tables, and files nobody reads."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tillsight.operators import ledger
from tillsight.operators import segments as seg
from tillsight.plans import catalog, etl, partials
from tillsight.session import freed_shuffles, stored
from tillsight.sinks import writers
from tillsight.sources.tables import Tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _points(spark):
    x = F.pmod(F.col("id") * 7919, F.lit(101)) / 10.0
    return spark.range(600).select(
        (F.col("id") % 3).alias("user_id"), F.format_string("c%d", "id").alias("customer_id"),
        x.alias("recency_z"), (x * x / 10).alias("frequency_z"), F.sqrt(x).alias("monetary_z"),
        (x * 3).alias("monetary"))


def test_kmeans_state_is_broadcast_to_the_points(spark):
    """A step joins a few centroids to all customers: these are not shuffled for it."""
    points = _points(spark)
    plan = _plan(points.join(seg.seed_centroids(points, 4, 2, 42), ["user_id"]))
    assert "BroadcastHashJoin" in plan and "hashpartitioning(user_id" not in plan


def test_writes_free_their_shuffles(spark, tmp_path):
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    before = _shuffle_files(spark)
    table = stored(sums, "sums")
    assert _shuffle_files(spark) <= before
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, sums.collect()))
    with pytest.raises(Exception), freed_shuffles(spark):
        spark.read.parquet(str(tmp_path / "none"))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_stored_tables_keep_columns_without_a_type(spark):
    out = stored(spark.range(3).select("id", F.lit(None).alias("none"), F.lit("x").alias("a b")), "void")
    assert out.columns == ["id", "none", "a b"] and sorted(map(tuple, out.collect())) == [
        (i, None, "x") for i in range(3)]


def test_positions_are_read_from_a_stored_table(spark):
    """No second copy of the sorted rows in executor memory, none as uncompressed objects."""
    rows = [(i * 37 % 100, str(i)) for i in range(100)] + [(5, "5b"), (None, None)]
    df = spark.createDataFrame(rows, "k int, v string")
    order = [F.col("k").asc_nulls_first(), F.col("v").asc_nulls_first()]
    out = ledger.with_positions(df.repartition(7), order)
    assert "FileScan parquet" in _plan(out) and "ExistingRDD" not in _plan(out)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [(r["k"], r["v"]) for r in sorted(out.collect(), key=lambda r: r["pos"])] == want


def test_customers_are_reduced_once(spark):
    """Statistics and quartiles read the stored customers, not the sales rows again."""
    s = catalog.sales(Tables(spark, SMALL))
    plan = _plan(seg.rule_segments(seg.rfm(s)))
    assert "total_sales" not in plan and "last_date" in plan


def test_sales_are_written_without_a_last_shuffle(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(writers, "load_sales", lambda df, path, gather=True: seen.append((_plan(df), gather)) or (
        df.limit(0).write.parquet(path)))
    monkeypatch.setattr(writers, "read_sales", lambda spark, path: spark.read.parquet(path))
    monkeypatch.setattr(catalog, "_DERIVED", {})
    catalog.sales(Tables(spark, SMALL))
    assert len(seen) == 1 and not seen[0][1] and "REBALANCE" not in seen[0][0]


def test_partial_sums_of_gathered_rows_are_written_where_they_are(spark, tmp_path, monkeypatch):
    s = catalog.sales(Tables(spark, SMALL)).where("user_id < 2")
    partials.load_with_partials(s, str(tmp_path / "a"), str(tmp_path / "pa"))
    hints, hint = [], type(s).hint
    monkeypatch.setattr(type(s), "hint", lambda self, *a: hints.append(a) or hint(self, *a))
    partials.load_with_partials(s, str(tmp_path / "b"), str(tmp_path / "pb"), gather=False)
    assert not hints
    a, b = (partials.read_partials(spark, str(tmp_path / p)) for p in ("pa", "pb"))
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_loaded_rows_are_those_of_the_processed_copy(spark, tmp_path):
    """The copy is made once and loaded, not computed a second time."""
    rows = [(i, "2024-01-0%d" % (i % 9 + 1), f"P{i % 4}", str(i * 2)) for i in range(1, 40)]
    raw = spark.createDataFrame(rows, "_row bigint, `Order Date` string, Product string, Sales string")
    out = etl.run_etl(raw, 1, 2, "2024-01-01 00:00:00", str(tmp_path / "sales"), None, str(tmp_path / "processed"))
    loaded = writers.read_sales(spark, str(tmp_path / "sales"))
    copy = spark.read.parquet(str(tmp_path / "processed")).select(*loaded.columns)
    assert out.first()["row_count"] == 39 == loaded.count()
    assert loaded.exceptAll(copy).isEmpty()
