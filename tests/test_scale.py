"""Steps that must not put all rows in a few tasks, or read or move more than they need."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tillsight.operators import segments as seg
from tillsight.operators.quantiles import exact_quantiles
from tillsight.sources.fixtures import dirty_from_star, sales_from_star
from tillsight.sources.headers import HEADER_BYTES, header_groups, with_heads
from tillsight.sources.tables import Tables


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture
def no_small_joins(spark):
    """As a join of shuffled frames is planned, whatever their size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_are_not_shuffled_by_tenant_for_statistics(spark, no_small_joins):
    df = spark.range(100).select((F.col("id") % 2).alias("user_id"), F.col("id").cast("double").alias("x"))
    q = exact_quantiles(df, "x", [0.25, 0.75], ["user_id"])
    assert "SortMergeJoin" not in plan(q)
    assert sorted(map(tuple, q.collect())) == [(0, 50, 24.5, 73.5), (1, 50, 25.5, 74.5)]
    r = df.select("user_id", F.col("x").cast("string").alias("customer_id"), F.col("x").cast("bigint").alias("recency"),
                  F.lit(1).cast("bigint").alias("frequency"), F.col("x").alias("monetary"))
    assert "SortMergeJoin" not in plan(seg.scale_rfm(r)) and "SortMergeJoin" not in plan(seg.rule_segments(r))


def test_gathered_sales_are_the_same_rows(spark):
    t = Tables(spark, SMALL)
    plain, gathered = sales_from_star(t), sales_from_star(t, gather=True)
    assert plain.schema == gathered.schema
    assert plain.exceptAll(gathered).isEmpty() and gathered.exceptAll(plain).isEmpty()


def test_the_damaged_upload_joins_its_tables_once(spark):
    d = dirty_from_star(Tables(spark, SMALL))
    scans = [x for x in plan(d).splitlines() if "ReadSchema" in x and "l_orderkey" in x]
    assert len(scans) == 1


def test_draws_do_not_depend_on_the_last_bits_of_features(spark):
    rows = [(0, f"c{i}", (i * 7919 % 101) / 13, (i * 104729 % 97) / 11, (i * 1299709 % 89) / 7) for i in range(300)]
    schema = "user_id long, customer_id string, recency_z double, frequency_z double, monetary_z double"
    found = []
    for noise in (0.0, 1e-13):
        pts = spark.createDataFrame([(u, c, *(x + noise for x in xs)) for u, c, *xs in rows], schema)
        cents = seg.seed_centroids(pts, 4, 4, 42).collect()
        found.append({r.run: [tuple(round(x, 6) for x in c) for c in r.cents] for r in cents})
    assert found[0] == found[1] and all(len(c) == 4 for c in found[0].values())


def test_headers_come_from_the_first_record_only(spark, tmp_path):
    record = b'a,"b ""c""\r\nd",e\r\n'
    folder = tmp_path / "user_id=1" / "dataset_id=2"
    folder.mkdir(parents=True)
    (folder / "x.csv").write_bytes(record + b"1,2,3\n" * HEADER_BYTES)
    (folder / "y.csv").write_bytes(b"a" * (2 * HEADER_BYTES))
    files = spark.createDataFrame([(f"file:{folder}/{n}", 1, 2) for n in ("x.csv", "y.csv")],
                                  "path string, user_id long, dataset_id long")
    heads = with_heads(files)
    got = {r.path[-5:]: bytes(r.content) for r in heads.collect()}
    assert got == {"x.csv": record[:-1], "y.csv": b"a" * HEADER_BYTES}
    assert ("a", 'b "c"\r\nd', "e") in header_groups(heads.where("path LIKE '%x.csv'"))[0][1]


def test_customers_without_a_feature_are_in_a_cluster(spark):
    rows = [(u, f"c{i}", i / 7, (i % 5) / 3, None if i % 10 == 3 else i / 2, float(i)) for u in (0, 1) for i in range(40)]
    rows += [(2, "few", 0.0, 0.0, 0.0, 1.0), (2, "two", 1.0, 1.0, None, None)]
    pts = spark.createDataFrame(rows, "user_id long, customer_id string, recency_z double, frequency_z double, "
                                      "monetary_z double, monetary double")
    out, _ = seg.kmeans_segments(pts)
    assert out.count() == len(rows) and out.where("cluster IS NULL").isEmpty()
