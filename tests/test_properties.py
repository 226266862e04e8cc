"""Property tests on generated frames (few examples: each runs Spark jobs)."""

import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillsight.operators import clean as cl
from tillsight.operators import metrics as m
from tests.test_edge_rules import sales_frame

SETTINGS = settings(max_examples=6, deadline=None)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", None])), min_size=1, max_size=30))
def test_dedup_idempotent(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "_row long, a int, b string")
    once = cl.drop_exact_duplicates(df)
    twice = cl.drop_exact_duplicates(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.count() == len(set(rows))


@SETTINGS
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=4, max_size=40))
def test_capped_values_within_fences(spark, xs):
    import numpy as np
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "_row long, v double")
    out = [r["v"] for r in cl.cap_outliers(df, ["v"]).collect()]
    q1, q3 = np.percentile(xs, [25, 75])
    iqr = q3 - q1
    if iqr > 0:
        assert min(out) >= q1 - 1.5 * iqr - 1e-6 and max(out) <= q3 + 1.5 * iqr + 1e-6
    else:
        assert sorted(out) == sorted(xs)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["x", "y", "z"]), st.integers(1, 10_000),
                          st.integers(0, 700)), min_size=1, max_size=25))
def test_shares_and_period_sums_agree(spark, rows):
    s = sales_frame(spark, [{"category": c, "total_sales": v / 100.0,
                             "date": dt.datetime(2023, 1, 1) + dt.timedelta(days=d)} for c, v, d in rows])
    shares = [r["percentage"] for r in m.category_distribution(s).collect()]
    assert abs(sum(shares) - 100.0) < 0.05 * len(shares)
    total = sum(v for _, v, _ in rows) / 100.0
    daily = sum(r["value"] for r in m.sales_trend(s, "daily").collect())
    monthly = sum(r["value"] for r in m.sales_trend(s, "monthly").collect())
    assert abs(daily - total) < 1e-6 and abs(monthly - total) < 1e-6


def test_exact_quantiles_with_a_hot_repeated_value(spark):
    """A third of the rows share one group and one value; the quartiles
    still equal linear-interpolation quartiles (numpy's default)."""
    import numpy as np
    from tillsight.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(7)
    rows = [(0, 5.0)] * 3000 + [(0, float(x)) for x in rng.integers(0, 50, 2000)] + \
           [(g, float(x)) for g in (1, 2) for x in rng.integers(0, 1000, 2000)]
    df = spark.createDataFrame(rows, "g long, x double").repartition(8)
    got = {r["g"]: (r["q0"], r["q1"], r["n"]) for r in
           exact_quantiles(df, "x", [0.25, 0.75], ["g"]).collect()}
    for g in (0, 1, 2):
        xs = np.array([x for k, x in rows if k == g])
        q1, q3 = np.percentile(xs, [25, 75])
        assert got[g][2] == len(xs)
        assert abs(got[g][0] - q1) < 1e-9 and abs(got[g][1] - q3) < 1e-9
