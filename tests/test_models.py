"""Model-backed operators: row counts and basic properties."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SMALL
from tillsight.operators import segments as seg
from tillsight.plans.catalog import sales
from tillsight.sources.tables import Tables


def test_forecast_30_days_per_tenant(spark):
    df = E.queries()["forecast_30d"](spark, SMALL)
    rows = df.collect()
    tenants = {r["user_id"] for r in rows}
    assert len(rows) == 30 * len(tenants)
    assert all(r["predicted"] >= 0 for r in rows)


def test_fit_metrics_one_row_per_tenant(spark):
    df = E.queries()["forecast_fit_metrics"](spark, SMALL)
    assert df.count() == df.select("user_id").distinct().count() > 0


def test_training_status_reports_both_models_per_tenant(spark):
    rows = E.queries()["training_status"](spark, SMALL).collect()
    tenants = {r["user_id"] for r in E.queries()["rfm"](spark, SMALL).select("user_id").distinct().collect()}
    assert {r["status"] for r in rows} == {"success"}
    for model in ("forecast", "segmentation"):
        assert {r["user_id"] for r in rows if r["model"] == model} == tenants
    customers = {r["user_id"]: r["n"] for r in E.queries()["rfm"](spark, SMALL).groupBy("user_id")
                 .agg(F.count("*").alias("n")).collect()}
    for r in rows:
        if r["model"] == "segmentation":
            assert r["customer_count"] == customers[r["user_id"]]
            assert sum(json.loads(r["customers_by_segment"]).values()) == r["customer_count"]
            assert 1 <= r["clusters"] <= 4
        else:
            assert r["model_type"] == "gbt" and r["mae"] >= 0 and r["data_points"] > 0


def test_kmeans_stops_at_a_fixed_point(spark):
    """Every customer's centroid is the nearest, and centroids are the means."""
    scaled = seg.scale_rfm(seg.rfm(sales(Tables(spark, SMALL))))
    out, model = seg.kmeans_segments(scaled, tolerance=0.0)
    got = out.join(scaled, ["user_id", "customer_id"]).toPandas()
    cents = model.toPandas()
    for (user, cluster), rows in got.groupby(["user_id", "cluster"]):
        c = cents[(cents.user_id == user) & (cents.cluster == cluster)].iloc[0]
        for f in seg.FEATURES:
            assert abs(rows[f"{f}_z"].mean() - c[f"c_{f}"]) < 1e-9
    for r in got.itertuples():
        own = cents[cents.user_id == r.user_id]
        d = sum((own[f"c_{f}"] - getattr(r, f"{f}_z")) ** 2 for f in seg.FEATURES)
        assert d[own.cluster == r.cluster].iloc[0] <= d.min() + 1e-12


def test_kmeans_segments_cover_customers(spark):
    df = E.queries()["kmeans_clusters"](spark, SMALL)
    rfm = E.queries()["rfm"](spark, SMALL)
    assert df.count() == rfm.count()
    assert df.where(F.col("segment").isNull()).count() == 0


def _planted(seed, tenants=6):
    """Customers around four centres per tenant, of uneven sizes; one tenant of few, repeated points."""
    import numpy as np
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(tenants):
        centres = rng.normal(0, 4, (4, 3))
        points = np.concatenate([rng.normal(c, 0.6, (int(rng.integers(5, 80)), 3)) for c in centres])
        rows += [(u, f"c{i}", *map(float, x), float(x[2])) for i, x in enumerate(points)]
    rows += [(tenants, f"c{i}", float(i % 2), 0.0, 0.0, 1.0) for i in range(9)]
    return rows


def _best_of_ten(points, k):
    """Least inertia of ten runs from D-squared seeds."""
    import numpy as np
    best = np.inf
    for seed in range(10):
        rng = np.random.default_rng(seed)
        cents = [points[rng.integers(len(points))]]
        for _ in range(k - 1):
            d = np.min([((points - c) ** 2).sum(1) for c in cents], 0)
            cents.append(points[rng.choice(len(points), p=d / d.sum())])
        cents = np.array(cents)
        while True:
            near = ((points[:, None] - cents) ** 2).sum(2).argmin(1)
            new = np.array([points[near == i].mean(0) if (near == i).any() else cents[i] for i in range(k)])
            if ((new - cents) ** 2).sum() <= 1e-9:
                break
            cents = new
        best = min(best, ((points[:, None] - cents) ** 2).sum(2).min(1).sum())
    return best


def test_kmeans_is_as_good_as_the_best_of_ten_runs(spark):
    for seed in (3, 4):
        df = spark.createDataFrame(_planted(seed), "user_id long, customer_id string, recency_z double, "
                                                   "frequency_z double, monetary_z double, monetary double")
        out, model = seg.kmeans_segments(df)
        rows, cents = out.join(df, ["user_id", "customer_id"]).toPandas(), model.toPandas()
        for u in range(6):
            x = rows[rows.user_id == u][[f"{f}_z" for f in seg.FEATURES]].to_numpy()
            c = cents[cents.user_id == u][[f"c_{f}" for f in seg.FEATURES]].to_numpy()
            inertia = ((x[:, None] - c) ** 2).sum(2).min(1).sum()
            assert inertia <= 1.05 * _best_of_ten(x, 4)
        few = cents[cents.user_id == 6]
        assert sorted(few.c_recency) == [0.0, 1.0]   # two distinct points: two clusters


def test_kmeans_does_not_depend_on_partitioning_or_carried_state(spark, monkeypatch):
    df = spark.createDataFrame(_planted(5, 3), "user_id long, customer_id string, recency_z double, "
                                               "frequency_z double, monetary_z double, monetary double")
    rows = lambda d: sorted(map(tuple, seg.kmeans_segments(d)[0].collect()))
    want = rows(df)
    monkeypatch.setattr(seg, "SMALL_STATE", 2)   # state stored instead of carried
    assert rows(df.repartition(7)) == want
