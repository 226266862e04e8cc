"""Exact quantiles in two scans, without sorting or collecting a group.

The first scan takes a sketch per group (``percentile_approx``) and from it a
narrow bracket of values around each wanted rank. The second counts the values
below the bracket and, value by value, those inside it; both are aggregates that
Spark reduces on the map side, so a hot group or a much repeated value costs one
row per task. Only the distinct values inside a bracket (about 0.04 % of the
ranks) are put in order. The result uses linear interpolation
``lo + (hi - lo) * d``, the same rule as SQL ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

ACCURACY = 10_000           # the sketch's rank error is at most n / ACCURACY
MARGIN = 2.0 / ACCURACY     # half width of a bracket, in ranks / n


def exact_quantiles(df: DataFrame, value: str, qs: list[float], by=(), prefix: str = "q") -> DataFrame:
    """One row per group with columns ``{prefix}0, {prefix}1, ...`` (one per
    quantile in ``qs``) and ``n``; groups without values are absent."""
    by = list(by)
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = [p for q in qs for p in (max(0.0, q - MARGIN), min(1.0, q + MARGIN))]
    sketch = v.groupBy(*by).agg(
        F.count("_v").alias("n"),
        F.percentile_approx("_v", F.array(*[F.lit(p) for p in ends]), F.lit(ACCURACY)).alias("_ends"))
    brackets = [F.struct(F.lit(i).alias("i"), F.col("_ends")[2 * i].alias("lo"),
                         F.col("_ends")[2 * i + 1].alias("hi")) for i in range(len(qs))]
    sketch = sketch.select(*by, "n", F.array(*brackets).alias("_b"))   # one row per group
    # broadcast by hint: a few groups would fill a few partitions of a shuffle, with all rows in their tasks
    j = v.join(F.broadcast(sketch), by) if by else v.crossJoin(F.broadcast(sketch))
    x = j.select(*by, "n", "_v", F.explode("_b").alias("_b")).select(*by, "n", "_v", "_b.i", "_b.lo", "_b.hi")
    # below and above: one row each, with the value next to the bracket; inside: one row per value
    place = F.when(F.col("_v") < F.col("lo"), 0).when(F.col("_v") <= F.col("hi"), 1).otherwise(2)
    counts = (x.groupBy(*by, "n", "i", place.alias("_place"), F.when(place == 1, F.col("_v")).alias("_at"))
              .agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_v"), F.max("_v").alias("_top")))
    w = Window.partitionBy(*by, "i").orderBy("_place", "_v")
    ranked = counts.withColumn("_end", F.sum("_k").over(w)).withColumn("_start", F.col("_end") - F.col("_k"))
    q = F.element_at(F.array(*[F.lit(float(p)) for p in qs]), F.col("i") + 1)
    h = (F.col("n") - 1) * q
    low, high = F.floor(h) + 1, F.ceil(h) + 1
    # in few values, a rank may lie one step outside of its bracket
    value = lambda r: (F.when((F.col("_place") == 0) & (r == F.col("_end")), F.col("_top"))
                       .when((F.col("_place") == 1) & (F.col("_start") < r) & (r <= F.col("_end")), F.col("_v"))
                       .when((F.col("_place") == 2) & (r == F.col("_start") + 1), F.col("_v")))
    at = ranked.groupBy(*by, "n", "i").agg(
        F.max(value(low)).alias("lo"), F.max(value(high)).alias("hi"), F.first(h - F.floor(h)).alias("d"))
    value_at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("d")
    out = at.groupBy(*by, "n").agg(*[F.max(F.when(F.col("i") == i, value_at)).alias(f"{prefix}{i}")
                                     for i in range(len(qs))])
    return out.select(*by, "n", *[f"{prefix}{i}" for i in range(len(qs))])
