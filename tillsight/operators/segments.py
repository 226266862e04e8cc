"""Customer segmentation: RFM, scaling, rule segments, batch k-means.

RFM reduces line items to one row per (tenant, customer) with a map-side
combined aggregate. Tenant-level statistics (reference date, means,
standard deviations, quartiles) are one row per tenant, broadcast by hint to
the customers: a shuffle on a few tenants would put all rows in a few tasks. K-means runs for all tenants together: a step attaches the
tenant's (at most k) centroids as one array, picks the nearest in a projection
and takes one aggregate, until no tenant's centroids move.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_double
from ..schema import (DEFAULT_SEGMENT, RULE_AT_RISK_RECENCY, RULE_LOYAL_FREQUENCY, RULE_Q25_SINGLE,
                      RULE_Q75_SINGLE, SEGMENT_NAMES)
from ..session import discard, stored
from .quantiles import exact_quantiles

TENANT = ("user_id",)
FEATURES = ["recency", "frequency", "monetary"]


def rfm(sales: DataFrame, by=TENANT, customer: str = "customer_id") -> DataFrame:
    """G1: recency (whole days from the customer's last purchase to the
    tenant's last date), frequency (rows) and monetary (revenue). The customers are
    stored once: the tenants' dates, statistics and quartiles all read them, and each
    would shuffle the rows of the sales table again."""
    per = (sales.where(F.col(customer).isNotNull())
           .groupBy(*by, customer)
           .agg(F.max("date").alias("last_date"), F.count("id").alias("frequency"),
                F.sum("total_sales").alias("monetary")))
    return rfm_of(stored(per, "customers"), by, customer)


def rfm_of(per: DataFrame, by=TENANT, customer: str = "customer_id") -> DataFrame:
    """G1 from one row per customer: last_date, frequency and monetary."""
    ref = per.groupBy(*by).agg(F.max("last_date").alias("ref_date"))
    return (per.join(F.broadcast(ref), list(by))
            .select(*by, customer,
                    F.expr("timestampdiff(DAY, last_date, ref_date)").cast("bigint").alias("recency"),
                    F.col("frequency").cast("bigint").alias("frequency"),
                    as_double("monetary").alias("monetary")))


def tenant_stats(r: DataFrame, by=TENANT) -> DataFrame:
    aggs = []
    for c in FEATURES:
        aggs += [F.avg(as_double(c)).alias(f"{c}_mean"), F.stddev_pop(as_double(c)).alias(f"{c}_std")]
    return r.groupBy(*by).agg(*aggs)


def scale_rfm(r: DataFrame, stats: DataFrame | None = None, by=TENANT, digits: int | None = None) -> DataFrame:
    """Z-scores with the population std; a constant feature scores 0."""
    stats = stats if stats is not None else tenant_stats(r, by)
    j = r.join(F.broadcast(stats), list(by))
    out = []
    for c in FEATURES:
        z = F.when(F.col(f"{c}_std") > 0, (as_double(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).otherwise(0.0)
        out.append((F.round(z, digits) if digits is not None else z).alias(f"{c}_z"))
    return j.select(*r.columns, *out)


def rule_segments(r: DataFrame, by=TENANT, exact: bool = True) -> DataFrame:
    """Segments without a model.

    Champions: monetary >= q75; Loyal Customers: below q75 and frequency > 5;
    At Risk: below q25 and recency > 60 (a later rule overrides an earlier
    one); else Standard. A tenant with one customer uses q75 = 1000 and
    q25 = 100. Quartiles are exact and distributed (a range sort, not one
    task per tenant); ``exact=False`` uses ``percentile_approx``.
    """
    if exact:
        qs = exact_quantiles(r, "monetary", [0.25, 0.75], by)
    else:
        qs = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[
            F.percentile_approx("monetary", q, 10000).cast("double").alias(f"q{i}")
            for i, q in enumerate([0.25, 0.75])])
    qs = qs.select(*by,
                   F.when(F.col("n") > 1, F.col("q0")).otherwise(RULE_Q25_SINGLE).alias("q25"),
                   F.when(F.col("n") > 1, F.col("q1")).otherwise(RULE_Q75_SINGLE).alias("q75"))
    m, f, rc = F.col("monetary"), F.col("frequency"), F.col("recency")
    seg = (F.when((m < F.col("q25")) & (rc > RULE_AT_RISK_RECENCY), SEGMENT_NAMES[2])
           .when((m < F.col("q75")) & (f > RULE_LOYAL_FREQUENCY), SEGMENT_NAMES[1])
           .when(m >= F.col("q75"), SEGMENT_NAMES[0])
           .otherwise(DEFAULT_SEGMENT))
    return r.join(F.broadcast(qs), list(by)).select(*r.columns, seg.alias("segment"))


def segment_counts(segmented: DataFrame, by=TENANT) -> DataFrame:
    """Customers per segment; the four named segments always appear
    (0 when empty), other names (e.g. Standard) are added."""
    counts = segmented.groupBy(*by, "segment").agg(F.count(F.lit(1)).alias("customers"))
    named = (segmented.select(*by).distinct()
             .select(*by, F.explode(F.array(*[F.lit(s) for s in SEGMENT_NAMES])).alias("segment")))
    return (named.join(counts, [*by, "segment"], "full")
            .select(*by, "segment", F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers")))


def _nearest(points: DataFrame, centroids: DataFrame, by) -> DataFrame:
    """``points`` with the nearest cluster (ties: the lower number). The
    centroids are one row per tenant, broadcast to the points."""
    held = centroids.groupBy(*by).agg(F.collect_list(F.struct(
        "cluster", *[f"c_{c}" for c in FEATURES])).alias("_c"))   # at most k entries
    d = lambda x: sum((F.col(f"{c}_z") - x[f"c_{c}"]) ** 2 for c in FEATURES)
    best = F.array_min(F.transform("_c", lambda x: F.struct(d(x).alias("d"), x["cluster"].alias("n"))))
    return points.join(F.broadcast(held), list(by), "left").withColumn("cluster", best["n"]).drop("_c")


SMALL_STATE = 100_000   # rows of state that the driver carries between steps; more are stored


def _carried(df: DataFrame, name: str, before: DataFrame | None = None) -> DataFrame:
    """A step's centroids, cut from their lineage: a local table while they are few (the
    size is checked by taking one row more), else a stored one. A local table is broadcast
    to the points: Spark does not know its size, and would shuffle all points every step."""
    rows = df.take(SMALL_STATE + 1)
    out = (stored(df, name) if len(rows) > SMALL_STATE
           else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)))
    if before is not None and hasattr(before, "stored_at"):
        discard(before)
    return out


def _squared(x: Column, y: Column) -> Column:
    return sum((x[f] - y[f]) * (x[f] - y[f]) for f in FEATURES)


def _distances(x: Column, cents: str, k: int, beyond: float | None = None) -> list[Column]:
    """Squared distances to at most k centroids, ``beyond`` after the last: plain expressions
    that Spark compiles, which a function over the array is not."""
    d = [_squared(x, F.get(cents, F.lit(i))) for i in range(k)]
    return d if beyond is None else [F.when(F.size(cents) > i, y).otherwise(F.lit(beyond)) for i, y in enumerate(d)]


def _least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def _nearest_of(d: list[Column]) -> Column:
    """Number of the least distance (ties: the lower number); an unknown one is least."""
    least, out = _least(d), F
    for i, x in enumerate(d):
        out = out.when(x.isNull(), i)
    for i, x in enumerate(d):
        out = out.when(x == least, i)
    return out


RACES = 16   # parts of a race, each reduced to its smallest key


def _smallest_keys(entries: DataFrame, n: int, groups: list[str]) -> DataFrame:
    """The entries (with key ``t`` and a part ``_s`` of ``RACES``) that may be among a group's
    n smallest keys: those up to the n-th of the parts' smallest. Two passes reduced on the
    map side and no sort of the entries; the few left are ranked by the caller."""
    least = entries.groupBy(*groups, "_s").agg(F.min("t").alias("t"))
    bound = least.groupBy(*groups).agg(F.get(F.array_sort(F.collect_list("t")), F.lit(n - 1)).alias("_bound"))
    return (entries.join(F.broadcast(bound), groups)
            .where(F.col("_bound").isNull() | (F.col("t") <= F.col("_bound"))).drop("_bound"))


def seed_centroids(points: DataFrame, k: int, restarts: int, seed: int, by=TENANT, key=("customer_id",),
                   trials: int = 3) -> DataFrame:
    """D-squared seeding for every tenant and restart in one job per round.

    A round draws each new centroid with probability proportional to the squared distance
    to the nearest centroid so far: of the exponential keys ``-ln(u) / weight`` the
    smallest wins (:func:`_smallest_keys`). It takes ``trials`` candidates
    (the smallest keys) and keeps the one that leaves the least inertia. ``u`` is a hash of
    the customer, the restart and the round, so draws do not depend on partitioning; of the
    features it takes six decimals, since the last bits of a mean depend on the order of its sum.
    One row per tenant and restart: ``run`` and ``cents``, an array of points; a tenant
    with fewer distinct customers than k has fewer.
    """
    spot = F.struct(*[F.col(f"{c}_z").alias(c) for c in FEATURES])
    near_x = [F.floor(F.col(f"{c}_z") * 1e6 + 0.5) for c in FEATURES]
    pts = points.select(*by, *key, spot.alias("x"), F.xxhash64(*key, *near_x).alias("_k"))
    groups, cents = [*by, "run"], None
    for n in range(k):
        if cents is None:
            j = pts.select("*", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("run"))
            weight = F.lit(1.0)
        else:
            j = pts.join(cents, list(by))   # tenants x restarts rows: joined by size
            weight = _least(_distances(F.col("x"), "cents", n))
        j = j.withColumn("_w", weight)
        hashed = F.xxhash64("_k", "run", F.lit(n), F.lit(seed))
        u = (F.pmod(F.col("_h"), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)
        entries = (j.where(F.col("_w") > 0).withColumn("_h", hashed)
                   .select(*by, *key, "run", "x", (-F.log(u) / F.col("_w")).alias("t"),
                           F.pmod(F.shiftright("_h", 40), F.lit(RACES)).alias("_s")))
        if cents is None:
            first = _smallest_keys(entries, 1, groups).groupBy(*groups).agg(F.min(F.struct("t", "x")).alias("d"))
            cents = _carried(first.select(*groups, F.array("d.x").alias("cents")), "seeds")
            continue
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy("t", *key))
        tried = _smallest_keys(entries, trials, groups).withColumn("r", rank).where(F.col("r") <= trials)
        tried = _carried(tried.groupBy(*groups).agg(F.array_sort(F.collect_list("x")).alias("tried")), "tried")
        after = [F.sum(F.least(F.col("_w"), d)).alias(f"left{i}")
                 for i, d in enumerate(_distances(F.col("x"), "tried", trials))]
        # a place without a candidate adds the weight itself: no less than any candidate's, and later
        left = j.join(tried, groups).groupBy(*groups).agg(*after)
        best = left.select(*groups, _nearest_of([F.col(f"left{i}") for i in range(trials)]).alias("i"))
        chosen = tried.join(best, [*by, "run"]).select(*by, "run", F.col("tried")[F.col("i")].alias("new"))
        cents = _carried(cents.join(chosen, [*by, "run"], "left").select(
            *by, "run", F.when(F.col("new").isNull(), F.col("cents"))
            .otherwise(F.concat("cents", F.array("new"))).alias("cents")), "seeds", cents)
    return cents


def kmeans_segments(scaled: DataFrame, k: int = 4, tolerance: float = 1e-4, most_steps: int = 300,
                    seed: int = 42, by=TENANT, key=("customer_id",), restarts: int = 4) -> tuple[DataFrame, DataFrame]:
    """K-means with k = min(k, distinct customers) per tenant, all tenants and
    restarts in one job per step; clusters named by mean monetary value, descending.

    Every tenant starts ``restarts`` times from :func:`seed_centroids` and keeps the run of
    least inertia. Steps go on until the squared movement of every run's centroids is at
    most ``tolerance`` (z-scored features have unit variance); ``most_steps``
    stops a run that never settles. Returns ``(assignments, model)``;
    ``model`` holds per tenant and cluster the centroid and segment name (see
    :func:`score_segments`). A step joins the runs' centroids (one row per tenant and run,
    by size) to the points and takes one map-side reduced aggregate.
    """
    pts = stored(scaled.select(*by, *key, *[f"{c}_z" for c in FEATURES], "monetary"), "points")
    spots = pts.select(*by, F.struct(*[F.col(f"{c}_z").alias(c) for c in FEATURES]).alias("x"))
    runs = seed_centroids(pts, k, restarts, seed, by, key)
    spread = lambda: spots.join(runs, list(by)).select(
        *by, "run", "x", *[d.alias(f"d{i}") for i, d in enumerate(_distances(F.col("x"), "cents", k, math.nan))])   # NaN: greater than any
    d = [F.col(f"d{i}") for i in range(k)]
    for _ in range(most_steps):
        sums = (spread().select(*by, "run", "x", _nearest_of(d).alias("n"))
                .groupBy(*by, "run", "n")
                .agg(F.struct(*[F.avg(F.col("x")[c]).alias(c) for c in FEATURES]).alias("mean")))
        means = sums.groupBy(*by, "run").agg(F.map_from_entries(F.collect_list(F.struct("n", "mean"))).alias("means"))
        moved = (runs.join(means, [*by, "run"], "left").select(
            *by, "run", "cents", F.transform("cents", lambda c, i: F.coalesce(F.element_at("means", i), c)).alias("new")))
        step = F.zip_with("cents", "new", _squared)
        after = _carried(moved.select(*by, "run", F.col("new").alias("cents"), F.aggregate(
            step, F.lit(0.0), lambda a, b: a + b).alias("moved")), "centroids", runs)
        runs = after.drop("moved")
        most = after.agg(F.max("moved")).first()[0]
        if most is None or most <= tolerance:
            break
    known = reduce(Column.__and__, [x.isNotNull() for x in d])
    inertia = spread().groupBy(*by, "run").agg(F.sum(F.when(known, _least(d))).alias("inertia"))
    best = inertia.groupBy(*by).agg(F.min_by("run", F.struct("inertia", "run")).alias("run"))
    cents = _carried(runs.join(best, [*by, "run"]).select(*by, F.posexplode("cents").alias("cluster", "c"))
                     .select(*by, "cluster", *[F.col("c")[c].alias(f"c_{c}") for c in FEATURES]), "centroids")
    assigned = _nearest(pts, cents, by)
    means = assigned.groupBy(*by, "cluster").agg(F.avg("monetary").alias("m"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("m"), "cluster"))
    names = F.array(*[F.lit(s) for s in SEGMENT_NAMES])
    naming = means.select(*by, "cluster", F.element_at(names, F.least(rank, F.lit(len(SEGMENT_NAMES))))
                          .alias("segment"))
    model = cents.join(naming, [*by, "cluster"], "left")
    out = assigned.join(F.broadcast(naming), [*by, "cluster"]).select(*by, *key, "cluster", "segment")
    return out, model


def kmeans_check(scaled: DataFrame, assigned: DataFrame, model: DataFrame, by=TENANT,
                 key=("customer_id",)) -> DataFrame:
    """What holds for any k-means result: per tenant, its customers, its clusters,
    the customers that lie nearer to another centroid, and the clusters whose centroid is
    off the mean of its customers (beyond the last step's tolerance)."""
    j = assigned.join(scaled, [*by, *key])
    own = _nearest(j.withColumnRenamed("cluster", "_own").drop("segment"), model, by)
    far = own.groupBy(*by).agg(F.count(F.lit(1)).alias("customers"),
                               F.count(F.when(F.col("cluster") != F.col("_own"), 1)).alias("misplaced"))
    means = j.groupBy(*by, "cluster").agg(*[F.avg(f"{c}_z").alias(f"m_{c}") for c in FEATURES])
    off = sum((F.col(f"m_{c}") - F.col(f"c_{c}")) ** 2 for c in FEATURES)
    drift = (model.join(means, [*by, "cluster"]).groupBy(*by)
             .agg(F.count(F.lit(1)).alias("clusters"), F.count(F.when(off > 1e-4, 1)).alias("off_centre")))
    return far.join(drift, list(by))


def score_segments(scaled: DataFrame, model: DataFrame, by=TENANT, key=("customer_id",)) -> DataFrame:
    """Nearest saved centroid per customer; a cluster without a name
    (or a tenant without a model) gets the default segment."""
    near = _nearest(scaled, model.select(*by, "cluster", *[f"c_{c}" for c in FEATURES]), by)
    names = model.select(*by, "cluster", "segment")
    return (near.select(*by, *key, "cluster").join(F.broadcast(names), [*by, "cluster"], "left")
            .select(*by, *key, "cluster", F.coalesce("segment", F.lit(DEFAULT_SEGMENT)).alias("segment")))
