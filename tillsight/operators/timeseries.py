"""Daily series and forecasting features.

A series is identified by ``series`` columns (default the tenant). Line
items are first reduced to one row per (series, day); every window below
runs over those daily rows, partitioned by series. A series holds at most
one row per calendar day, so a window partition is bounded by the calendar
span, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import exact_mean
from ..schema import FEATURE_COLUMNS, LAGS, MIN_SERIES_POINTS, ROLL_WINDOWS

SERIES = ("user_id",)
LAG_ROLL_COLUMNS = [c for c in FEATURE_COLUMNS if c.startswith("sales_")]


def daily_totals(sales: DataFrame, series=SERIES) -> DataFrame:
    """Revenue per series and calendar day (``day`` is a DATE)."""
    return (sales.groupBy(*series, F.to_date("date").alias("day"))
            .agg(F.sum("total_sales").alias("total_sales")))


def sufficiency(sales: DataFrame, series=SERIES, min_points: int = MIN_SERIES_POINTS) -> DataFrame:
    """Number of distinct timestamps per series and whether it reaches
    the minimum for training (``ok`` / ``insufficient_data``). No rows are
    invented for short series."""
    c = sales.groupBy(*series).agg(F.countDistinct("date").alias("points"))
    return c.select(*series, F.col("points").cast("bigint").alias("points"),
                    F.when(F.col("points") >= min_points, "ok").otherwise("insufficient_data").alias("status"))


def dense_daily(sales: DataFrame, series=SERIES) -> DataFrame:
    """Every day from the series' first to last day; days without
    sales get 0. The calendar is a per-series ``sequence``, joined back on
    (series, day)."""
    d = daily_totals(sales, series)
    span = d.groupBy(*series).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    cal = span.select(*series, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    return (cal.join(d, [*series, "day"], "left")
            .select(*series, "day", F.coalesce("total_sales", F.lit(0).cast("decimal(38,4)")).alias("total_sales")))


def calendar_features(df: DataFrame, day: str = "day") -> DataFrame:
    """T4: day_of_week (Monday = 0), day_of_month, month, year."""
    d = F.col(day)
    return df.select("*", F.weekday(d).alias("day_of_week"), F.dayofmonth(d).alias("day_of_month"),
                     F.month(d).alias("month"), F.year(d).alias("year"))


def lag_features(df: DataFrame, series=SERIES, value: str = "total_sales") -> DataFrame:
    """T5: value 1, 2, 7 and 14 days earlier."""
    w = Window.partitionBy(*series).orderBy("day")
    return df.select("*", *[F.lag(F.col(value).cast("double"), k).over(w).alias(f"sales_lag_{k}") for k in LAGS])


def rolling_features(df: DataFrame, series=SERIES, value: str = "total_sales",
                     digits: int | None = None) -> DataFrame:
    """Mean and sample std of the previous ``w`` days (current day
    excluded); null unless the window is full. ``digits`` rounds both, for
    comparisons that must not depend on summation order."""
    base = Window.partitionBy(*series).orderBy("day")
    cols = []
    v = F.col(value).cast("double")
    for w in ROLL_WINDOWS:
        frame = base.rowsBetween(-w, -1)
        full = F.count(v).over(frame) == w
        std = F.stddev_samp(v).over(frame)
        mean = F.avg(v).over(frame)
        if digits is not None:
            std = F.round(std, digits)
            mean = exact_mean(F.sum(value).over(frame), F.count(value).over(frame), digits)
        cols += [F.when(full, mean).alias(f"sales_roll_mean_{w}"),
                 F.when(full, std).alias(f"sales_roll_std_{w}")]
    return df.select("*", *cols)


def feature_table(sales: DataFrame, series=SERIES, digits: int | None = None) -> DataFrame:
    """Dense daily series with the 12 features; rows with a missing
    feature (the first 14 days) are dropped."""
    d = dense_daily(sales, series)
    f = rolling_features(lag_features(calendar_features(d), series), series, digits=digits)
    return f.dropna(subset=LAG_ROLL_COLUMNS)


def feature_table_with_fallback(sales: DataFrame, series=SERIES, digits: int | None = None) -> DataFrame:
    """Like :func:`feature_table`, but a series with no complete row
    keeps all its days and every lag/rolling feature is the series mean."""
    d = dense_daily(sales, series)
    f = rolling_features(lag_features(calendar_features(d), series), series, digits=digits)
    complete = F.greatest(*[F.col(c).isNull() for c in LAG_ROLL_COLUMNS]) == F.lit(False)
    w = Window.partitionBy(*series)
    f = (f.withColumn("_ok", complete)
         .withColumn("_n_ok", F.sum(F.col("_ok").cast("int")).over(w))
         .withColumn("_mean", F.avg(F.col("total_sales").cast("double")).over(w)))
    fb = F.col("_n_ok") == 0
    f = f.select(*[c for c in f.columns if c not in LAG_ROLL_COLUMNS and not c.startswith("_")],
                 *[F.when(fb, F.col("_mean")).otherwise(F.col(c)).alias(c) for c in LAG_ROLL_COLUMNS],
                 "_ok", "_n_ok")
    return f.where(F.col("_ok") | (F.col("_n_ok") == 0)).drop("_ok", "_n_ok")


def chronological_split(features: DataFrame, series=SERIES) -> DataFrame:
    """The last min(7, int(0.2 n)) rows of each series (at least 1)
    are ``test``, the rest ``train``."""
    w = Window.partitionBy(*series)
    rev = Window.partitionBy(*series).orderBy(F.desc("day"))
    n = F.count(F.lit(1)).over(w)
    test_size = F.greatest(F.least(F.lit(7), F.floor(n * 0.2)), F.lit(1))
    return features.withColumn("split", F.when(F.row_number().over(rev) <= test_size, "test").otherwise("train"))
