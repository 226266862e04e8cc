"""Business-field imputation after mapping.

``present`` is the set of standard columns that came from a source header;
a rule that depends on a column being absent checks that set (a header is
metadata), never the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import date_orders, parse_number, parse_timestamp, whole_number
from ..schema import (DEFAULT_INVENTORY, DEFAULT_QUANTITY, DEFAULT_UNIT_PRICE, LABEL_DEFAULTS,
                      NONPOSITIVE_UNIT_PRICE, PASSTHROUGH_COLUMNS, PROFIT_RATE, SALES_SCHEMA,
                      SYNTH_INVENTORY_HIGH, SYNTH_INVENTORY_LOW)

ORDER_COL = "_row"
FFILL_CHUNK = 1 << 17   # rows per forward-fill chunk (bounds one window partition)


def _num(c: str) -> Column:
    return parse_number(F.col(c).cast("string")) if c else F.lit(None).cast("double")


def parse_dates(df: DataFrame, column: str = "date", day_first: Column | None = None) -> Column:
    """Text -> timestamp over a list of formats; numbers are epoch nanoseconds
    (so a zero-filled column gives 1970-01-01)."""
    dt = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    if isinstance(dt, T.DateType):
        return c.cast("timestamp")
    if isinstance(dt, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.DecimalType)):
        return F.timestamp_micros((c.cast("double") / 1000).cast("bigint"))
    return parse_timestamp(c, day_first=day_first)


def forward_fill(df: DataFrame, column: str, order_col: str = ORDER_COL, by=(),
                 chunk: int = FFILL_CHUNK) -> DataFrame:
    """Last non-null value in row order, without one window over all rows.

    Pass 1 fills inside fixed-size chunks of the order key (each chunk is one
    window partition). Pass 2 takes the last non-null value of every chunk
    (one row per chunk) and carries it into the following chunks; that table
    is ``rows / chunk`` long. Rows still null after both passes had no
    earlier value.
    """
    ck = F.floor(F.col(order_col) / F.lit(chunk)).cast("bigint")
    w_in = Window.partitionBy(*by, "_chunk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_chunk", ck).withColumn("_local", F.last(column, ignorenulls=True).over(w_in))
    # the filled value of a chunk's last row is its last non-null value (or null)
    tails = d.groupBy(*by, "_chunk").agg(F.max_by("_local", order_col).alias("_tail"))
    w_c = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*by, "_chunk", F.last("_tail", ignorenulls=True).over(w_c).alias("_carry"))
    return (d.join(carry, [*by, "_chunk"], "left")
            .withColumn(column, F.coalesce("_local", "_carry"))
            .drop("_chunk", "_local", "_carry"))


def impute_date(df: DataFrame, now: str, order_col: str = ORDER_COL, by=(), profile=None) -> DataFrame:
    """Parse; unparseable -> previous valid date in row order; none
    before -> ``now``. A cleaning profile counts the dates that could not be read."""
    if isinstance(df.schema["date"].dataType, T.StringType):
        order = df.groupBy(*by).agg(date_orders("date").alias("_day_first"))   # one row per upload
        d = df.join(F.broadcast(order), list(by)) if by else df.crossJoin(F.broadcast(order))
        d = d.withColumn("date", parse_dates(d, "date", F.col("_day_first"))).drop("_day_first")
    else:
        d = df.withColumn("date", parse_dates(df, "date"))
    if profile is not None:
        profile.dated = True
        d = d.observe(profile.dates, F.count(F.when(F.col("date").isNull(), 1)).alias("unread"))
    d = forward_fill(d, "date", order_col, by)
    return d.withColumn("date", F.coalesce("date", F.to_timestamp(F.lit(now))))


def backfill_dates(df: DataFrame, end: str, position_col: str, n_col: str) -> DataFrame:
    """No date column: consecutive days ending at ``end``; row i of n
    (1-based position) gets end - (n - i) days."""
    return df.withColumn("date", F.to_timestamp(F.lit(end))
                         - F.make_dt_interval(days=(F.col(n_col) - F.col(position_col)).cast("int")))


def impute_quantity(c: str | None) -> Column:
    """Number, missing -> 1, truncated to int, <= 0 -> 1."""
    q = F.coalesce(whole_number(_num(c)), F.lit(DEFAULT_QUANTITY))
    return F.when(q <= 0, F.lit(1)).otherwise(q)


def impute_unit_price(c: str | None) -> Column:
    """I4: number, missing -> 10.0, <= 0 -> 1.0."""
    p = F.coalesce(_num(c), F.lit(DEFAULT_UNIT_PRICE))
    return F.when(p <= 0, F.lit(NONPOSITIVE_UNIT_PRICE)).otherwise(p)


def impute_total_sales(c: str | None, quantity: Column, unit_price: Column) -> Column:
    """Number, else (or when absent) quantity x unit price."""
    return F.coalesce(_num(c), quantity.cast("double") * unit_price)


def impute_total_profit(c: str | None, total_sales: Column, rate: float = PROFIT_RATE) -> Column:
    """Number, else (or when absent) 15 % of the revenue."""
    return F.coalesce(_num(c), total_sales * F.lit(rate))


def label_defaults(cols: dict[str, Column]) -> dict[str, Column]:
    """Default labels as text; sub_category falls back to category."""
    out = {k: F.coalesce(cols[k].cast("string"), F.lit(v)) for k, v in LABEL_DEFAULTS.items()}
    out["sub_category"] = F.coalesce(cols["sub_category"].cast("string"), out["category"])
    return out


def impute_inventory(c: str) -> Column:
    """Number, missing -> 100, int, < 0 -> 0."""
    v = F.coalesce(whole_number(_num(c)), F.lit(DEFAULT_INVENTORY))
    return F.when(v < 0, F.lit(0)).otherwise(v)


def synth_inventory(order_col: str = ORDER_COL, seed: int = 42) -> Column:
    """No stock column: a stable pseudo-random level in [50, 1000) from
    the row key (independent of partitioning, unlike ``rand``)."""
    span = SYNTH_INVENTORY_HIGH - SYNTH_INVENTORY_LOW
    return (F.pmod(F.col(order_col) * F.lit(40503) + F.lit(seed * 9973), F.lit(span))
            + F.lit(SYNTH_INVENTORY_LOW)).cast("int")


def impute_fields(mapped: DataFrame, present: set[str], now: str, order_col: str = ORDER_COL,
                  by=(), seed: int = 42, profile=None) -> DataFrame:
    """I1-I11 on a mapped frame. The date rule needs a row order; when the
    date column is absent, rows get consecutive days ending at ``now``."""
    if "date" in present:
        d = impute_date(mapped, now, order_col, by, profile)
    else:
        # ``order_col`` is a dense 1-based position per upload (see
        # plans.etl.with_row_order), so only the row count is aggregated.
        n = mapped.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        d = mapped.join(F.broadcast(n), list(by)) if by else mapped.crossJoin(F.broadcast(n))
        d = backfill_dates(d, now, order_col, "_n").drop("_n")
    src = {c: (c if c in present else None) for c in ["quantity", "unit_price", "total_sales",
                                                       "total_profit", "inventory_level"]}
    qty = impute_quantity(src["quantity"])
    price = impute_unit_price(src["unit_price"])
    d = d.withColumn("quantity", qty).withColumn("unit_price", price)
    d = d.withColumn("total_sales", impute_total_sales(src["total_sales"], F.col("quantity"), F.col("unit_price")))
    d = d.withColumn("total_profit", impute_total_profit(src["total_profit"], F.col("total_sales")))
    labels = label_defaults({k: F.col(k) for k in [*LABEL_DEFAULTS, "sub_category"]})
    for k, v in labels.items():
        d = d.withColumn(k, v)
    inv = impute_inventory("inventory_level") if "inventory_level" in present else synth_inventory(order_col, seed)
    return d.withColumn("inventory_level", inv)


def canonicalise(df: DataFrame, user_id: int | None = None, dataset_id: int | None = None,
                 id_col: str = ORDER_COL) -> DataFrame:
    """The stored schema: typed columns plus id, dataset_id, user_id
    (taken from the frame's own columns where no value is given)."""
    cols = []
    for f in SALES_SCHEMA.fields:
        if f.name == "id":
            c = F.col(id_col).cast("bigint")
        elif f.name == "dataset_id":
            c = (F.col("dataset_id") if dataset_id is None else F.lit(dataset_id)).cast("bigint")
        elif f.name == "user_id":
            c = (F.col("user_id") if user_id is None else F.lit(user_id)).cast("bigint")
        elif f.name in PASSTHROUGH_COLUMNS:
            c = F.col(f.name).cast("string")
        else:
            c = F.col(f.name).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)
