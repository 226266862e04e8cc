"""Business aggregates over the sales fact (KPIs, shares, rankings, stock).

All operators group by the tenant key (``by``, default ``user_id``) so one
job serves every tenant. Aggregations are partial/final hash aggregates
(map-side combine), so a tenant holding a third of all rows is reduced on
every mapper before the shuffle. Windows only ever run over *aggregated*
rows (months, products, categories), never over raw line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import as_double, pct_of
from ..schema import (CRITICAL_STOCK_THRESHOLD, LEDGER_DEFAULT_STOCK, LEDGER_PROFIT_RATE,
                      LOW_STOCK_THRESHOLD, PROJECTION_FACTOR)

TENANT = ("user_id",)

# Label fallbacks of the browser views.
REGION_FALLBACK = "East Coast"
SUPPLIER_FALLBACK = "Apex Logistics"
CUSTOMER_TYPE_FALLBACK = "Champions"
CATEGORY_FALLBACK = "General"
WEEKDAY_SHORT = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
FUNNEL_STAGES = ["view", "click", "signup", "purchase"]


def _by(by):
    return list(by) if by else []


def monthly_sales(sales: DataFrame, by=TENANT) -> DataFrame:
    return (sales.groupBy(*_by(by), F.trunc("date", "month").alias("month_start"))
            .agg(F.sum("total_sales").alias("month_sales")))


def mom_growth(sales: DataFrame, by=TENANT) -> DataFrame:
    """Growth of the last month present over the month before it (%).

    0 when there are fewer than two months or the previous month is not
    positive. The window runs over monthly sums per tenant only.
    """
    m = monthly_sales(sales, by)
    w = Window.partitionBy(*_by(by)).orderBy("month_start")
    m = m.withColumn("prev_sales", F.lag("month_sales").over(w))
    last = (m.groupBy(*_by(by))
            .agg(F.max_by(F.struct("month_start", "month_sales", "prev_sales"), "month_start").alias("l")))
    cur, prev = F.col("l.month_sales"), F.col("l.prev_sales")
    growth = F.when(prev > 0, F.round(as_double(cur - prev) / as_double(prev) * 100.0, 2)).otherwise(0.0)
    return last.select(
        *_by(by),
        F.date_format("l.month_start", "yyyy-MM").alias("last_month"),
        as_double(cur).alias("last_month_sales"),
        as_double(prev).alias("prev_month_sales"),
        growth.alias("sales_growth"),
    )


def kpi_summary(sales: DataFrame, by=TENANT, exact_distinct: bool = True) -> DataFrame:
    """The eight KPI values per tenant.

    ``total_sales`` is the number of units (the reference's name). Distinct
    counts are exact by default; ``exact_distinct=False`` switches to
    HyperLogLog++ sketches for very large tenants.
    """
    distinct = F.countDistinct if exact_distinct else F.approx_count_distinct
    base = sales.groupBy(*_by(by)).agg(
        F.sum("total_sales").alias("rev"),
        F.sum("quantity").cast("bigint").alias("total_sales"),
        distinct("customer_id").cast("bigint").alias("total_customers"),
        distinct("product_name").cast("bigint").alias("total_products"),
        F.sum("total_profit").alias("prof"),
        F.avg("inventory_level").alias("avg_inv"),
    )
    g = mom_growth(sales, by).select(*_by(by), "sales_growth")
    return kpi_columns(base.join(g, _by(by), "left") if by else base.crossJoin(g), by)


def kpi_columns(base: DataFrame, by=TENANT) -> DataFrame:
    """The KPI values from a tenant's sums (rev, prof, avg_inv), counts and growth."""
    return base.select(
        *_by(by),
        as_double(F.round("rev", 2)).alias("total_revenue"),
        "total_sales", "total_customers", "total_products",
        as_double(F.round("prof", 2)).alias("total_profit"),
        F.round("avg_inv", 2).alias("avg_inventory"),
        F.coalesce("sales_growth", F.lit(0.0)).alias("sales_growth"),
        pct_of("prof", "rev").alias("profit_margin"),
    )


def tenant_kpis(sales: DataFrame, user_id: int) -> DataFrame:
    """A9 for one tenant: always exactly one row, all zeros when it has no rows."""
    one = sales.where(F.col("user_id") == user_id)
    k = kpi_summary(one, by=())
    zero = one.sparkSession.range(1).select(F.lit(user_id).cast("bigint").alias("user_id"))
    return zero.join(k, how="left").select(
        "user_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c) for c, t in [
            ("total_revenue", "double"), ("total_sales", "bigint"), ("total_customers", "bigint"),
            ("total_products", "bigint"), ("total_profit", "double"), ("avg_inventory", "double"),
            ("sales_growth", "double"), ("profit_margin", "double")]])


PERIOD_LABELS = {
    "daily": lambda d: F.date_format(d, "yyyy-MM-dd"),
    # Week of month is ceil(day / 7); the year-month prefix keeps weeks of
    # different months apart.
    "weekly": lambda d: F.concat(F.date_format(d, "yyyy-MM"), F.lit(" W"),
                                 F.ceil(F.dayofmonth(d) / 7).cast("string")),
    "monthly": lambda d: F.date_format(d, "yyyy-MM"),
    "quarterly": lambda d: F.concat(F.year(d).cast("string"), F.lit(" Q"), F.quarter(d).cast("string")),
    "yearly": lambda d: F.year(d).cast("string"),
}


def sales_trend(sales: DataFrame, grain: str = "daily", by=TENANT) -> DataFrame:
    """Revenue per period label, ascending by label."""
    label = PERIOD_LABELS[grain](F.col("date"))
    return (sales.groupBy(*_by(by), label.alias("label"))
            .agg(as_double(F.sum("total_sales")).alias("value"))
            .orderBy(*_by(by), "label"))


def category_distribution(sales: DataFrame, by=TENANT) -> DataFrame:
    """Revenue per category and its share of the tenant total (%)."""
    cat = (sales.groupBy(*_by(by), F.coalesce("category", F.lit(CATEGORY_FALLBACK)).alias("category"))
           .agg(F.sum("total_sales").alias("s")))
    total = F.sum("s").over(Window.partitionBy(*_by(by)))
    return (cat.withColumn("t", total)
            .select(*_by(by), "category", as_double("s").alias("sales"),
                    pct_of("s", "t").alias("percentage"))
            .orderBy(*_by(by), F.desc("sales"), "category"))


def product_performance(sales: DataFrame, n: int = 5, ascending: bool = False,
                        by=TENANT) -> DataFrame:
    """Top (or worst) ``n`` products by revenue per tenant.

    Ties break on the product name. The row_number filter becomes a
    per-partition group limit, so only ``n`` rows per tenant and mapper
    reach the final sort.
    """
    perf = sales.groupBy(*_by(by), "product_name").agg(
        F.sum("total_sales").alias("s"), F.sum("quantity").alias("q"),
        F.sum("total_profit").alias("p"))
    order = F.col("s").asc() if ascending else F.col("s").desc()
    w = Window.partitionBy(*_by(by)).orderBy(order, F.col("product_name").asc())
    return (perf.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(*_by(by), F.col("rank").cast("bigint").alias("rank"), "product_name",
                    as_double(F.round("s", 2)).alias("sales"),
                    F.col("q").cast("bigint").alias("quantity"),
                    as_double(F.round("p", 2)).alias("profit")))


def group_sales(sales: DataFrame, label, name: str, by=TENANT) -> DataFrame:
    return (sales.groupBy(*_by(by), label.alias(name))
            .agg(as_double(F.sum("total_sales")).alias("value"))
            .orderBy(*_by(by), F.desc("value"), name))


def regional_sales(sales: DataFrame, by=TENANT) -> DataFrame:
    """Revenue per region (region, else store, else a default)."""
    return group_sales(sales, F.coalesce("region", "store_name", F.lit(REGION_FALLBACK)), "region", by)


def supplier_sales(sales: DataFrame, by=TENANT) -> DataFrame:
    """Revenue per supplier (missing supplier gets the default name)."""
    return group_sales(sales, F.coalesce("supplier", F.lit(SUPPLIER_FALLBACK)), "supplier", by)


def customer_type_counts(sales: DataFrame, by=TENANT) -> DataFrame:
    """Transactions per customer type."""
    return (sales.groupBy(*_by(by), F.coalesce("customer_type", F.lit(CUSTOMER_TYPE_FALLBACK))
                          .alias("customer_type"))
            .agg(F.count(F.lit(1)).alias("transactions"))
            .orderBy(*_by(by), F.desc("transactions"), "customer_type"))


def region_weekday_matrix(sales: DataFrame, by=TENANT) -> DataFrame:
    """Revenue per region x weekday. The pivot values are a fixed list,
    so Spark needs no extra job to find them."""
    wd = F.date_format("date", "E")
    p = (sales.withColumn("wd", wd)
         .groupBy(*_by(by), F.coalesce("region", F.lit(REGION_FALLBACK)).alias("region"))
         .pivot("wd", WEEKDAY_SHORT).agg(F.sum("total_sales")))
    return p.select(*_by(by), "region",
                    *[F.coalesce(as_double(d), F.lit(0.0)).alias(d.lower()) for d in WEEKDAY_SHORT])


def ledger_kpis(sales: DataFrame, by=TENANT) -> DataFrame:
    """The browser KPI cards with their per-row fallbacks.

    Profit falls back to 22 % of the row's revenue when missing or zero,
    units to 1, stock to 120.
    """
    rev = F.coalesce(F.col("total_sales"), F.lit(0))
    prof = F.when(F.coalesce(F.col("total_profit"), F.lit(0)) != 0, F.col("total_profit")) \
        .otherwise(rev * F.lit(LEDGER_PROFIT_RATE).cast("decimal(3,2)"))
    units = F.when(F.coalesce(F.col("quantity"), F.lit(0)) != 0, F.col("quantity")).otherwise(1)
    stock = F.when(F.coalesce(F.col("inventory_level"), F.lit(0)) != 0, F.col("inventory_level")) \
        .otherwise(LEDGER_DEFAULT_STOCK)
    a = sales.groupBy(*_by(by)).agg(
        F.sum(rev).alias("rev"), F.sum(prof).alias("prof"),
        F.sum(units).cast("bigint").alias("units"), F.count(F.lit(1)).alias("orders"),
        F.countDistinct(F.coalesce("customer_id", "customer_type")).alias("customers"),
        F.countDistinct("product_name").alias("skus"), F.avg(stock).alias("stock"))
    return a.select(
        *_by(by),
        as_double("rev").alias("revenue"),
        as_double(F.round("prof", 2)).alias("profit"),
        "units", F.col("orders").cast("bigint").alias("orders"),
        F.col("customers").cast("bigint").alias("customers"),
        F.col("skus").cast("bigint").alias("skus"),
        F.round("stock", 2).alias("avg_stock"),
        F.round(as_double("rev") / F.col("orders"), 2).alias("avg_order_value"),
        F.round(as_double("rev") * PROJECTION_FACTOR, 2).alias("projected_revenue"),
    )


def pareto_products(sales: DataFrame, cutoff_pct: float = 80.0, by=TENANT) -> DataFrame:
    """Products by revenue (descending) with cumulative share of the
    tenant total; ``in_head`` marks the products up to ``cutoff_pct``.

    The running sum is taken after aggregation, with a distributed running
    total (a range sort; no window holds a tenant's whole product list)."""
    from .ledger import running_totals
    prod = sales.groupBy(*_by(by), "product_name").agg(F.sum("total_sales").alias("s"))
    tot = prod.groupBy(*_by(by)).agg(F.sum("s").alias("tot"))
    r = running_totals(prod, _by(by), [F.desc("s"), F.asc("product_name")], "s", "rank", "cum")
    p = r.join(tot, _by(by)) if by else r.crossJoin(F.broadcast(tot))   # one row per tenant / one row
    share = pct_of("cum", "tot")
    return p.select(*_by(by), "product_name", as_double("s").alias("sales"), "rank",
                    share.alias("cum_share"), (share <= cutoff_pct).alias("in_head"))


def low_stock_latest(sales: DataFrame, n: int = 3, order_key: str = "id", by=TENANT) -> DataFrame:
    """Per product, the last stock level among rows under the threshold
    (last = highest ``order_key``, then highest level on a tie of keys);
    the ``n`` lowest per tenant."""
    low = sales.where(F.col("inventory_level") < LOW_STOCK_THRESHOLD)
    last = low.groupBy(*_by(by), "product_name").agg(
        F.max_by("inventory_level", F.struct(order_key, "inventory_level")).alias("inventory_level"))
    w = Window.partitionBy(*_by(by)).orderBy(F.asc("inventory_level"), F.asc("product_name"))
    return (last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(*_by(by), F.col("rank").cast("bigint").alias("rank"), "product_name",
                    F.col("inventory_level").cast("bigint").alias("inventory_level")))


def stock_tier(level) -> "F.Column":
    lv = F.col(level) if isinstance(level, str) else level
    return (F.when(lv < CRITICAL_STOCK_THRESHOLD, "critical")
            .when(lv < LOW_STOCK_THRESHOLD, "low").otherwise("healthy"))


def stock_tiers(sales: DataFrame, by=TENANT) -> DataFrame:
    """Rows per stock tier and their share of the tenant's rows (%)."""
    t = (sales.groupBy(*_by(by), stock_tier("inventory_level").alias("tier"))
         .agg(F.count(F.lit(1)).alias("rows")))
    tot = F.sum("rows").over(Window.partitionBy(*_by(by)))
    return t.select(*_by(by), "tier", F.col("rows").cast("bigint").alias("rows"),
                    pct_of("rows", tot).alias("share"))


def product_matrix(sales: DataFrame, by=TENANT) -> DataFrame:
    """Average unit price, revenue and units per product."""
    return sales.groupBy(*_by(by), "product_name").agg(
        F.round(F.avg("unit_price"), 4).alias("avg_unit_price"),
        as_double(F.sum("total_sales")).alias("sales"),
        F.sum("quantity").cast("bigint").alias("quantity"))


def event_funnel(events: DataFrame, stages=FUNNEL_STAGES) -> DataFrame:
    """Distinct (user, day) pairs reaching each stage and the conversion
    from the previous stage (%). One scan, one distinct aggregation."""
    pairs = (events.where(F.col("event_type").isin(stages))
             .select("event_type", "user_id", F.to_date("ts").alias("day"))
             .groupBy("event_type").agg(F.countDistinct("user_id", "day").alias("pairs")))
    order = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("event_type"))
    w = Window.orderBy("stage_order")  # at most len(stages) rows
    p = pairs.withColumn("stage_order", order.cast("bigint"))
    prev = F.lag("pairs").over(w)
    return p.select(F.col("event_type").alias("stage"), "stage_order",
                    F.col("pairs").cast("bigint").alias("pairs"),
                    F.when(prev.isNull(), F.lit(100.0)).otherwise(pct_of("pairs", prev)).alias("conversion"))


def seasonal_months(sales: DataFrame, by=TENANT) -> DataFrame:
    """Month-of-year average of monthly revenue."""
    m = monthly_sales(sales, by)
    return (m.groupBy(*_by(by), F.month("month_start").cast("bigint").alias("month"))
            .agg(F.round(F.avg(as_double("month_sales")), 2).alias("avg_monthly_sales"),
                 F.count(F.lit(1)).cast("bigint").alias("years")))
