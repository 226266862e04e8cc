"""Row predicates: tenant scan and the ledger filters (all AND-ed).

Every filter is a plain Column expression, so Catalyst pushes what it can
(tenant, dates, low stock) into the parquet scan and prunes partitions of a
table written with ``partitionBy("user_id", "dataset_id")``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import all_of, ci_equals
from ..schema import ANALYTICS_COLUMNS, LEDGER_DEFAULT_COUNTRY, LOW_STOCK_THRESHOLD
from .metrics import stock_tier


def tenant_sales(sales: DataFrame, user_id: int, columns=ANALYTICS_COLUMNS) -> DataFrame:
    """S3: one tenant's rows, the 14 analytics columns; empty stays empty."""
    return sales.where(F.col("user_id") == F.lit(user_id)).select(*columns)


def has_records(sales: DataFrame, tenants: DataFrame) -> DataFrame:
    """For each tenant id in ``tenants(user_id)``, whether it has any row.

    A left-semi style existence test: the distinct tenant ids of ``sales``
    are reduced map-side before the join.
    """
    present = sales.select("user_id").distinct().withColumn("_hit", F.lit(True))
    return (tenants.join(present, "user_id", "left")
            .select("user_id", F.coalesce("_hit", F.lit(False)).alias("has_records")))


# Filter name -> (column, default for null) for case-insensitive equality.
DIM_FILTERS = {
    "store": ("store_name", ""),
    "region": ("region", ""),
    "country": ("country", LEDGER_DEFAULT_COUNTRY),
    "state": ("state", ""),
    "city": ("city", ""),
    "product_category": ("category", ""),
    "product": ("product_name", ""),
    "brand": ("brand", ""),
    "supplier": ("supplier", ""),
    "customer_type": ("customer_type", ""),
    "gender": ("gender", ""),
    "sales_channel": ("sales_channel", ""),
    "payment_method": ("payment_method", ""),
}


def _col_or_empty(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december"]


def calendar_ranges(filters: dict, years: range) -> list[tuple[dt.date, dt.date]] | None:
    """F18-F20 as date ranges [from, to): the months that year, quarter and month leave of
    the years given, joined where they follow one another. None without such a filter or
    where one of them names no calendar unit."""
    f = {k: str(v) for k, v in filters.items() if k in ("year", "quarter", "month") and v not in (None, "")}
    if not f:
        return None
    months = set(range(1, 13))
    if "quarter" in f:
        if f["quarter"] not in ("Q1", "Q2", "Q3", "Q4"):
            return None
        q = int(f["quarter"][1])
        months &= {3 * q - 2, 3 * q - 1, 3 * q}
    if "month" in f:
        if f["month"].lower() not in MONTHS:
            return None
        months &= {MONTHS.index(f["month"].lower()) + 1}
    if "year" in f:
        if not (f["year"].isdigit() and 1 <= int(f["year"]) < 9999):
            return None
        years = [int(f["year"])]
    out: list[tuple[dt.date, dt.date]] = []
    for y in years:
        for m in sorted(months):
            start, end = dt.date(y, m, 1), dt.date(y + m // 12, m % 12 + 1, 1)
            if out and out[-1][1] == start:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


def calendar_condition(df: DataFrame, filters: dict) -> Column | None:
    """F18-F20 as comparisons of the date itself, which a Parquet scan prunes by. Without a
    year, the table's least and greatest date bound the years (one aggregate of the date)."""
    years = range(0)
    f = {k: v for k, v in filters.items() if v not in (None, "")}
    if "year" not in f and calendar_ranges(f, range(1, 2)) is not None:
        least, greatest = df.agg(F.year(F.min("date")), F.year(F.max("date"))).first()
        if least is None:
            return None
        years = range(least, greatest + 1)
    ranges = calendar_ranges(f, years)
    if ranges is None:
        return None
    at = lambda d: F.to_timestamp(F.lit(d.isoformat()))
    out = F.lit(False)
    for i, (start, end) in enumerate(ranges):
        own = (F.col("date") >= at(start)) & (F.col("date") < at(end))
        out = own if i == 0 else out | own
    return out


def filter_conditions(df: DataFrame, filters: dict) -> list[Column]:
    """F1-F24 as a list of Columns; empty or missing values switch a filter off."""
    f = {k: v for k, v in (filters or {}).items() if v not in (None, "")}
    conds: list[Column] = []
    d = F.col("date")
    if "start_date" in f:   # F1: rows without a valid date pass
        conds.append(d.isNull() | (d >= F.to_timestamp(F.lit(f["start_date"]))))
    if "end_date" in f:     # F2
        conds.append(d.isNull() | (d <= F.to_timestamp(F.lit(f["end_date"]))))
    if "business_category" in f:   # F3
        conds.append(ci_equals(F.coalesce(_col_or_empty(df, "category"),
                                          _col_or_empty(df, "business_category")),
                               f["business_category"]))
    for key, (column, null_as) in DIM_FILTERS.items():   # F4-F16
        if key in f:
            conds.append(ci_equals(_col_or_empty(df, column), f[key], null_as))
    if "inventory_status" in f:    # F17: tier derived from the stock level
        status = (_col_or_empty(df, "inventory_status") if "inventory_status" in df.columns
                  else stock_tier("inventory_level"))
        conds.append(ci_equals(status, f["inventory_status"]))
    calendar = calendar_condition(df, f)
    if calendar is not None:       # F18-F20: ranges of the date
        conds.append(calendar)
    else:
        if "year" in f:            # F18
            conds.append(F.year(d).cast("string") == F.lit(str(f["year"])))
        if "quarter" in f:         # F19
            conds.append(F.concat(F.lit("Q"), F.quarter(d).cast("string")) == F.lit(f["quarter"]))
        if "month" in f:           # F20
            conds.append(F.lower(F.date_format(d, "MMMM")) == F.lit(str(f["month"]).lower()))
    if "day" in f:                 # F21
        conds.append(F.lower(F.date_format(d, "EEEE")) == F.lit(str(f["day"]).lower()))
    if "week" in f:                # F22 (declared but unused upstream; ISO week here)
        conds.append(F.weekofyear(d) == F.lit(int(f["week"])))
    if f.get("low_stock"):         # F23
        conds.append(F.col("inventory_level") < LOW_STOCK_THRESHOLD)
    if "user_id" in f:             # F24
        conds.append(F.col("user_id") == F.lit(f["user_id"]))
    return conds


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    return df.where(all_of(filter_conditions(df, filters)))


PICKER_DIMS = [("category", "category"), ("product", "product_name"),
               ("brand", "brand"), ("supplier", "supplier")]


def filter_options(df: DataFrame, by=("user_id",)) -> DataFrame:
    """sorted distinct values per picker list, null and empty dropped.

    One scan: the four columns are unpivoted, then de-duplicated together.
    """
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(dim).alias("dim"), F.col(c).cast("string").alias("value"))
        for dim, c in PICKER_DIMS])).alias("o")).select(*by, "o.dim", "o.value")
    return (long.where(F.col("value").isNotNull() & (F.col("value") != ""))
            .distinct().orderBy(*by, "dim", "value"))
