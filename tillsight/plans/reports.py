"""Report tables (K7): executive summary, transactions, forecast.

The reference renders these into a workbook; here they are three lazy
DataFrames (one row set per tenant) that any writer can export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import currency, thousands
from ..operators.metrics import kpi_summary
from ..schema import ANALYTICS_COLUMNS

# Metric labels of the summary sheet, in sheet order.
SUMMARY_METRICS = [
    ("Total Revenue", "total_revenue", "currency"),
    ("Total Units Sold", "total_sales", "count"),
    ("Total Customers", "total_customers", "count"),
    ("Total Products Tracked", "total_products", "count"),
    ("Total Profit", "total_profit", "currency"),
    ("Net Profit Margin (%)", "profit_margin", "percent"),
    ("Average Stock Inventory Level", "avg_inventory", "count"),
    ("Month-Over-Month Sales Growth (%)", "sales_growth", "percent"),
]


def _render(c: str, kind: str):
    if kind == "currency":
        return currency(c)
    if kind == "count":
        return thousands(F.col(c).cast("bigint"))
    return F.concat(F.col(c).cast("string"), F.lit("%"))


def report_summary(sales: DataFrame) -> DataFrame:
    """The eight KPI rows per tenant as (position, metric, value text): the
    KPI row unpivoted with one ``explode`` (no per-metric job)."""
    k = kpi_summary(sales)
    items = [F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("metric"), _render(c, kind).alias("value"))
             for i, (label, c, kind) in enumerate(SUMMARY_METRICS)]
    return k.select("user_id", F.explode(F.array(*items)).alias("m")).select(
        "user_id", F.col("m.position").cast("bigint").alias("position"), "m.metric", "m.value")


def report_transactions(sales: DataFrame) -> DataFrame:
    """Every tenant's 14 analytics columns, dates as ``yyyy-MM-dd``."""
    cols = [F.date_format("date", "yyyy-MM-dd").alias("date") if c == "date" else F.col(c)
            for c in ANALYTICS_COLUMNS]
    return sales.select("user_id", *cols)


def report_forecast(forecast: DataFrame) -> DataFrame:
    """Date and predicted revenue rows (from any forecast frame)."""
    return forecast.select("user_id", F.date_format("date", "yyyy-MM-dd").alias("date"),
                           F.col("predicted").alias("predicted_sales_revenue"))


def report_tables(sales: DataFrame, forecast: DataFrame, recommendations: DataFrame) -> dict[str, DataFrame]:
    return {"summary": report_summary(sales), "recommendations": recommendations,
            "transactions": report_transactions(sales), "forecast": report_forecast(forecast)}


def write_report(tables: dict[str, DataFrame], base: str, fmt: str = "parquet") -> None:
    """One folder per table, partitioned by tenant."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).partitionBy("user_id").save(f"{base}/{name}")
