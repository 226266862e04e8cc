"""Rule-based recommendations (R1-R6) as small per-tenant frames, unioned.

Inputs are already-aggregated frames (low-stock list, forecast, segment
counts), so every rule is a projection over a handful of rows per tenant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import AT_RISK_INSIGHT_PCT, CHAMPIONS_INSIGHT_PCT, GENERAL_TIPS, TREND_INSIGHT_PCT

TENANT = ("user_id",)
COLUMNS = ["user_id", "priority", "rule", "message"]


def low_stock_insights(low_stock: DataFrame) -> DataFrame:
    """One message per listed low-stock product (A26 output)."""
    return low_stock.select(
        "user_id", F.col("rank").cast("bigint").alias("priority"), F.lit("low_stock").alias("rule"),
        F.format_string("CRITICAL: Stock for '%s' is critically low (%d units remaining). Reorder immediately.",
                        F.col("product_name"), F.col("inventory_level").cast("bigint")).alias("message"))


def trend_insights(change: DataFrame, threshold: float = TREND_INSIGHT_PCT) -> DataFrame:
    """Projected rise (> +5 %) or fall (< -5 %) between the halves of
    the forecast horizon (``trend_change`` output)."""
    pct = F.round("pct_change", 4)
    up = change.where(F.col("pct_change") > threshold).select(
        "user_id", F.lit(10).cast("bigint").alias("priority"), F.lit("sales_trend").alias("rule"),
        F.format_string("SALES INSIGHT: Sales are projected to increase by %.1f%% over the next 15 days. "
                        "Restock high-demand products.", pct).alias("message"))
    down = change.where(F.col("pct_change") < -threshold).select(
        "user_id", F.lit(10).cast("bigint").alias("priority"), F.lit("sales_trend").alias("rule"),
        F.format_string("MARKET WARNING: Projected sales show a decrease of %.1f%% in the second half of the month. "
                        "Consider promotional bundling.", F.abs(pct)).alias("message"))
    return up.unionByName(down)


def segment_insights(counts: DataFrame) -> DataFrame:
    """Champions above 15 % or At Risk above 25 % of customers
    (``segment_counts`` output)."""
    s = counts.groupBy("user_id").agg(
        F.sum("customers").alias("total"),
        F.sum(F.when(F.col("segment") == "Champions", F.col("customers")).otherwise(0)).alias("champ"),
        F.sum(F.when(F.col("segment") == "At Risk", F.col("customers")).otherwise(0)).alias("risk"))
    s = s.where(F.col("total") > 0).select(
        "user_id", F.round(F.col("champ") / F.col("total") * 100, 4).alias("cp"),
        F.round(F.col("risk") / F.col("total") * 100, 4).alias("rp"))
    champ = s.where(F.col("cp") > CHAMPIONS_INSIGHT_PCT).select(
        "user_id", F.lit(20).cast("bigint").alias("priority"), F.lit("champions").alias("rule"),
        F.format_string("MARKETING: High density of Champions (%.1f%%). Launch a premium VIP early-access campaign "
                        "to maximize margins.", F.col("cp")).alias("message"))
    risk = s.where(F.col("rp") > AT_RISK_INSIGHT_PCT).select(
        "user_id", F.lit(21).cast("bigint").alias("priority"), F.lit("at_risk").alias("rule"),
        F.format_string("RETENTION ALERT: At-Risk customers represent %.1f%% of your base. Run a win-back discount "
                        "campaign this weekend.", F.col("rp")).alias("message"))
    return champ.unionByName(risk)


def recommendations(tenants: DataFrame, *rule_frames: DataFrame) -> DataFrame:
    """U4 + R6: all fired rules; tenants where none fired get the three
    general tips."""
    fired = rule_frames[0].select(*COLUMNS)
    for f in rule_frames[1:]:
        fired = fired.unionByName(f.select(*COLUMNS))
    quiet = tenants.select("user_id").distinct().join(fired.select("user_id").distinct(), "user_id", "left_anti")
    tips = quiet.select("user_id", F.posexplode(F.array(*[F.lit(t) for t in GENERAL_TIPS])).alias("i", "message"))
    tips = tips.select("user_id", (F.col("i") + 90).cast("bigint").alias("priority"),
                       F.lit("general").alias("rule"), "message")
    return fired.unionByName(tips)
