"""Canonical sales schema and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical sales fact: one row per transaction line.
SALES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("dataset_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("date", T.TimestampType(), False),
    T.StructField("product_name", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("sub_category", T.StringType(), True),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("unit_price", T.DoubleType(), False),
    T.StructField("total_sales", T.DoubleType(), False),
    T.StructField("total_profit", T.DoubleType(), False),
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("customer_segment", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("store_name", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("supplier", T.StringType(), True),
    T.StructField("customer_type", T.StringType(), True),
    T.StructField("payment_method", T.StringType(), True),
    T.StructField("sales_channel", T.StringType(), True),
    T.StructField("order_id", T.StringType(), True),
    T.StructField("inventory_level", T.IntegerType(), True),
])

SALES_COLUMNS = [f.name for f in SALES_SCHEMA.fields]

# The 14 columns of the analytics frame.
ANALYTICS_COLUMNS = [
    "id", "dataset_id", "date", "product_name", "category", "sub_category",
    "quantity", "unit_price", "total_sales", "total_profit", "customer_id",
    "customer_segment", "region", "inventory_level",
]

# Optional text columns that pass through the mapping step unfilled.
PASSTHROUGH_COLUMNS = [
    "store_name", "country", "state", "city", "brand", "supplier",
    "customer_type", "payment_method", "sales_channel", "order_id",
]

# ---------------------------------------------------------------------------
# These must equal the reference's for equal results.
# ---------------------------------------------------------------------------

# Header synonyms per standard column, in lookup order (first match wins).
COLUMN_SYNONYMS = {
    "date": ["date", "order date", "order_date", "transaction date", "sale date", "time", "timestamp", "period"],
    "product_name": ["product", "product name", "product_name", "item", "item name", "sku", "name", "title", "description"],
    "category": ["category", "product category", "product_category", "department", "dept", "sector", "division"],
    "sub_category": ["sub-category", "sub category", "sub_category", "sub category name", "class", "subclass"],
    "quantity": ["quantity", "qty", "units", "units sold", "volume", "count", "amount sold", "quantity ordered"],
    "unit_price": ["unit price", "unit_price", "price", "rate", "cost_per_unit", "unit cost", "price per unit"],
    "total_sales": ["sales", "revenue", "total sales", "total_sales", "sales_amount", "turnover", "amount", "total revenue"],
    "total_profit": ["profit", "margin", "earnings", "net_profit", "total profit", "net profit"],
    "customer_id": ["customer id", "customer_id", "client id", "client_id", "user id", "user_id", "customer", "customer name", "client"],
    "customer_segment": ["segment", "customer segment", "customer_segment", "type", "tier", "class_group"],
    "region": ["region", "location", "area", "territory", "market"],
    "store_name": ["store", "store name", "store_name", "outlet", "branch"],
    "country": ["country", "nation"],
    "state": ["state", "province"],
    "city": ["city", "town"],
    "brand": ["brand", "make", "manufacturer"],
    "supplier": ["supplier", "vendor", "supplier partner"],
    "customer_type": ["customer type", "customer_type", "customer_profile"],
    "payment_method": ["payment method", "payment_method", "payment", "pay_mode"],
    "sales_channel": ["channel", "sales channel", "sales_channel"],
    "order_id": ["order id", "order_id", "transaction_id", "tx_id"],
    "inventory_level": ["inventory", "inventory level", "inventory_level", "stock", "stock level", "stock_level", "quantity in stock", "qty in stock", "available stock"],
}

# Text values that count as missing after trimming (pandas string forms of
# missing values), plus the placeholder they are replaced with first.
NULL_TOKENS = ["nan", "", "None", "NULL", "Unknown"]
MODE_FALLBACK = "Other"

# Header substrings that exempt a numeric column from outlier capping.
ID_LIKE_HEADER_PARTS = ["id", "zip", "code"]
IQR_K = 1.5

# Imputation defaults of the mapping step.
DEFAULT_QUANTITY = 1
DEFAULT_UNIT_PRICE = 10.0
NONPOSITIVE_UNIT_PRICE = 1.0
PROFIT_RATE = 0.15
DEFAULT_INVENTORY = 100
SYNTH_INVENTORY_LOW, SYNTH_INVENTORY_HIGH = 50, 1000
LABEL_DEFAULTS = {
    "product_name": "Generic Product",
    "category": "General",
    "customer_id": "CUST-UNKNOWN",
    "customer_segment": "Standard",
    "region": "Global",
}

# Upload admission.
ALLOWED_EXTENSIONS = [".csv", ".xlsx", ".xls"]
MAX_UPLOAD_MB = 20

# Stock thresholds.
LOW_STOCK_THRESHOLD = 50
CRITICAL_STOCK_THRESHOLD = 8

# Customer segment names, in rank order of mean monetary value.
SEGMENT_NAMES = ["Champions", "Loyal Customers", "At Risk", "New/Promising"]
DEFAULT_SEGMENT = "Standard"
RULE_Q75_SINGLE, RULE_Q25_SINGLE = 1000.0, 100.0
RULE_LOYAL_FREQUENCY = 5
RULE_AT_RISK_RECENCY = 60

# Ledger (browser) fallbacks.
LEDGER_PROFIT_RATE = 0.22
LEDGER_DEFAULT_STOCK = 120
LEDGER_DEFAULT_COUNTRY = "India"
LEDGER_PAGE_SIZE = 8
PROJECTION_FACTOR = 1.15

# Forecast.
FORECAST_HORIZON = 30
MIN_SERIES_POINTS = 10
LAGS = [1, 2, 7, 14]
ROLL_WINDOWS = [7, 14]
FEATURE_COLUMNS = [
    "day_of_week", "day_of_month", "month", "year",
    "sales_lag_1", "sales_lag_2", "sales_lag_7", "sales_lag_14",
    "sales_roll_mean_7", "sales_roll_std_7", "sales_roll_mean_14", "sales_roll_std_14",
]
FALLBACK_BASE, FALLBACK_TREND, FALLBACK_AMPLITUDE, FALLBACK_FLOOR = 5000.0, 20.0, 1000.0, 100.0

# Insight thresholds and general tips.
TREND_INSIGHT_PCT = 5.0
CHAMPIONS_INSIGHT_PCT = 15.0
AT_RISK_INSIGHT_PCT = 25.0
GENERAL_TIPS = [
    "Monitor daily inventory levels to prevent stockouts of top-performing items.",
    "Run seasonal promotions during weekends to capture maximum local demand.",
    "Segment customer email newsletters based on their past purchase categories.",
]

# Assistant intent keywords, in rule order (first group that matches wins).
INTENT_KEYWORDS = [
    ("sales", ["sales", "revenue", "income", "earning", "turnover"]),
    ("profit", ["profit", "margin", "earnings"]),
    ("product", ["product", "item", "sku"]),
    ("customer", ["customer", "client", "segment", "buyer"]),
    ("inventory", ["inventory", "stock", "warehouse"]),
    ("category", ["category", "categories", "department", "sector"]),
    ("region", ["region", "regions", "location", "city", "country"]),
    ("forecast", ["forecast", "predict", "future", "ml"]),
]
WORST_KEYWORDS = ["worst", "low", "least"]
CURRENCY_SYMBOL = "₹"

WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
