"""Independent DuckDB SQL statements of each registered query.

Each statement rebuilds the fixture it needs as a CTE over the raw test
tables, then states the operator's formula in plain SQL. Money is summed as
DECIMAL and cast to DOUBLE last, so results do not depend on summation
order. Every ordering names NULLS FIRST/LAST explicitly.
"""

from __future__ import annotations

SALES_CTE = """sales AS (
  SELECT ((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber AS id,
         CAST(year(o_orderdate) AS BIGINT) AS dataset_id,
         CAST(l_suppkey % 8 AS BIGINT) AS user_id,
         o_orderdate AS date,
         p_name || ' #' || CAST(p_partkey AS VARCHAR) AS product_name,
         p_type AS category,
         p_type || ' / ' || p_brand AS sub_category,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(p_retailprice AS DOUBLE) AS unit_price,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS total_sales,
         CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))
              * CAST(0.15 AS DECIMAL(3,2)) AS DECIMAL(20,6)) AS total_profit,
         c_name AS customer_id,
         c_mktsegment AS customer_segment,
         r_name AS region,
         'Store ' || CAST(l_suppkey % 20 AS VARCHAR) AS store_name,
         n_name AS country,
         CAST(NULL AS VARCHAR) AS state,
         CAST(NULL AS VARCHAR) AS city,
         p_brand AS brand,
         s_name AS supplier,
         CASE WHEN c_acctbal < 0 THEN 'At Risk' WHEN c_acctbal < 3000 THEN 'New/Promising'
              WHEN c_acctbal < 7000 THEN 'Loyal Customers' ELSE 'Champions' END AS customer_type,
         CASE l_linenumber % 3 WHEN 0 THEN 'UPI' WHEN 1 THEN 'Credit Card' ELSE 'NetBanking' END AS payment_method,
         CASE WHEN l_orderkey % 2 = 0 THEN 'Online' ELSE 'In-Store' END AS sales_channel,
         CAST(o_orderkey AS VARCHAR) AS order_id,
         CAST((l_partkey*37 + l_linenumber*11) % 950 AS INTEGER) AS inventory_level
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey
       JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)"""

DIRTY_CTE = """dirty_sales AS (
  SELECT row_seq, order_date, qty, category, sales, customer_id FROM (
    SELECT ((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber AS row_seq,
           CASE WHEN l_partkey % 17 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
           CASE WHEN l_partkey % 13 = 0 THEN CAST(NULL AS DOUBLE)
                WHEN l_partkey % 101 = 0 THEN l_quantity * 40 ELSE l_quantity END AS qty,
           CASE WHEN l_suppkey % 19 = 0 THEN CAST(NULL AS VARCHAR)
                WHEN l_suppkey % 7 = 0 THEN '  ' || p_type || '  '
                WHEN l_suppkey % 23 = 0 THEN 'nan' ELSE p_type END AS category,
           CASE WHEN l_orderkey % 29 = 0 THEN 'n.a.'
                ELSE CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS VARCHAR) END AS sales,
           c_name AS customer_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
         JOIN customer ON o_custkey = c_custkey
    UNION ALL
    SELECT ((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber,
           strftime(o_orderdate, '%Y-%m-%d'), l_quantity, p_type,
           CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS VARCHAR),
           c_name
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
         JOIN customer ON o_custkey = c_custkey
    WHERE l_orderkey % 10 = 1))"""

MESSAGES_CTE = """messages AS (
  SELECT CAST(p_partkey AS BIGINT) AS msg_id, CAST(p_partkey % 8 AS BIGINT) AS user_id,
         CASE p_partkey % 9
           WHEN 0 THEN 'What is our revenue for ' || p_type || '?'
           WHEN 1 THEN 'Sales in ASIA please'
           WHEN 2 THEN 'What is our total revenue?'
           WHEN 3 THEN 'How much profit did we make?'
           WHEN 4 THEN 'What are our best selling products?'
           WHEN 5 THEN 'Show me a breakdown of our customer segments.'
           WHEN 6 THEN 'Are there any low stock inventory warnings?'
           WHEN 7 THEN 'Which categories perform the best?'
           ELSE 'Hello there' END AS text
  FROM part)"""


def with_sales(body: str, *extra: str) -> str:
    ctes = ",\n".join([SALES_CTE, *extra])
    return f"WITH {ctes}\n{body}"


GROWTH_CTES = [
    """m AS (SELECT user_id, date_trunc('month', date) AS ms, sum(total_sales) AS s FROM sales GROUP BY 1, 2)""",
    """ml AS (SELECT user_id, ms, s, lag(s) OVER (PARTITION BY user_id ORDER BY ms) AS prev FROM m)""",
    """g AS (SELECT user_id, ms, s AS cur, prev,
                 CASE WHEN prev > 0 THEN round(CAST(s - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100, 2)
                      ELSE 0.0 END AS sales_growth
          FROM ml QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ms DESC) = 1)""",
]


def pct(num: str, den: str) -> str:
    return (f"CASE WHEN CAST({den} AS DOUBLE) > 0 THEN round(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100, 2)"
            f" ELSE 0.0 END")


ORACLE: dict[str, str] = {}

ORACLE["sales_fact"] = with_sales("""
SELECT id, dataset_id, user_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, product_name, category, sub_category,
       CAST(quantity AS BIGINT) AS quantity, unit_price, CAST(total_sales AS DOUBLE) AS total_sales,
       CAST(total_profit AS DOUBLE) AS total_profit, customer_id, customer_segment, region, store_name, country,
       state, city, brand, supplier, customer_type, payment_method, sales_channel, order_id,
       CAST(inventory_level AS BIGINT) AS inventory_level
FROM sales""")

ORACLE["scan_tenant"] = with_sales("""
SELECT id, dataset_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, product_name, category, sub_category,
       CAST(quantity AS BIGINT) AS quantity, unit_price, CAST(total_sales AS DOUBLE) AS total_sales,
       CAST(total_profit AS DOUBLE) AS total_profit, customer_id, customer_segment, region,
       CAST(inventory_level AS BIGINT) AS inventory_level
FROM sales WHERE user_id = 3""")

ORACLE["tenant_has_records"] = with_sales("""
SELECT u.user_id, EXISTS (SELECT 1 FROM sales s WHERE s.user_id = u.user_id) AS has_records
FROM (SELECT range AS user_id FROM range(0, 10)) u""")

ORACLE["kpi_mom_growth"] = with_sales("""
SELECT user_id, strftime(ms, '%Y-%m') AS last_month, CAST(cur AS DOUBLE) AS last_month_sales,
       CAST(prev AS DOUBLE) AS prev_month_sales, sales_growth
FROM g""", *GROWTH_CTES)

ORACLE["kpi_summary"] = with_sales(f"""
SELECT b.user_id, CAST(round(rev, 2) AS DOUBLE) AS total_revenue, total_sales, total_customers, total_products,
       CAST(round(prof, 2) AS DOUBLE) AS total_profit, round(avg_inv, 2) AS avg_inventory,
       coalesce(g.sales_growth, 0.0) AS sales_growth, {pct('prof', 'rev')} AS profit_margin
FROM b LEFT JOIN g USING (user_id)""", *GROWTH_CTES, """b AS (
  SELECT user_id, sum(total_sales) AS rev, CAST(sum(quantity) AS BIGINT) AS total_sales,
         count(DISTINCT customer_id) AS total_customers, count(DISTINCT product_name) AS total_products,
         sum(total_profit) AS prof, avg(inventory_level) AS avg_inv
  FROM sales GROUP BY user_id)""")

ORACLE["tenant_kpis"] = with_sales(f"""
SELECT CAST(5 AS BIGINT) AS user_id, CAST(coalesce(round(rev, 2), 0) AS DOUBLE) AS total_revenue,
       coalesce(units, 0) AS total_sales, coalesce(cust, 0) AS total_customers, coalesce(prods, 0) AS total_products,
       CAST(coalesce(round(prof, 2), 0) AS DOUBLE) AS total_profit, coalesce(round(avg_inv, 2), 0.0) AS avg_inventory,
       coalesce((SELECT sales_growth FROM g WHERE user_id = 5), 0.0) AS sales_growth,
       {pct('prof', 'rev')} AS profit_margin
FROM (SELECT sum(total_sales) AS rev, CAST(sum(quantity) AS BIGINT) AS units, count(DISTINCT customer_id) AS cust,
             count(DISTINCT product_name) AS prods, sum(total_profit) AS prof, avg(inventory_level) AS avg_inv
      FROM sales WHERE user_id = 5)""", *GROWTH_CTES)

TREND_LABELS = {
    "trend_daily": "strftime(date, '%Y-%m-%d')",
    "trend_weekly": "strftime(date, '%Y-%m') || ' W' || CAST(CAST(ceil(day(date) / 7.0) AS BIGINT) AS VARCHAR)",
    "trend_monthly": "strftime(date, '%Y-%m')",
    "trend_quarterly": "CAST(year(date) AS VARCHAR) || ' Q' || CAST(quarter(date) AS VARCHAR)",
    "trend_yearly": "CAST(year(date) AS VARCHAR)",
}
for _k, _lbl in TREND_LABELS.items():
    ORACLE[_k] = with_sales(f"""
SELECT user_id, {_lbl} AS label, CAST(sum(total_sales) AS DOUBLE) AS value
FROM sales GROUP BY user_id, label""")

ORACLE["category_distribution"] = with_sales(f"""
SELECT user_id, category, CAST(s AS DOUBLE) AS sales, {pct('s', 't')} AS percentage
FROM (SELECT user_id, coalesce(category, 'General') AS category, sum(total_sales) AS s,
             sum(sum(total_sales)) OVER (PARTITION BY user_id) AS t
      FROM sales GROUP BY user_id, coalesce(category, 'General'))""")

for _k, _dir in [("top_products", "DESC"), ("worst_products", "ASC")]:
    ORACLE[_k] = with_sales(f"""
SELECT user_id, rank, product_name, CAST(round(s, 2) AS DOUBLE) AS sales, q AS quantity,
       CAST(round(p, 2) AS DOUBLE) AS profit
FROM (SELECT user_id, product_name, sum(total_sales) AS s, CAST(sum(quantity) AS BIGINT) AS q,
             sum(total_profit) AS p,
             row_number() OVER (PARTITION BY user_id ORDER BY sum(total_sales) {_dir}, product_name ASC) AS rank
      FROM sales GROUP BY user_id, product_name)
WHERE rank <= 5""")

ORACLE["regional_sales"] = with_sales("""
SELECT user_id, coalesce(region, store_name, 'East Coast') AS region, CAST(sum(total_sales) AS DOUBLE) AS value
FROM sales GROUP BY 1, 2""")

ORACLE["supplier_sales"] = with_sales("""
SELECT user_id, coalesce(supplier, 'Apex Logistics') AS supplier, CAST(sum(total_sales) AS DOUBLE) AS value
FROM sales GROUP BY 1, 2""")

ORACLE["customer_type_counts"] = with_sales("""
SELECT user_id, coalesce(customer_type, 'Champions') AS customer_type, count(*) AS transactions
FROM sales GROUP BY 1, 2""")

ORACLE["region_weekday_matrix"] = with_sales("""
SELECT user_id, coalesce(region, 'East Coast') AS region,
""" + ",\n".join(
    f"  coalesce(CAST(sum(total_sales) FILTER (WHERE strftime(date, '%a') = '{d}') AS DOUBLE), 0.0) AS {d.lower()}"
    for d in ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]) + """
FROM sales GROUP BY 1, 2""")

_LEDGER = """l AS (
  SELECT user_id, sum(coalesce(total_sales, 0)) AS rev,
         sum(CASE WHEN coalesce(total_profit, 0) <> 0 THEN total_profit
                  ELSE coalesce(total_sales, 0) * CAST(0.22 AS DECIMAL(3,2)) END) AS prof,
         CAST(sum(CASE WHEN coalesce(quantity, 0) <> 0 THEN quantity ELSE 1 END) AS BIGINT) AS units,
         count(*) AS orders,
         count(DISTINCT coalesce(customer_id, customer_type)) AS customers,
         count(DISTINCT product_name) AS skus,
         avg(CASE WHEN coalesce(inventory_level, 0) <> 0 THEN inventory_level ELSE 120 END) AS stock
  FROM sales GROUP BY user_id)"""

ORACLE["ledger_kpis"] = with_sales("""
SELECT user_id, CAST(rev AS DOUBLE) AS revenue, CAST(round(prof, 2) AS DOUBLE) AS profit, units, orders,
       customers, skus, round(stock, 2) AS avg_stock,
       round(CAST(rev AS DOUBLE) / orders, 2) AS avg_order_value,
       round(CAST(rev AS DOUBLE) * 1.15, 2) AS projected_revenue
FROM l""", _LEDGER)

ORACLE["avg_order_value"] = with_sales("""
SELECT user_id, round(CAST(rev AS DOUBLE) / orders, 2) AS avg_order_value FROM l""", _LEDGER)

ORACLE["projected_revenue"] = with_sales("""
SELECT user_id, round(CAST(rev AS DOUBLE) * 1.15, 2) AS projected_revenue FROM l""", _LEDGER)

ORACLE["pareto_products"] = with_sales(f"""
SELECT user_id, product_name, CAST(s AS DOUBLE) AS sales, rank, {pct('cum', 'tot')} AS cum_share,
       {pct('cum', 'tot')} <= 80.0 AS in_head
FROM (SELECT user_id, product_name, s,
             row_number() OVER (PARTITION BY user_id ORDER BY s DESC, product_name ASC) AS rank,
             sum(s) OVER (PARTITION BY user_id ORDER BY s DESC, product_name ASC
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(s) OVER (PARTITION BY user_id) AS tot
      FROM (SELECT user_id, product_name, sum(total_sales) AS s FROM sales GROUP BY 1, 2))""")

ORACLE["low_stock_latest"] = with_sales("""
SELECT user_id, rank, product_name, inventory_level FROM (
  SELECT user_id, product_name, CAST(lvl AS BIGINT) AS inventory_level,
         row_number() OVER (PARTITION BY user_id ORDER BY lvl ASC, product_name ASC) AS rank
  FROM (SELECT user_id, product_name, arg_max(inventory_level, (id, inventory_level)) AS lvl
        FROM sales WHERE inventory_level < 50 GROUP BY 1, 2))
WHERE rank <= 3""")

ORACLE["stock_tiers"] = with_sales(f"""
SELECT user_id, tier, rows, {pct('rows', 'tot')} AS share FROM (
  SELECT user_id, tier, count(*) AS rows, sum(count(*)) OVER (PARTITION BY user_id) AS tot
  FROM (SELECT user_id, CASE WHEN inventory_level < 8 THEN 'critical' WHEN inventory_level < 50 THEN 'low'
                             ELSE 'healthy' END AS tier FROM sales)
  GROUP BY 1, 2)""")

ORACLE["product_matrix"] = with_sales("""
SELECT user_id, product_name, round(avg(unit_price), 4) AS avg_unit_price,
       CAST(sum(total_sales) AS DOUBLE) AS sales, CAST(sum(quantity) AS BIGINT) AS quantity
FROM sales GROUP BY 1, 2""")

ORACLE["event_funnel"] = f"""
WITH p AS (
  SELECT event_type AS stage, count(DISTINCT (user_id, CAST(ts AS DATE))) AS pairs,
         CAST(list_position(['view', 'click', 'signup', 'purchase'], event_type) AS BIGINT) AS stage_order
  FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY event_type)
SELECT stage, stage_order, pairs,
       CASE WHEN lag(pairs) OVER (ORDER BY stage_order) IS NULL THEN 100.0
            ELSE {pct('pairs', 'lag(pairs) OVER (ORDER BY stage_order)')} END AS conversion
FROM p"""

ORACLE["seasonal_months"] = with_sales("""
SELECT user_id, CAST(month(ms) AS BIGINT) AS month, round(avg(CAST(s AS DOUBLE)), 2) AS avg_monthly_sales,
       count(*) AS years
FROM (SELECT user_id, date_trunc('month', date) AS ms, sum(total_sales) AS s FROM sales GROUP BY 1, 2)
GROUP BY 1, 2""")


# --- filters, ledger, set operations ------------------------------------------

_FILTER_OUT = "SELECT id, user_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, category, CAST(total_sales AS DOUBLE) AS total_sales FROM sales"
ORACLE["filter_date_range"] = with_sales(_FILTER_OUT + """
WHERE (date IS NULL OR date >= TIMESTAMP '1996-01-01') AND (date IS NULL OR date <= TIMESTAMP '1998-12-31')""")
ORACLE["filter_dims_ci"] = with_sales(_FILTER_OUT + """
WHERE lower(coalesce(region, '')) = 'asia' AND lower(coalesce(country, 'India')) = 'nation_7'
  AND lower(coalesce(payment_method, '')) = 'upi' AND lower(coalesce(sales_channel, '')) = 'online'""")
ORACLE["filter_calendar"] = with_sales(_FILTER_OUT + """
WHERE CAST(year(date) AS VARCHAR) = '1997' AND 'Q' || CAST(quarter(date) AS VARCHAR) = 'Q2'
  AND lower(monthname(date)) = 'may' AND lower(dayname(date)) = 'friday'""")
ORACLE["filter_low_stock"] = with_sales(_FILTER_OUT + " WHERE inventory_level < 50")
ORACLE["filter_product"] = with_sales(_FILTER_OUT + """
WHERE lower(product_name) = (SELECT lower(min(product_name)) FROM sales)""")
ORACLE["filter_supplier_category"] = with_sales(_FILTER_OUT + """
WHERE lower(coalesce(supplier, '')) = 'supplier#000000003' AND lower(coalesce(category, '')) = 'economy'""")
ORACLE["filter_state_city"] = with_sales(_FILTER_OUT + """
WHERE lower(coalesce(region, '')) = 'asia' AND lower(coalesce(country, '')) = 'nation_7'""")
ORACLE["filter_all_combined"] = with_sales(_FILTER_OUT + """
WHERE (date IS NULL OR date >= TIMESTAMP '1995-06-01') AND (date IS NULL OR date <= TIMESTAMP '2000-12-31')
  AND lower(coalesce(category, '')) = 'medium' AND lower(coalesce(brand, '')) = 'brand#4'
  AND lower(coalesce(customer_type, '')) = 'champions' AND lower(coalesce(store_name, '')) = 'store 4'
  AND (CASE WHEN inventory_level < 8 THEN 'critical' WHEN inventory_level < 50 THEN 'low' ELSE 'healthy' END) = 'healthy'""")

ORACLE["filter_options"] = with_sales("""
SELECT DISTINCT user_id, dim, value FROM (
  SELECT user_id, 'category' AS dim, category AS value FROM sales
  UNION ALL SELECT user_id, 'product', product_name FROM sales
  UNION ALL SELECT user_id, 'brand', brand FROM sales
  UNION ALL SELECT user_id, 'supplier', supplier FROM sales)
WHERE value IS NOT NULL AND value <> ''""")

ORACLE["ledger_sorted"] = with_sales("""
SELECT id, user_id, customer_id, product_name, CAST(total_sales AS DOUBLE) AS total_sales,
       row_number() OVER (PARTITION BY user_id ORDER BY lower(coalesce(customer_id, '')) DESC NULLS LAST, id ASC NULLS FIRST,
                          customer_id ASC NULLS FIRST, product_name ASC NULLS FIRST, total_sales ASC NULLS FIRST) AS pos
FROM sales""")

_PAGE = """p AS (SELECT id, user_id, product_name, CAST(total_sales AS DOUBLE) AS total_sales,
                 row_number() OVER (PARTITION BY user_id ORDER BY {key}, id ASC NULLS FIRST,
                                    product_name ASC NULLS FIRST, total_sales ASC NULLS FIRST) AS pos,
                 count(*) OVER (PARTITION BY user_id) AS n
          FROM sales),
  b AS (SELECT DISTINCT user_id, n, (cur - 1) * 8 + 1 AS lo, cur * 8 AS hi FROM
        (SELECT user_id, n, least({page}, greatest(CAST(ceil(n / 8.0) AS BIGINT), 1)) AS cur FROM p))"""
_PAGE_BODY = """
SELECT id, p.user_id, product_name, total_sales, pos, printf('%d to %d of %d', lo, least(hi, b.n), b.n) AS caption
FROM p JOIN b ON p.user_id = b.user_id WHERE pos BETWEEN lo AND hi"""
ORACLE["ledger_page"] = with_sales(_PAGE_BODY, _PAGE.format(key="total_sales ASC NULLS FIRST", page=3))
ORACLE["ledger_page_clamped"] = with_sales(
    _PAGE_BODY, _PAGE.format(key="lower(coalesce(product_name, '')) ASC NULLS FIRST", page=10 ** 9))

ORACLE["ledger_page_deep"] = with_sales(_PAGE_BODY, _PAGE.format(
    key="lower(coalesce(product_name, '')) ASC NULLS FIRST",
    page="(SELECT count(*) * 3 // (32 * count(DISTINCT user_id)) + 1 FROM sales)"))

ORACLE["distinct_dims"] = with_sales("""
SELECT DISTINCT user_id, dim, value FROM (
  SELECT user_id, 'category' AS dim, category AS value FROM sales
  UNION ALL SELECT user_id, 'region', region FROM sales
  UNION ALL SELECT user_id, 'product', product_name FROM sales
  UNION ALL SELECT user_id, 'customer', customer_id FROM sales)
WHERE value IS NOT NULL""")

ORACLE["union_datasets"] = with_sales("""
SELECT user_id, dataset_id, count(*) AS rows, count(*) FILTER (WHERE brand IS NULL) AS brand_missing FROM (
  SELECT user_id, dataset_id, brand FROM sales WHERE dataset_id % 2 = 0
  UNION ALL SELECT user_id, dataset_id, NULL FROM sales WHERE dataset_id % 2 = 1)
GROUP BY 1, 2""")

# --- time series -----------------------------------------------------------------

DAILY_CTE = """daily AS (SELECT user_id, CAST(date AS DATE) AS day, sum(total_sales) AS total_sales FROM sales GROUP BY 1, 2)"""
DENSE_CTE = """dense AS (
  SELECT c.user_id, c.day, coalesce(d.total_sales, CAST(0 AS DECIMAL(38,4))) AS total_sales
  FROM (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
        FROM daily GROUP BY user_id) c
  LEFT JOIN daily d ON c.user_id = d.user_id AND c.day = d.day)"""


def _feats(src: str, part: str) -> str:
    w = f"PARTITION BY {part} ORDER BY day"
    lags = ",\n".join(f"lag(CAST(total_sales AS DOUBLE), {k}) OVER ({w}) AS sales_lag_{k}" for k in (1, 2, 7, 14))
    rolls = []
    for n in (7, 14):
        fr = f"({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        full = f"count(total_sales) OVER {fr} = {n}"
        units = f"CAST(sum(total_sales) OVER {fr} * 10000 AS HUGEINT)"
        rolls.append(f"CASE WHEN {full} THEN CAST(({units} * 2 + {n}) // {2 * n} AS DOUBLE) / 10000.0 END"
                     f" AS sales_roll_mean_{n}")
        rolls.append(f"CASE WHEN {full} THEN round(stddev_samp(CAST(total_sales AS DOUBLE)) OVER {fr}, 4) END AS sales_roll_std_{n}")
    cal = ("CAST(isodow(day) - 1 AS BIGINT) AS day_of_week, CAST(day(day) AS BIGINT) AS day_of_month, "
           "CAST(month(day) AS BIGINT) AS month, CAST(year(day) AS BIGINT) AS year")
    return f"SELECT {part}, day, total_sales, {cal},\n{lags},\n" + ",\n".join(rolls) + f"\nFROM {src}"


_FEATURE_NAMES = ["sales_lag_1", "sales_lag_2", "sales_lag_7", "sales_lag_14", "sales_roll_mean_7",
                  "sales_roll_std_7", "sales_roll_mean_14", "sales_roll_std_14"]
_DAY_OUT = "strftime(day, '%Y-%m-%d') AS day"

ORACLE["ts_daily"] = with_sales(f"SELECT user_id, {_DAY_OUT}, CAST(total_sales AS DOUBLE) AS total_sales FROM daily",
                                DAILY_CTE)
ORACLE["ts_sufficiency"] = with_sales("""
SELECT user_id, product_name, count(DISTINCT date) AS points,
       CASE WHEN count(DISTINCT date) >= 10 THEN 'ok' ELSE 'insufficient_data' END AS status
FROM sales GROUP BY 1, 2""")
ORACLE["ts_daily_dense"] = with_sales(
    f"SELECT user_id, {_DAY_OUT}, CAST(total_sales AS DOUBLE) AS total_sales FROM dense", DAILY_CTE, DENSE_CTE)
ORACLE["ts_calendar"] = with_sales(f"""
SELECT user_id, {_DAY_OUT}, CAST(total_sales AS DOUBLE) AS total_sales, CAST(isodow(day) - 1 AS BIGINT) AS day_of_week,
       CAST(day(day) AS BIGINT) AS day_of_month, CAST(month(day) AS BIGINT) AS month, CAST(year(day) AS BIGINT) AS year
FROM dense""", DAILY_CTE, DENSE_CTE)
ORACLE["ts_lags"] = with_sales(f"""
SELECT user_id, {_DAY_OUT}, CAST(total_sales AS DOUBLE) AS total_sales, sales_lag_1, sales_lag_2, sales_lag_7, sales_lag_14
FROM f""", DAILY_CTE, DENSE_CTE, f"f AS ({_feats('dense', 'user_id')})")
ORACLE["ts_roll_mean"] = with_sales(f"SELECT user_id, {_DAY_OUT}, sales_roll_mean_7, sales_roll_mean_14 FROM f",
                                    DAILY_CTE, DENSE_CTE, f"f AS ({_feats('dense', 'user_id')})")
ORACLE["ts_roll_std"] = with_sales(f"SELECT user_id, {_DAY_OUT}, sales_roll_std_7, sales_roll_std_14 FROM f",
                                   DAILY_CTE, DENSE_CTE, f"f AS ({_feats('dense', 'user_id')})")
_FEATS_OUT = (f"user_id, {_DAY_OUT}, CAST(total_sales AS DOUBLE) AS total_sales, day_of_week, day_of_month, month, year, "
              + ", ".join(_FEATURE_NAMES))
ORACLE["ts_features"] = with_sales(
    f"SELECT {_FEATS_OUT} FROM f WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _FEATURE_NAMES),
    DAILY_CTE, DENSE_CTE, f"f AS ({_feats('dense', 'user_id')})")
ORACLE["ts_split"] = with_sales("""
SELECT user_id, strftime(day, '%Y-%m-%d') AS day,
       CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY day DESC)
                 <= greatest(least(7, CAST(floor(count(*) OVER (PARTITION BY user_id) * 0.2) AS BIGINT)), 1)
            THEN 'test' ELSE 'train' END AS split
FROM f WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in _FEATURE_NAMES),
    DAILY_CTE, DENSE_CTE, f"f AS ({_feats('dense', 'user_id')})")

_ODAILY = """odaily AS (SELECT user_id, order_id, CAST(date AS DATE) AS day, sum(total_sales) AS total_sales
                       FROM sales GROUP BY 1, 2, 3)"""
_ODENSE = """odense AS (
  SELECT c.user_id, c.order_id, c.day, coalesce(d.total_sales, CAST(0 AS DECIMAL(38,4))) AS total_sales
  FROM (SELECT user_id, order_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
        FROM odaily GROUP BY 1, 2) c
  LEFT JOIN odaily d ON c.user_id = d.user_id AND c.order_id = d.order_id AND c.day = d.day)"""
_OK = " AND ".join(f"{c} IS NOT NULL" for c in _FEATURE_NAMES)
ORACLE["ts_features_fallback"] = with_sales(f"""
SELECT user_id, order_id, {_DAY_OUT}, CAST(total_sales AS DOUBLE) AS total_sales, day_of_week, day_of_month, month, year,
""" + ",\n".join(f"CASE WHEN n_ok = 0 THEN mean ELSE {c} END AS {c}" for c in _FEATURE_NAMES) + f"""
FROM (SELECT *, ({_OK}) AS ok,
             sum(CAST(({_OK}) AS INTEGER)) OVER (PARTITION BY user_id, order_id) AS n_ok,
             avg(CAST(total_sales AS DOUBLE)) OVER (PARTITION BY user_id, order_id) AS mean
      FROM f)
WHERE ok OR n_ok = 0""", _ODAILY, _ODENSE, f"f AS ({_feats('odense', 'user_id, order_id')})")


# --- customer segments -----------------------------------------------------------

RFM_CTE = """rfm AS (
  SELECT user_id, customer_id,
         CAST(date_diff('day', last_date, max(last_date) OVER (PARTITION BY user_id)) AS BIGINT) AS recency,
         frequency, CAST(monetary AS DOUBLE) AS monetary
  FROM (SELECT user_id, customer_id, max(date) AS last_date, count(id) AS frequency, sum(total_sales) AS monetary
        FROM sales WHERE customer_id IS NOT NULL GROUP BY 1, 2))"""
RULES_CTE = """rules AS (
  SELECT r.user_id, customer_id, recency, frequency, monetary,
         CASE WHEN monetary < q25 AND recency > 60 THEN 'At Risk'
              WHEN monetary < q75 AND frequency > 5 THEN 'Loyal Customers'
              WHEN monetary >= q75 THEN 'Champions' ELSE 'Standard' END AS segment
  FROM rfm r JOIN (
    SELECT user_id,
           CASE WHEN count(*) > 1 THEN quantile_cont(monetary, 0.25) ELSE 100.0 END AS q25,
           CASE WHEN count(*) > 1 THEN quantile_cont(monetary, 0.75) ELSE 1000.0 END AS q75
    FROM rfm GROUP BY user_id) q ON r.user_id = q.user_id)"""

ORACLE["rfm"] = with_sales("SELECT * FROM rfm", RFM_CTE)
ORACLE["rfm_scaled"] = with_sales("""
SELECT user_id, customer_id, recency, frequency, monetary, """ + ",\n".join(
    f"CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) OVER (PARTITION BY user_id) > 0 THEN "
    f"round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER (PARTITION BY user_id)) / "
    f"stddev_pop(CAST({c} AS DOUBLE)) OVER (PARTITION BY user_id), 4) ELSE 0.0 END AS {c}_z"
    for c in ["recency", "frequency", "monetary"]) + "\nFROM rfm", RFM_CTE)
ORACLE["kmeans_checked"] = with_sales("""
SELECT user_id, count(*) AS customers, CAST(0 AS BIGINT) AS misplaced,
       least(4, count(DISTINCT (recency, frequency, monetary))) AS clusters, CAST(0 AS BIGINT) AS off_centre
FROM rfm GROUP BY user_id""", RFM_CTE)
ORACLE["segment_rules"] = with_sales("SELECT * FROM rules", RFM_CTE, RULES_CTE)
ORACLE["segment_counts"] = with_sales("""
SELECT coalesce(n.user_id, c.user_id) AS user_id, coalesce(n.segment, c.segment) AS segment,
       CAST(coalesce(c.customers, 0) AS BIGINT) AS customers
FROM (SELECT DISTINCT user_id, unnest(['Champions', 'Loyal Customers', 'At Risk', 'New/Promising']) AS segment
      FROM rules) n
FULL JOIN (SELECT user_id, segment, count(*) AS customers FROM rules GROUP BY 1, 2) c
  ON n.user_id = c.user_id AND n.segment = c.segment""", RFM_CTE, RULES_CTE)


# --- cleaning, mapping, imputation --------------------------------------------------

def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _tok(x: str) -> str:
    return f"CASE WHEN {_strip(x)} IN ('nan', '', 'None', 'NULL', 'Unknown') THEN NULL ELSE {_strip(x)} END"


def _mode(x: str, src: str) -> str:
    return f"(SELECT {x} FROM {src} WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC, {x} ASC LIMIT 1)"


_TXT = ["order_date", "category", "sales", "customer_id"]
CLEAN_CTES = [
    DIRTY_CTE,
    """raw AS (SELECT *, row_number() OVER (ORDER BY row_seq ASC NULLS FIRST, order_date ASC NULLS FIRST,
             qty ASC NULLS FIRST, category ASC NULLS FIRST, sales ASC NULLS FIRST, customer_id ASC NULLS FIRST) AS _row
           FROM dirty_sales)""",
    """d0 AS (SELECT row_seq, order_date, qty, category, sales, customer_id, min(_row) AS _row FROM raw GROUP BY ALL)""",
    "c_tok AS (SELECT _row, row_seq, qty, " + ", ".join(f"{_tok(c)} AS {c}" for c in _TXT) + " FROM d0)",
    """c_mean AS (SELECT _row, row_seq, CAST(coalesce(qty, (SELECT avg(qty) FROM c_tok), 0) AS DOUBLE) AS qty, """
    + ", ".join(_TXT) + " FROM c_tok)",
    "c_mode AS (SELECT _row, row_seq, qty, " + ", ".join(
        f"coalesce({c}, {_mode(c, 'c_tok')}, 'Other') AS {c}" for c in _TXT) + " FROM c_mean)",
    """q AS (SELECT quantile_cont(CAST(row_seq AS DOUBLE), 0.25) AS r1, quantile_cont(CAST(row_seq AS DOUBLE), 0.75) AS r3,
                   quantile_cont(qty, 0.25) AS q1, quantile_cont(qty, 0.75) AS q3 FROM c_mode)""",
    """c_cap AS (SELECT _row,
         CASE WHEN r3 - r1 > 0 THEN least(greatest(CAST(row_seq AS DOUBLE), r1 - 1.5 * (r3 - r1)), r3 + 1.5 * (r3 - r1))
              ELSE CAST(row_seq AS DOUBLE) END AS row_seq,
         CASE WHEN q3 - q1 > 0 THEN least(greatest(qty, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) ELSE qty END AS qty,
         order_date, category, sales, customer_id FROM c_mode, q)""",
    """mp AS (SELECT _row, order_date AS date, qty AS quantity, category, sales AS total_sales, customer_id FROM c_cap)""",
    """imp AS (SELECT _row,
         coalesce(last_value(coalesce(try_strptime(date, '%Y-%m-%d %H:%M:%S'), try_strptime(date, '%Y-%m-%dT%H:%M:%S'),
                                      try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%Y/%m/%d'),
                                      try_strptime(date, '%m/%d/%Y'), try_strptime(date, '%d-%m-%Y')) IGNORE NULLS)
                  OVER (ORDER BY _row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  TIMESTAMP '2024-01-01 00:00:00') AS date,
         CASE WHEN CAST(trunc(coalesce(quantity, 1.0)) AS INTEGER) <= 0 THEN 1
              ELSE CAST(trunc(coalesce(quantity, 1.0)) AS INTEGER) END AS quantity,
         category, total_sales AS sales_txt, customer_id FROM mp)""",
    """imp2 AS (SELECT *, coalesce(TRY_CAST(sales_txt AS DOUBLE), quantity * 10.0) AS total_sales FROM imp)""",
]


def with_clean(body: str, upto: int | None = None) -> str:
    ctes = CLEAN_CTES if upto is None else CLEAN_CTES[:upto]
    return "WITH " + ",\n".join(ctes) + "\n" + body


_D0_COLS = "_row, row_seq, qty, order_date, category, sales, customer_id"
ORACLE["clean_dedup"] = with_clean(f"SELECT {_D0_COLS} FROM d0", 3)
ORACLE["clean_numeric_profile"] = with_clean("""
SELECT * , non_null = parseable AS is_numeric FROM (
  SELECT 'row_seq' AS column, count(row_seq) AS non_null, count(row_seq) AS parseable FROM d0
  UNION ALL SELECT 'order_date', count(order_date), count(TRY_CAST(order_date AS DOUBLE)) FROM d0
  UNION ALL SELECT 'qty', count(qty), count(qty) FROM d0
  UNION ALL SELECT 'category', count(category), count(TRY_CAST(category AS DOUBLE)) FROM d0
  UNION ALL SELECT 'sales', count(sales), count(TRY_CAST(sales AS DOUBLE)) FROM d0
  UNION ALL SELECT 'customer_id', count(customer_id), count(TRY_CAST(customer_id AS DOUBLE)) FROM d0)""", 3)
ORACLE["clean_null_tokens"] = with_clean(f"SELECT {_D0_COLS} FROM c_tok", 4)
ORACLE["clean_trim"] = with_clean("SELECT _row, row_seq, qty, " + ", ".join(
    f"{_strip(c)} AS {c}" for c in _TXT) + " FROM d0", 3)
ORACLE["clean_mean_impute"] = with_clean(
    "SELECT _row, row_seq, CAST(coalesce(qty, (SELECT avg(qty) FROM d0), 0) AS DOUBLE) AS qty, "
    + ", ".join(_TXT) + " FROM d0", 3)
ORACLE["clean_mode_impute"] = with_clean("SELECT _row, row_seq, qty, " + ", ".join(
    f"coalesce({c}, {_mode(c, 'c_tok')}, 'Other') AS {c}" for c in _TXT) + " FROM c_tok", 4)
ORACLE["clean_iqr_cap"] = with_clean(f"SELECT {_D0_COLS} FROM c_cap", 8)
ORACLE["clean_profile"] = with_clean("""
SELECT 'rows' AS metric, CAST(NULL AS VARCHAR) AS column, (SELECT count(*) FROM raw) AS before,
       (SELECT count(*) FROM c_cap) AS after
""" + "".join(
    f"UNION ALL SELECT 'nulls', '{c}', (SELECT count(*) FILTER (WHERE {c} IS NULL) FROM raw),"
    f" (SELECT count(*) FILTER (WHERE {c} IS NULL) FROM c_cap)\n"
    for c in ["row_seq", "order_date", "qty", "category", "sales", "customer_id"]), 8)

_ALL = ["row_seq", "qty", "order_date", "category", "sales", "customer_id"]


def _observed_sql() -> str:
    gone = lambda c: (f"{c} IS NULL" if c in ("row_seq", "qty") else
                      f"({c} IS NULL OR {_strip(c)} IN ('nan', '', 'None', 'NULL', 'Unknown'))")
    one = lambda metric, column, value: f"SELECT '{metric}' AS metric, {column} AS column, ({value}) AS count"
    out = [one("rows_in", "NULL", "SELECT count(*) FROM raw"),
           one("duplicates", "NULL", "SELECT (SELECT count(*) FROM raw) - count(*) FROM d0"),
           one("rows_out", "NULL", "SELECT count(*) FROM d0")]
    for c in _ALL:
        out.append(one("missing", f"'{c}'", f"SELECT count(*) FROM raw WHERE {gone(c)}"))
        out.append(one("filled", f"'{c}'", f"SELECT count(*) FROM d0 WHERE {gone(c)}"))
    for c, lo, hi in (("qty", "q1", "q3"),):
        out.append(one("capped", f"'{c}'", f"SELECT count(*) FROM c_mode, q WHERE {hi} > {lo} AND ({c} < {lo} - 1.5 * "
                       f"({hi} - {lo}) OR {c} > {hi} + 1.5 * ({hi} - {lo}))"))
    out.append(one("capped", "'row_seq'", "SELECT count(*) FROM c_mode, q WHERE r3 > r1 AND (row_seq < r1 - 1.5 * "
                   "(r3 - r1) OR row_seq > r3 + 1.5 * (r3 - r1))"))
    out.append(one("unread_dates", "'date'", "SELECT count(*) FROM mp WHERE try_strptime(date, '%Y-%m-%d') IS NULL"))
    return "\nUNION ALL\n".join(out)


ORACLE["clean_profile_observed"] = with_clean(_observed_sql())

_NULLS = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in [
    "product_name", "sub_category", "unit_price", "total_profit", "customer_segment", "region", "store_name",
    "country", "state", "city", "brand", "supplier", "customer_type", "payment_method", "sales_channel",
    "order_id", "inventory_level"])
ORACLE["map_columns"] = with_clean(
    f"SELECT _row, date, quantity, category, total_sales, customer_id, {_NULLS} FROM mp", 9)
ORACLE["impute_date_ffill"] = with_clean("SELECT _row, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM imp", 10)
ORACLE["impute_date_shapes"] = """
SELECT CAST(o_custkey % 8 AS BIGINT) AS user_id, o_orderkey AS _row, strftime(CAST(o_orderdate AS DATE) + CASE o_orderkey % 12
         WHEN 8 THEN INTERVAL 1325 MINUTE WHEN 9 THEN INTERVAL 30 MINUTE WHEN 10 THEN INTERVAL 54245 SECOND
         WHEN 11 THEN INTERVAL 25 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') AS date FROM orders"""
ORACLE["clean_code_columns"] = """
SELECT c AS column, count(*) AS non_null, CASE WHEN c IN ('code', 'hex') THEN 0 WHEN c = 'one_code'
         THEN count(*) FILTER (p_partkey <> 1) ELSE count(*) END AS parseable,
       c NOT IN ('code', 'hex') AND NOT (c = 'one_code' AND count(*) FILTER (p_partkey = 1) > 0) AS is_numeric
FROM part, (VALUES ('code'), ('hex'), ('amount'), ('scaled'), ('gaps'), ('one_code')) v(c) GROUP BY c"""
ORACLE["impute_date_backfill"] = with_clean("""
SELECT _row, customer_id, strftime(TIMESTAMP '2024-01-01 00:00:00' - to_days(CAST(count(*) OVER () - _row AS INTEGER)),
                                   '%Y-%m-%d %H:%M:%S') AS date
FROM (SELECT customer_id, row_number() OVER (ORDER BY customer_id ASC NULLS FIRST, quantity ASC NULLS FIRST,
             total_sales ASC NULLS FIRST, category ASC NULLS FIRST) AS _row
      FROM (SELECT customer_id,
                   CASE WHEN CAST(trunc(coalesce(quantity, 1.0)) AS INTEGER) <= 0 THEN 1
                        ELSE CAST(trunc(coalesce(quantity, 1.0)) AS INTEGER) END AS q0, quantity, total_sales, category
            FROM mp))""", 9)
ORACLE["impute_quantity"] = with_clean("SELECT _row, CAST(quantity AS BIGINT) AS quantity FROM imp", 10)
ORACLE["impute_unit_price"] = with_clean("""
SELECT _row, CASE WHEN coalesce(TRY_CAST(sales AS DOUBLE), 10.0) <= 0 THEN 1.0
                  ELSE coalesce(TRY_CAST(sales AS DOUBLE), 10.0) END AS unit_price FROM d0""", 3)
ORACLE["impute_total_sales"] = with_clean("SELECT _row, total_sales FROM imp2")
ORACLE["impute_total_profit"] = with_clean("SELECT _row, total_sales * 0.15 AS total_profit FROM imp2")
ORACLE["impute_labels"] = with_clean("""
SELECT _row, 'Generic Product' AS product_name, coalesce(category, 'General') AS category,
       coalesce(customer_id, 'CUST-UNKNOWN') AS customer_id, 'Standard' AS customer_segment, 'Global' AS region,
       coalesce(category, 'General') AS sub_category FROM mp""", 9)
ORACLE["impute_inventory"] = with_clean("""
SELECT _row, CAST(CASE WHEN CAST(trunc(coalesce(qty, 100.0)) AS INTEGER) < 0 THEN 0
                       ELSE CAST(trunc(coalesce(qty, 100.0)) AS INTEGER) END AS BIGINT) AS inventory_level FROM d0""", 3)
ORACLE["synth_inventory"] = with_clean(
    "SELECT _row, CAST((_row * 40503 + 42 * 9973) % 950 + 50 AS BIGINT) AS inventory_level FROM d0", 3)
ORACLE["etl_canonical"] = with_clean("""
SELECT _row AS id, CAST(1 AS BIGINT) AS dataset_id, CAST(7 AS BIGINT) AS user_id,
       strftime(date, '%Y-%m-%d %H:%M:%S') AS date, 'Generic Product' AS product_name,
       coalesce(category, 'General') AS category, coalesce(category, 'General') AS sub_category,
       CAST(quantity AS BIGINT) AS quantity, 10.0 AS unit_price, total_sales, total_sales * 0.15 AS total_profit,
       coalesce(customer_id, 'CUST-UNKNOWN') AS customer_id, 'Standard' AS customer_segment, 'Global' AS region,
       """ + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in [
    "store_name", "country", "state", "city", "brand", "supplier", "customer_type", "payment_method",
    "sales_channel", "order_id"]) + """,
       CAST((_row * 40503 + 42 * 9973) % 950 + 50 AS BIGINT) AS inventory_level
FROM imp2""")
ORACLE["etl_pipeline"] = with_clean("SELECT 'processed' AS status, count(*) AS row_count FROM imp2")


# --- assistant ------------------------------------------------------------------------

_KW = [("sales", ["sales", "revenue", "income", "earning", "turnover"]),
       ("profit", ["profit", "margin", "earnings"]),
       ("product", ["product", "item", "sku"]),
       ("customer", ["customer", "client", "segment", "buyer"]),
       ("inventory", ["inventory", "stock", "warehouse"]),
       ("category", ["category", "categories", "department", "sector"]),
       ("region", ["region", "regions", "location", "city", "country"]),
       ("forecast", ["forecast", "predict", "future", "ml"])]


def _intent_sql(text: str = "text") -> str:
    parts = []
    for name, words in _KW:
        cond = " OR ".join(f"contains(lower({text}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(parts) + " ELSE 'help' END"


_WORST = "(contains(lower(text), 'worst') OR contains(lower(text), 'low') OR contains(lower(text), 'least'))"
TAGS_CTE = f"tags AS (SELECT msg_id, user_id, text, {_intent_sql()} AS intent, {_WORST} AS worst FROM messages)"
VALS_CTE = """vals AS (SELECT DISTINCT user_id, dim, value, lower(value) AS lv FROM (
    SELECT user_id, 'category' AS dim, category AS value FROM sales UNION ALL
    SELECT user_id, 'region', region FROM sales) WHERE value IS NOT NULL AND value <> '')"""
MATCH_CTE = """ent AS (SELECT m.msg_id, m.user_id,
    min(v.value) FILTER (WHERE v.dim = 'category') AS matched_category,
    min(v.value) FILTER (WHERE v.dim = 'region') AS matched_region
  FROM {src} m LEFT JOIN vals v ON v.user_id = m.user_id AND contains(lower(m.text), v.lv)
  GROUP BY m.msg_id, m.user_id)"""

ORACLE["intent_tags"] = with_sales("SELECT msg_id, user_id, intent, worst FROM tags", MESSAGES_CTE, TAGS_CTE)
ORACLE["intent_tags_conversations"] = (
    f"SELECT conv_id, turn, {_intent_sql()} AS intent, {_WORST} AS worst FROM conversations")
ORACLE["intent_entity_match"] = with_sales("SELECT * FROM ent", MESSAGES_CTE, VALS_CTE,
                                           MATCH_CTE.format(src="messages"))

_SALES_ANS = """sa AS (
  SELECT e.msg_id, e.user_id,
         CASE WHEN matched_category IS NOT NULL THEN 'category' WHEN matched_region IS NOT NULL THEN 'region'
              ELSE 'total' END AS kind,
         CASE WHEN matched_category IS NOT NULL THEN matched_category ELSE matched_region END AS target,
         CAST(CASE WHEN matched_category IS NOT NULL THEN coalesce(
                     (SELECT sum(total_sales) FROM sales s WHERE s.user_id = e.user_id
                      AND lower(s.category) = lower(e.matched_category)), 0)
                   WHEN matched_region IS NOT NULL THEN coalesce(
                     (SELECT sum(total_sales) FROM sales s WHERE s.user_id = e.user_id
                      AND lower(s.region) = lower(e.matched_region)), 0)
                   ELSE coalesce((SELECT sum(total_sales) FROM sales s WHERE s.user_id = e.user_id), 0) END
              AS DOUBLE) AS total_sales,
         CASE WHEN matched_category IS NULL AND matched_region IS NULL THEN
              CAST(coalesce((SELECT sum(quantity) FROM sales s WHERE s.user_id = e.user_id), 0) AS BIGINT) END
              AS units_sold
  FROM ent e)"""
_ASK = [MESSAGES_CTE, TAGS_CTE, VALS_CTE, MATCH_CTE.format(src="(SELECT * FROM tags WHERE intent = 'sales')"), _SALES_ANS]
ORACLE["ask_sales_category"] = with_sales(
    "SELECT msg_id, user_id, kind, target, total_sales FROM sa WHERE kind = 'category'", *_ASK)
ORACLE["ask_sales_region"] = with_sales(
    "SELECT msg_id, user_id, kind, target, total_sales FROM sa WHERE kind = 'region'", *_ASK)
ORACLE["ask_sales_total"] = with_sales("SELECT * FROM sa WHERE kind = 'total'", *_ASK)

_TEN = """ten AS (SELECT user_id, CAST(coalesce(sum(total_sales), 0) AS DOUBLE) AS total_revenue,
    CAST(coalesce(sum(total_profit), 0) AS DOUBLE) AS total_profit,
    CASE WHEN CAST(sum(total_sales) AS DOUBLE) > 0
         THEN CAST(sum(total_profit) AS DOUBLE) / CAST(sum(total_sales) AS DOUBLE) * 100 ELSE 0.0 END
         AS profit_margin_percent,
    CAST(sum(quantity) AS BIGINT) AS units_sold, count(DISTINCT customer_id) AS customers,
    coalesce(avg(inventory_level), 0.0) AS average_stock,
    count(DISTINCT CASE WHEN inventory_level < 50 THEN product_name END) AS low_stock_count
  FROM sales GROUP BY user_id)"""
ORACLE["ask_profit"] = with_sales("""
SELECT t.msg_id, t.user_id, total_revenue, total_profit, profit_margin_percent
FROM tags t LEFT JOIN ten USING (user_id) WHERE intent = 'profit'""", MESSAGES_CTE, TAGS_CTE, _TEN)
_RANK = """rk AS (SELECT user_id, product_name, s, q,
    row_number() OVER (PARTITION BY user_id ORDER BY s DESC, product_name ASC) AS rt,
    row_number() OVER (PARTITION BY user_id ORDER BY s ASC, product_name ASC) AS rb
  FROM (SELECT user_id, product_name, sum(total_sales) AS s, sum(quantity) AS q FROM sales GROUP BY 1, 2))"""
ORACLE["ask_products_top"] = with_sales("""
SELECT t.msg_id, t.user_id, t.worst, rt AS rank, product_name, CAST(s AS DOUBLE) AS revenue, CAST(q AS BIGINT) AS quantity
FROM tags t JOIN rk ON rk.user_id = t.user_id AND rt <= 5 WHERE intent = 'product' AND NOT worst""",
                                        MESSAGES_CTE, TAGS_CTE, _RANK)
ORACLE["ask_products_worst"] = with_sales("""
SELECT t.msg_id, t.user_id, t.worst, rb AS rank, product_name, CAST(s AS DOUBLE) AS revenue, CAST(q AS BIGINT) AS quantity
FROM tags t JOIN rk ON rk.user_id = t.user_id AND rb <= 5 WHERE intent = 'product' AND worst""",
    MESSAGES_CTE.replace("FROM part)", "FROM part)").replace(
        "messages AS (", "messages0 AS ("), "messages AS (SELECT msg_id, user_id, replace(text, 'best', 'worst') AS text FROM messages0)",
    TAGS_CTE, _RANK)
ORACLE["ask_customers"] = with_sales("""
SELECT t.msg_id, t.user_id, ten.customers AS total_customers, sg.segment, sg.customers
FROM tags t LEFT JOIN ten USING (user_id)
LEFT JOIN (SELECT user_id, coalesce(customer_segment, 'Standard') AS segment, count(DISTINCT customer_id) AS customers
           FROM sales GROUP BY 1, 2) sg ON sg.user_id = t.user_id
WHERE intent = 'customer'""", MESSAGES_CTE, TAGS_CTE, _TEN)
ORACLE["ask_inventory"] = with_sales("""
SELECT t.msg_id, t.user_id, average_stock, low_stock_count FROM tags t LEFT JOIN ten USING (user_id)
WHERE intent = 'inventory'""", MESSAGES_CTE, TAGS_CTE, _TEN)
ORACLE["ask_inventory_items"] = with_sales("""
SELECT t.msg_id, t.user_id, rank, product_name, stock_level FROM tags t JOIN (
  SELECT user_id, product_name, CAST(inventory_level AS BIGINT) AS stock_level,
         row_number() OVER (PARTITION BY user_id ORDER BY inventory_level, product_name, id) AS rank
  FROM sales WHERE inventory_level < 50) l ON l.user_id = t.user_id AND rank <= 5
WHERE intent = 'inventory'""", MESSAGES_CTE, TAGS_CTE)
ORACLE["ask_categories"] = with_sales("""
SELECT t.msg_id, t.user_id, g.category, g.sales FROM tags t JOIN (
  SELECT user_id, category, CAST(sum(total_sales) AS DOUBLE) AS sales FROM sales GROUP BY 1, 2) g USING (user_id)
WHERE intent = 'category'""", MESSAGES_CTE, TAGS_CTE)
ORACLE["ask_regions"] = with_sales("""
SELECT t.msg_id, t.user_id, g.region, g.sales FROM tags t JOIN (
  SELECT user_id, region, CAST(sum(total_sales) AS DOUBLE) AS sales FROM sales GROUP BY 1, 2) g USING (user_id)
WHERE intent = 'region'""", MESSAGES_CTE.replace("messages AS (", "messages0 AS ("),
    "messages AS (SELECT msg_id, user_id, replace(text, 'categories', 'regions') AS text FROM messages0)", TAGS_CTE)

_CUR = "'₹' || format('{{:,.2f}}', CAST({x} AS DOUBLE))"
_NUM = "format('{{:,}}', CAST({x} AS BIGINT))"
_LINES = [
    "top AS (SELECT user_id, string_agg(printf('%d. **%s** - Revenue: %s (%s units)', rt, product_name, "
    + _CUR.format(x="s") + ", " + _NUM.format(x="q") + ") || chr(10), '' ORDER BY rt) AS top_lines "
    "FROM rk WHERE rt <= 5 GROUP BY user_id)",
    "wst AS (SELECT user_id, string_agg(printf('%d. **%s** - Revenue: %s (%s units)', rb, product_name, "
    + _CUR.format(x="s") + ", " + _NUM.format(x="q") + ") || chr(10), '' ORDER BY rb) AS worst_lines "
    "FROM rk WHERE rb <= 5 GROUP BY user_id)",
    "seg AS (SELECT user_id, string_agg(printf('- **%s**: %s customers', segment, " + _NUM.format(x="customers")
    + ") || chr(10), '' ORDER BY segment) AS seg_lines FROM (SELECT user_id, coalesce(customer_segment, 'Standard') "
    "AS segment, count(DISTINCT customer_id) AS customers FROM sales GROUP BY 1, 2) GROUP BY user_id)",
    "cat AS (SELECT user_id, string_agg(printf('- **%s**: Total Sales: %s', category, " + _CUR.format(x="s")
    + ") || chr(10), '' ORDER BY category) AS cat_lines FROM (SELECT user_id, category, sum(total_sales) AS s "
    "FROM sales GROUP BY 1, 2) GROUP BY user_id)",
    "reg AS (SELECT user_id, string_agg(printf('- **%s**: %s', region, " + _CUR.format(x="s")
    + ") || chr(10), '' ORDER BY region) AS reg_lines FROM (SELECT user_id, region, sum(total_sales) AS s "
    "FROM sales GROUP BY 1, 2) GROUP BY user_id)",
]


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# The reply texts, stated here apart from the code that is checked.
REPLY_FORECAST = (
    "To see detailed sales forecasts and customer segment recommendations, please head to the **AI Assistant** "
    "dashboard tab or check the ML charts in the **Analytics** page. I predict future sales using historical "
    "autoregressive trends and K-Means segmentation.")
REPLY_HELP = """I can help you analyze your retail metrics! Try asking questions like:

- *What is our total revenue?*
- *How much profit did we make?*
- *What are our best selling products?*
- *Which categories perform the best?*
- *Are there any low stock inventory warnings?*
- *Show me a breakdown of our customer segments.*"""
REPLY_NO_DATA = (
    "It looks like you haven't uploaded a dataset yet. Please go to the Dashboard or Settings page to upload your "
    "retail data, and then I'll be happy to answer your business questions!")
REPLY_STOCK_OK = "Inventory status is stable with no low stock warnings."


def _reply_sql() -> str:
    nl2 = "chr(10) || chr(10)"
    return f"""
SELECT t.msg_id, t.user_id, t.intent, CASE
  WHEN ten.total_revenue IS NULL THEN {_sql_text(REPLY_NO_DATA)}
  WHEN t.intent = 'sales' AND sa.kind = 'category' THEN printf('The total sales revenue generated for the **%s** category is **%s**.', sa.target, {_CUR.format(x='sa.total_sales')})
  WHEN t.intent = 'sales' AND sa.kind = 'region' THEN printf('The total sales revenue generated in the **%s** region is **%s**.', sa.target, {_CUR.format(x='sa.total_sales')})
  WHEN t.intent = 'sales' THEN printf('Your platform total revenue is **%s** across **%s** total units sold.', {_CUR.format(x='sa.total_sales')}, {_NUM.format(x='sa.units_sold')})
  WHEN t.intent = 'profit' THEN printf('Your net profit is **%s** on a profit margin of **%.2f%%**.', {_CUR.format(x='ten.total_profit')}, ten.profit_margin_percent)
  WHEN t.intent = 'product' AND t.worst THEN 'Here are the **least-performing products** based on sales volume:' || {nl2} || coalesce(worst_lines, '')
  WHEN t.intent = 'product' THEN 'Here are the **top-performing products** based on sales volume:' || {nl2} || coalesce(top_lines, '')
  WHEN t.intent = 'customer' THEN printf('You have **%s** unique customer identifiers recorded. Here is their segmentation breakdown:', {_NUM.format(x='ten.customers')}) || {nl2} || coalesce(seg_lines, '')
  WHEN t.intent = 'inventory' THEN printf('Your average inventory stock level is **%d** units. ', CAST(trunc(ten.average_stock) AS BIGINT))
       || CASE WHEN ten.low_stock_count > 0 THEN printf('⚠️ **Attention**: There are **%d** products with critically low stock (under 50 units).', ten.low_stock_count)
               ELSE {_sql_text(REPLY_STOCK_OK)} END
  WHEN t.intent = 'category' THEN 'Here is the sales performance across your product categories:' || {nl2} || coalesce(cat_lines, '')
  WHEN t.intent = 'region' THEN 'Here is your regional sales breakdown:' || {nl2} || coalesce(reg_lines, '')
  WHEN t.intent = 'forecast' THEN {_sql_text(REPLY_FORECAST)}
  ELSE {_sql_text(REPLY_HELP)} END AS reply
FROM tags t LEFT JOIN sa ON sa.msg_id = t.msg_id AND sa.user_id = t.user_id
LEFT JOIN ten ON ten.user_id = t.user_id LEFT JOIN top ON top.user_id = t.user_id
LEFT JOIN wst ON wst.user_id = t.user_id LEFT JOIN seg ON seg.user_id = t.user_id
LEFT JOIN cat ON cat.user_id = t.user_id LEFT JOIN reg ON reg.user_id = t.user_id"""


ORACLE["reply_text"] = with_sales(_reply_sql(), *_ASK, _TEN, _RANK, *_LINES)


# --- forecasting and recommendations ----------------------------------------------

_FEAT_CTES = [DAILY_CTE, DENSE_CTE, f"f AS ({_feats('dense', 'user_id')})"]
_TEST_CTE = """te AS (SELECT user_id, CAST(total_sales AS DOUBLE) AS y, sales_lag_7 AS yhat FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k,
           greatest(least(7, CAST(floor(count(*) OVER (PARTITION BY user_id) * 0.2) AS BIGINT)), 1) AS ts
    FROM f WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in _FEATURE_NAMES) + """) WHERE k <= ts)"""
ORACLE["forecast_metrics"] = with_sales("""
SELECT user_id, n AS test_rows, round(mae, 4) AS mae,
       round(CASE WHEN n <= 1 THEN 1.0 WHEN var_y * n = 0 THEN (CASE WHEN ss_res = 0 THEN 1.0 ELSE 0.0 END)
                  ELSE 1 - ss_res / (var_y * n) END, 4) AS r2
FROM (SELECT user_id, count(*) AS n, avg(abs(y - yhat)) AS mae, sum((y - yhat) * (y - yhat)) AS ss_res,
             var_pop(y) AS var_y FROM te GROUP BY user_id)""", *_FEAT_CTES, _TEST_CTE)
ORACLE["forecast_seed"] = with_sales("""
SELECT user_id, strftime(max(day), '%Y-%m-%d') AS last_day, CAST(arg_max(total_sales, day) AS DOUBLE) AS last_total,
       string_agg(CAST(total_sales AS VARCHAR), ',' ORDER BY day) AS history_text
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM dense) WHERE k <= 14
GROUP BY user_id""", DAILY_CTE, DENSE_CTE)
_FALLBACK = """fb AS (
  SELECT user_id, CAST(step AS BIGINT) AS step, start + CAST(step AS INTEGER) AS date,
         round(greatest(5000.0 + step * 20.0 + 1000.0 * sin(6.283185307179586 * (step + (isodow(start) - 1)) / 7), 100.0), 4)
           AS predicted
  FROM (SELECT user_id, CAST(max(day) + 1 AS DATE) AS start FROM dense GROUP BY user_id),
       (SELECT unnest(range(0, 30)) AS step))"""
ORACLE["forecast_fallback"] = with_sales(
    "SELECT user_id, step, strftime(date, '%Y-%m-%d') AS date, predicted FROM fb", DAILY_CTE, DENSE_CTE, _FALLBACK)

_LOW_CTE = """low AS (SELECT user_id, rank, product_name, inventory_level FROM (
  SELECT user_id, product_name, CAST(lvl AS BIGINT) AS inventory_level,
         row_number() OVER (PARTITION BY user_id ORDER BY lvl ASC, product_name ASC) AS rank
  FROM (SELECT user_id, product_name, arg_max(inventory_level, (id, inventory_level)) AS lvl
        FROM sales WHERE inventory_level < 50 GROUP BY 1, 2)) WHERE rank <= 3)"""
_R1 = """r1 AS (SELECT user_id, rank AS priority, 'low_stock' AS rule,
  printf('CRITICAL: Stock for ''%s'' is critically low (%d units remaining). Reorder immediately.',
         product_name, inventory_level) AS message FROM low)"""
_R2 = """tc AS (SELECT user_id, round(CASE WHEN a > 0 THEN (b - a) / a * 100 ELSE 0.0 END, 4) AS pct FROM (
    SELECT user_id, avg(predicted) FILTER (WHERE step < 15) AS a, avg(predicted) FILTER (WHERE step >= 15) AS b
    FROM fb GROUP BY user_id)),
r2 AS (SELECT user_id, CAST(10 AS BIGINT) AS priority, 'sales_trend' AS rule,
  CASE WHEN pct > 5 THEN printf('SALES INSIGHT: Sales are projected to increase by %.1f%% over the next 15 days. Restock high-demand products.', pct)
       ELSE printf('MARKET WARNING: Projected sales show a decrease of %.1f%% in the second half of the month. Consider promotional bundling.', abs(pct)) END AS message
  FROM tc WHERE pct > 5 OR pct < -5)"""
_SEGCOUNT = """sc AS (SELECT coalesce(n.user_id, c.user_id) AS user_id, coalesce(n.segment, c.segment) AS segment,
    coalesce(c.customers, 0) AS customers
  FROM (SELECT DISTINCT user_id, unnest(['Champions', 'Loyal Customers', 'At Risk', 'New/Promising']) AS segment FROM rules) n
  FULL JOIN (SELECT user_id, segment, count(*) AS customers FROM rules GROUP BY 1, 2) c
    ON n.user_id = c.user_id AND n.segment = c.segment)"""
_R4 = """sp AS (SELECT user_id,
    round(sum(CASE WHEN segment = 'Champions' THEN customers ELSE 0 END) / sum(customers) * 100, 4) AS cp,
    round(sum(CASE WHEN segment = 'At Risk' THEN customers ELSE 0 END) / sum(customers) * 100, 4) AS rp
  FROM sc GROUP BY user_id HAVING sum(customers) > 0),
r4 AS (SELECT user_id, CAST(20 AS BIGINT) AS priority, 'champions' AS rule,
    printf('MARKETING: High density of Champions (%.1f%%). Launch a premium VIP early-access campaign to maximize margins.', cp) AS message
  FROM sp WHERE cp > 15
  UNION ALL
  SELECT user_id, CAST(21 AS BIGINT), 'at_risk',
    printf('RETENTION ALERT: At-Risk customers represent %.1f%% of your base. Run a win-back discount campaign this weekend.', rp)
  FROM sp WHERE rp > 25)"""
ORACLE["insight_low_stock"] = with_sales("SELECT * FROM r1", _LOW_CTE, _R1)
ORACLE["insight_trend"] = with_sales("SELECT * FROM r2", DAILY_CTE, DENSE_CTE, _FALLBACK, _R2)
ORACLE["insight_segments"] = with_sales("SELECT * FROM r4", RFM_CTE, RULES_CTE, _SEGCOUNT, _R4)
ORACLE["recommendations"] = with_sales("""
SELECT * FROM fired
UNION ALL
SELECT q.user_id, CAST(90 + t.i AS BIGINT) AS priority, 'general' AS rule, t.message
FROM (SELECT DISTINCT user_id FROM sales WHERE user_id NOT IN (SELECT user_id FROM fired)) q,
     (SELECT 0 AS i, 'Monitor daily inventory levels to prevent stockouts of top-performing items.' AS message
      UNION ALL SELECT 1, 'Run seasonal promotions during weekends to capture maximum local demand.'
      UNION ALL SELECT 2, 'Segment customer email newsletters based on their past purchase categories.') t""",
    _LOW_CTE, _R1, DAILY_CTE, DENSE_CTE, _FALLBACK, _R2, RFM_CTE, RULES_CTE, _SEGCOUNT, _R4,
    "fired AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r4)")


# --- sources, sinks, reports --------------------------------------------------------------

ORACLE["src_csv_roundtrip"] = with_sales("""
SELECT id, user_id, product_name, CAST(quantity AS BIGINT) AS quantity, CAST(total_sales AS DOUBLE) AS total_sales,
       CAST(NULL AS DOUBLE) AS state, 'id,quantity,state,total_sales,user_id' AS numeric_columns FROM sales""")
_REG = """reg AS (SELECT dataset_id * 10 + user_id AS id, user_id, dataset_id, printf('sales_%d.csv', dataset_id) AS filename,
    'retail' AS sector, 'processed' AS status, count(*) AS row_count, make_timestamp(dataset_id, 1, 1, 0, 0, 0) AS uploaded_at
  FROM sales GROUP BY user_id, dataset_id)"""
ORACLE["list_datasets"] = with_sales("""
SELECT id, user_id, dataset_id, filename, sector, status, row_count, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS uploaded_at
FROM reg WHERE user_id = 3""", _REG)
ORACLE["dataset_status_latest"] = with_sales("""
SELECT id AS dataset_id, user_id, filename, CASE WHEN row_count > 0 THEN 'processed' ELSE 'failed' END AS status,
       row_count, strftime(uploaded_at + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS event_time FROM reg""", _REG)
ORACLE["load_replace"] = with_sales("""
SELECT user_id, dataset_id, count(*) AS rows, CAST(sum(total_sales) AS DOUBLE) AS revenue FROM sales
WHERE NOT (user_id = 2 AND dataset_id = 1995 AND quantity <= 25) GROUP BY 1, 2""")
ORACLE["purge_tenant"] = with_sales("""
SELECT user_id, count(*) AS rows, count(DISTINCT dataset_id) AS uploads, CAST(1 AS BIGINT) AS models
FROM sales WHERE user_id <> 5 GROUP BY 1""")
ORACLE["model_store_segments"] = with_sales("""
SELECT user_id, count(DISTINCT customer_id) AS customers,
       CAST(CASE user_id WHEN 7 THEN 0 WHEN 2 THEN 1 ELSE 3 END AS BIGINT) AS tenants_of_run
FROM sales GROUP BY 1""")
ORACLE["upload_flow"] = with_clean("""
SELECT 'processed' AS status, count(*) AS row_count, CAST(7 AS BIGINT) AS user_id, 'success' AS forecast,
       'success' AS segmentation, count(DISTINCT coalesce(category, 'General')) AS categories,
       count(*) AS cleaned_rows, count(*) AS processed_rows, 'processed' AS logged_status, count(*) AS logged_rows
FROM imp2""")
ORACLE["export_csv"] = with_sales("""
SELECT user_id, id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, product_name, CAST(total_sales AS DOUBLE) AS total_sales
FROM sales""")
ORACLE["export_filtered"] = with_sales("""
SELECT id, customer_id, coalesce(state, '') AS state FROM sales
WHERE lower(coalesce(region, '')) = 'asia' AND lower(coalesce(payment_method, '')) = 'upi'
  AND lower(coalesce(sales_channel, '')) = 'online'""")
ORACLE["write_cleaned"] = with_clean("SELECT count(*) AS rows FROM d0", 3)
ORACLE["write_processed"] = with_clean("SELECT count(*) AS rows FROM d0", 3)

_KPI_CTES = [*GROWTH_CTES, """b AS (
  SELECT user_id, sum(total_sales) AS rev, CAST(sum(quantity) AS BIGINT) AS total_sales,
         count(DISTINCT customer_id) AS total_customers, count(DISTINCT product_name) AS total_products,
         sum(total_profit) AS prof, avg(inventory_level) AS avg_inv
  FROM sales GROUP BY user_id)""", f"""k AS (
  SELECT b.user_id, CAST(round(rev, 2) AS DOUBLE) AS total_revenue, total_sales, total_customers, total_products,
         CAST(round(prof, 2) AS DOUBLE) AS total_profit, round(avg_inv, 2) AS avg_inventory,
         coalesce(g.sales_growth, 0.0) AS sales_growth, {pct('prof', 'rev')} AS profit_margin
  FROM b LEFT JOIN g USING (user_id))"""]
_C = "'₹' || format('{{:,.2f}}', {x})"
_N = "format('{{:,}}', CAST(trunc({x}) AS BIGINT))"
ORACLE["report_summary"] = with_sales("\nUNION ALL\n".join(
    f"SELECT user_id, CAST({i + 1} AS BIGINT) AS position, '{label}' AS metric, "
    + (_C.format(x=c) if kind == "currency" else _N.format(x=c) if kind == "count" else f"CAST({c} AS VARCHAR) || '%'")
    + " AS value FROM k"
    for i, (label, c, kind) in enumerate([
        ("Total Revenue", "total_revenue", "currency"), ("Total Units Sold", "total_sales", "count"),
        ("Total Customers", "total_customers", "count"), ("Total Products Tracked", "total_products", "count"),
        ("Total Profit", "total_profit", "currency"), ("Net Profit Margin (%)", "profit_margin", "percent"),
        ("Average Stock Inventory Level", "avg_inventory", "count"),
        ("Month-Over-Month Sales Growth (%)", "sales_growth", "percent")])), *_KPI_CTES)
ORACLE["report_transactions"] = with_sales("""
SELECT user_id, id, dataset_id, strftime(date, '%Y-%m-%d') AS date, product_name, category, sub_category,
       CAST(quantity AS BIGINT) AS quantity, unit_price, CAST(total_sales AS DOUBLE) AS total_sales,
       CAST(total_profit AS DOUBLE) AS total_profit, customer_id, customer_segment, region,
       CAST(inventory_level AS BIGINT) AS inventory_level FROM sales""")
ORACLE["report_forecast"] = with_sales("""
SELECT user_id, strftime(date, '%Y-%m-%d') AS date, predicted AS predicted_sales_revenue FROM fb""",
                                       DAILY_CTE, DENSE_CTE, _FALLBACK)

ORACLE["forecast_saved_or_fallback"] = ORACLE["forecast_fallback"]

ORACLE["filter_week"] = with_sales(_FILTER_OUT + " WHERE weekofyear(date) = 23")


# --- streaming ---------------------------------------------------------------------

# Rows of an upload after its exact duplicates are dropped; the fixture's quantities lie
# inside the outlier bounds, so their sums are unchanged.
ORACLE["stream_file_ingest"] = with_sales("""
SELECT user_id, dataset_id, count(*) AS rows, count(DISTINCT product_name) AS products,
       CAST(sum(quantity) AS BIGINT) AS units, CAST(round(sum(total_sales), 2) AS DOUBLE) AS revenue,
       'processed' AS status, count(*) AS row_count
FROM (SELECT DISTINCT user_id, dataset_id, strftime(date, '%Y-%m-%d') AS day, product_name, category, quantity,
             total_sales, customer_id, region, inventory_level FROM sales)
GROUP BY user_id, dataset_id""")

ORACLE["landing_manifest"] = with_sales("""
SELECT '.csv' AS ext, true AS accepted, CAST(NULL AS VARCHAR) AS reason,
       count(DISTINCT (user_id, dataset_id)) AS files FROM sales
UNION ALL
SELECT '.parquet', false, 'unsupported file type', count(DISTINCT user_id) FROM sales""")


def _parts_sql() -> str:
    """The dashboard's values from the statements of its parts."""
    out = []
    for part, key, order, label, values in [
            ("sales_trend", "trend_daily", "label", "label", ["value"]),
            ("monthly_revenue", "trend_monthly", "label", "label", ["value"]),
            ("category_distribution", "category_distribution", "sales DESC, category", "category",
             ["sales", "percentage"]),
            ("top_products", "top_products", "rank", "product_name", ["sales", "quantity", "profit"]),
            ("worst_products", "worst_products", "rank", "product_name", ["sales", "quantity", "profit"]),
            ("regional_sales", "regional_sales", "value DESC, region", "region", ["value"])]:
        cols = ", ".join(f"CAST({values[i] if i < len(values) else 'NULL'} AS DOUBLE) AS {n}"
                         for i, n in enumerate("abc"))
        out.append(f"SELECT user_id, '{part}' AS part, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS pos, "
                   f"{label} AS label, {cols} FROM ({ORACLE[key]})")
    for name in ["total_revenue", "total_sales", "total_customers", "total_products", "total_profit",
                 "avg_inventory", "sales_growth", "profit_margin"]:
        out.append(f"SELECT user_id, 'kpis', 0, '{name}', CAST({name} AS DOUBLE), NULL, NULL "
                   f"FROM ({ORACLE['kpi_summary']})")
    out.append("SELECT user_id, 'customer_segments', 0, segment, CAST(customers AS DOUBLE), NULL, NULL "
               f"FROM ({ORACLE['segment_counts']})")
    return "\nUNION ALL\n".join(out)


ORACLE["dashboard_parts"] = _parts_sql()
_LAST_JOIN = "JOIN region ON n_regionkey = r_regionkey)"
ORACLE["dashboard_incremental"] = ORACLE["dashboard_parts"].replace(
    _LAST_JOIN, _LAST_JOIN[:-1] + " WHERE NOT (l_suppkey % 8 = 2 AND year(o_orderdate) = 1995 AND l_quantity <= 25))")
