"""Sales-shaped fixtures derived from the star-schema test tables.

``sales_from_star`` builds the canonical sales fact; ``dirty_from_star`` a
damaged raw upload for the cleaning operators; ``messages_from_part`` a
table of business questions for intent tagging. All three are lazy plans over
the given tables, so their work grows with the data.

Join strategy: lineitem-orders is the big-big join (sort-merge on the order
key at scale), while line items are narrow; customers join their orders first, of which
there are fewer than line items. part, supplier and customer are left to Catalyst: they are
broadcast only when their estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` (a checked size, with sort-merge
beyond it), and AQE re-plans from real shuffle sizes. nation (25 rows) and
region (5 rows) are fixed-size dimensions and are always broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import Tables


def _money(extendedprice: str = "l_extendedprice", discount: str = "l_discount"):
    return (F.col(extendedprice).cast("decimal(12,2)")
            * (F.lit(1) - F.col(discount).cast("decimal(4,2)"))).cast("decimal(18,4)")


def _row_key():
    return (((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10000
             + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).cast("bigint")


# Keys that the joined rows hold under another name, or not at all later.
JOIN_KEYS = {"o_orderkey", "o_custkey", "p_partkey", "s_suppkey", "c_custkey", "c_nationkey", "n_nationkey",
             "n_regionkey", "r_regionkey"}


def sales_from_star(t: Tables, gather: bool = False) -> DataFrame:
    """The canonical 25-column sales fact, one row per line item. With ``gather``, rows of
    one tenant and year are brought together and in order for a partitioned write, before
    the columns that repeat or extend others are made (3.8 GB instead of 5.9 for 36 million rows).

    Money stays ``decimal(18,4)`` so that sums are exact and independent of
    summation order; cast to double only at the output.
    """
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                           "l_quantity", "l_extendedprice", "l_discount")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    p = t.part.select("p_partkey", "p_name", "p_type", "p_brand", "p_retailprice")
    s = t.supplier.select("s_suppkey", "s_name")
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = F.broadcast(t.nation.select("n_nationkey", "n_name", "n_regionkey"))
    r = F.broadcast(t.region.select("r_regionkey", "r_name"))

    j = (li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)
         .join(p, li.l_partkey == p.p_partkey)
         .join(s, li.l_suppkey == s.s_suppkey)
         .join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))

    key = {"user_id": (F.col("l_suppkey") % 8).cast("bigint"), "dataset_id": F.year("o_orderdate").cast("bigint")}
    j = j.select(*[c for c in j.columns if c not in JOIN_KEYS], *[v.alias(k) for k, v in key.items()])
    if gather:
        j = j.hint("rebalance", *key).sortWithinPartitions(*key)

    total_sales = _money()
    return j.select(
        _row_key().alias("id"),
        "dataset_id",
        "user_id",
        F.col("o_orderdate").alias("date"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("l_partkey").cast("string")).alias("product_name"),
        F.col("p_type").alias("category"),
        F.concat(F.col("p_type"), F.lit(" / "), F.col("p_brand")).alias("sub_category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("p_retailprice").cast("double").alias("unit_price"),
        total_sales.alias("total_sales"),
        (total_sales * F.lit(0.15).cast("decimal(3,2)")).cast("decimal(20,6)").alias("total_profit"),
        F.col("c_name").alias("customer_id"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("Store "), (F.col("l_suppkey") % 20).cast("string")).alias("store_name"),
        F.col("n_name").alias("country"),
        F.lit(None).cast("string").alias("state"),
        F.lit(None).cast("string").alias("city"),
        F.col("p_brand").alias("brand"),
        F.col("s_name").alias("supplier"),
        F.when(F.col("c_acctbal") < 0, "At Risk")
         .when(F.col("c_acctbal") < 3000, "New/Promising")
         .when(F.col("c_acctbal") < 7000, "Loyal Customers")
         .otherwise("Champions").alias("customer_type"),
        F.when(F.col("l_linenumber") % 3 == 0, "UPI")
         .when(F.col("l_linenumber") % 3 == 1, "Credit Card")
         .otherwise("NetBanking").alias("payment_method"),
        F.when(F.col("l_orderkey") % 2 == 0, "Online").otherwise("In-Store").alias("sales_channel"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 950).cast("int").alias("inventory_level"),
    )


def dirty_from_star(t: Tables) -> DataFrame:
    """A damaged raw upload (text dates, nulls, outliers, padded labels,
    unparseable amounts) plus undamaged copies of every tenth order, which
    give exact duplicate rows. The tables are joined once: a row of such an order
    becomes two."""
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                           "l_quantity", "l_extendedprice", "l_discount")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    p = t.part.select("p_partkey", "p_type")
    c = t.customer.select("c_custkey", "c_name")
    j = (li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)
         .join(p, li.l_partkey == p.p_partkey))

    sales_txt = _money().cast("decimal(18,2)").cast("string")
    date_txt = F.date_format("o_orderdate", "yyyy-MM-dd")
    damaged = F.struct(
        _row_key().alias("row_seq"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit("not a date")).otherwise(date_txt).alias("order_date"),
        F.when(F.col("l_partkey") % 13 == 0, F.lit(None).cast("double"))
         .when(F.col("l_partkey") % 101 == 0, F.col("l_quantity") * 40)
         .otherwise(F.col("l_quantity")).alias("qty"),
        F.when(F.col("l_suppkey") % 19 == 0, F.lit(None).cast("string"))
         .when(F.col("l_suppkey") % 7 == 0, F.concat(F.lit("  "), F.col("p_type"), F.lit("  ")))
         .when(F.col("l_suppkey") % 23 == 0, F.lit("nan"))
         .otherwise(F.col("p_type")).alias("category"),
        F.when(F.col("l_orderkey") % 29 == 0, F.lit("n.a.")).otherwise(sales_txt).alias("sales"),
        F.col("c_name").alias("customer_id"),
    )
    clean_copy = F.struct(
        _row_key().alias("row_seq"),
        date_txt.alias("order_date"),
        F.col("l_quantity").alias("qty"),
        F.col("p_type").alias("category"),
        sales_txt.alias("sales"),
        F.col("c_name").alias("customer_id"),
    )
    rows = F.when(F.col("l_orderkey") % 10 == 1, F.array(damaged, clean_copy)).otherwise(F.array(damaged))
    return j.select(F.inline(rows))


def messages_from_part(t: Tables) -> DataFrame:
    """One business question per part, asked by tenant ``p_partkey % 8``;
    wording follows the assistant's help text."""
    k = F.col("p_partkey") % 9
    text = (F.when(k == 0, F.concat(F.lit("What is our revenue for "), F.col("p_type"), F.lit("?")))
            .when(k == 1, F.lit("Sales in ASIA please"))
            .when(k == 2, F.lit("What is our total revenue?"))
            .when(k == 3, F.lit("How much profit did we make?"))
            .when(k == 4, F.lit("What are our best selling products?"))
            .when(k == 5, F.lit("Show me a breakdown of our customer segments."))
            .when(k == 6, F.lit("Are there any low stock inventory warnings?"))
            .when(k == 7, F.lit("Which categories perform the best?"))
            .otherwise(F.lit("Hello there")))
    return t.part.select(F.col("p_partkey").cast("bigint").alias("msg_id"),
                         (F.col("p_partkey") % 8).cast("bigint").alias("user_id"), text.alias("text"))
