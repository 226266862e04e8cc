"""Assistant questions as a batch: intent tags, entity match, answers, replies.

``messages(msg_id, user_id, text)`` is tagged in one projection (a chain of
``contains`` tests, first matching group wins). Answers are per-tenant
aggregates joined to the tagged messages on ``user_id``; the aggregates are
computed once per tenant, not once per message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_double, currency, thousands
from ..schema import DEFAULT_SEGMENT, INTENT_KEYWORDS, LOW_STOCK_THRESHOLD, WORST_KEYWORDS

# Reply texts of the assistant.
REPLY_FORECAST = ("To see detailed sales forecasts and customer segment recommendations, please head to the "
                  "**AI Assistant** dashboard tab or check the ML charts in the **Analytics** page. I predict "
                  "future sales using historical autoregressive trends and K-Means segmentation.")
REPLY_HELP = ("I can help you analyze your retail metrics! Try asking questions like:\n\n"
              "- *What is our total revenue?*\n"
              "- *How much profit did we make?*\n"
              "- *What are our best selling products?*\n"
              "- *Which categories perform the best?*\n"
              "- *Are there any low stock inventory warnings?*\n"
              "- *Show me a breakdown of our customer segments.*")
REPLY_NO_DATA = ("It looks like you haven't uploaded a dataset yet. Please go to the Dashboard or Settings page "
                 "to upload your retail data, and then I'll be happy to answer your business questions!")
REPLY_STOCK = "Your average inventory stock level is **%d** units. "
REPLY_STOCK_LOW = ("⚠️ **Attention**: There are **%d** products with critically low stock "
                   "(under 50 units).")
REPLY_STOCK_OK = "Inventory status is stable with no low stock warnings."
REPLY_SALES_CATEGORY = "The total sales revenue generated for the **%s** category is **%s**."
REPLY_SALES_REGION = "The total sales revenue generated in the **%s** region is **%s**."
REPLY_TOTAL = "Your platform total revenue is **%s** across **%s** total units sold."
REPLY_PROFIT = "Your net profit is **%s** on a profit margin of **%.2f%%**."
REPLY_WORST = "Here are the **least-performing products** based on sales volume:\n\n"
REPLY_TOP = "Here are the **top-performing products** based on sales volume:\n\n"
REPLY_PRODUCT_LINE = "%d. **%s** - Revenue: %s (%s units)\n"
REPLY_CUSTOMERS = ("You have **%s** unique customer identifiers recorded. Here is their segmentation "
                   "breakdown:\n\n")
REPLY_SEGMENT_LINE = "- **%s**: %s customers\n"
REPLY_CATEGORIES = "Here is the sales performance across your product categories:\n\n"
REPLY_CATEGORY_LINE = "- **%s**: Total Sales: %s\n"
REPLY_REGIONS = "Here is your regional sales breakdown:\n\n"
REPLY_REGION_LINE = "- **%s**: %s\n"


def _contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def tag_intents(messages: DataFrame) -> DataFrame:
    """Q0: intent per message (sales, profit, product, customer, inventory,
    category, region, forecast, else help) and the worst-products flag.
    Keywords match anywhere in the lower-cased text."""
    low = F.lower(F.col("text"))
    intent = F.lit("help")
    for name, words in reversed(INTENT_KEYWORDS):
        intent = F.when(_contains_any(low, words), F.lit(name)).otherwise(intent)
    return messages.select("*", intent.alias("intent"), _contains_any(low, WORST_KEYWORDS).alias("worst"))


def dimension_values(sales: DataFrame, dims=("category", "region")) -> DataFrame:
    """Distinct non-empty values per tenant and dimension, lower-cased."""
    long = sales.select("user_id", F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("d"))
    return (long.select("user_id", "d.dim", "d.value").where(F.col("value").isNotNull() & (F.col("value") != ""))
            .distinct().withColumn("lv", F.lower("value")).withColumn("len", F.length("lv")))


GRAM = 3   # length of the grams of the entity index


def grams(text: Column, n: Column | int) -> Column:
    """The distinct substrings of length ``n``; none of a shorter text."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))
                  ).otherwise(F.array().cast("array<string>"))


def rarest_grams(values: DataFrame) -> DataFrame:
    """An inverted index of the values: each under the one of its grams that fewest of the
    tenant's values hold (ties: the smallest). A value shorter than a gram is its own."""
    n = F.least(F.col("len"), F.lit(GRAM))
    each = values.select("*", F.explode(grams(F.col("lv"), n)).alias("gram"))
    held = each.select("user_id", "gram", "lv").distinct().groupBy("user_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    return (each.join(held, ["user_id", "gram"]).groupBy("user_id", "dim", "value", "lv")
            .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")))


def match_texts(texts: DataFrame, sales: DataFrame, dims=("category", "region")) -> DataFrame:
    """J4 on distinct texts (user_id, lt): for each dimension, the tenant's value (smallest
    name on ties) that occurs in the text as a substring.

    A text is exploded into its distinct grams, of the lengths that the index uses, and
    meets the values listed under one of them; only these are searched in the text."""
    index = rarest_grams(dimension_values(sales, dims))
    lengths = index.agg(F.array_sort(F.collect_set(F.length("gram"))).alias("lengths"))   # one row, GRAM entries
    found = (texts.crossJoin(F.broadcast(lengths))
             .select("user_id", "lt", F.explode(F.flatten(F.transform("lengths", lambda n: grams(F.col("lt"), n))))
                     .alias("gram"))
             .join(index, ["user_id", "gram"]).where(F.col("lt").contains(F.col("lv"))))
    return (found.groupBy("user_id", "lt").pivot("dim", list(dims)).agg(F.min("value"))
            .select("user_id", "lt", *[F.col(d).alias(f"matched_{d}") for d in dims]))


def match_entities(messages: DataFrame, sales: DataFrame, dims=("category", "region")) -> DataFrame:
    """J4 for messages: each distinct text of a tenant is matched once."""
    m = messages.select("msg_id", "user_id", F.lower("text").alias("lt"))
    texts = m.select("user_id", "lt").where("lt IS NOT NULL").distinct()
    return m.join(match_texts(texts, sales, dims), ["user_id", "lt"]).drop("lt").select(
        "msg_id", "user_id", *[f"matched_{d}" for d in dims])


def entity_table(messages: DataFrame, sales: DataFrame, dims=("category", "region")) -> DataFrame:
    """J4 for every message: matched values, null where nothing matched."""
    return messages.select("msg_id", "user_id").join(match_entities(messages, sales, dims),
                                                     ["msg_id", "user_id"], "left")


def _tagged(messages: DataFrame, sales: DataFrame) -> DataFrame:
    """Tagged messages; sales questions also carry their matched category
    and region. Entity matching runs on the sales questions only."""
    t = tag_intents(messages)
    m = match_entities(t.where(F.col("intent") == "sales").select("msg_id", "user_id", "text"), sales)
    return t.join(m, ["msg_id", "user_id"], "left")


def combine_by_tenant(parts: list[DataFrame], key: str = "user_id") -> DataFrame:
    """One row per tenant from several per-tenant frames, assembled with a
    union and one aggregation instead of a chain of joins (a join chain on a
    partition column would nest a pruning subquery per level)."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    cols = [c for c in u.columns if c != key]
    return u.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def sales_answer_table(sales: DataFrame) -> DataFrame:
    """Per tenant: revenue per lower-cased category and region, and the
    tenant total with units, keyed by (user_id, kind, key). One scan."""
    long = sales.select("user_id", "total_sales", "quantity", F.explode(F.array(
        F.struct(F.lit("category").alias("kind"), F.lower("category").alias("key")),
        F.struct(F.lit("region").alias("kind"), F.lower("region").alias("key")),
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("key")))).alias("k"))
    return (long.groupBy("user_id", "k.kind", "k.key")
            .agg(F.sum("total_sales").alias("ans_sales"), F.sum("quantity").alias("ans_units")))


def _sales_answers(tagged: DataFrame, sales: DataFrame) -> DataFrame:
    """Adds kind, target, total and units to tagged messages with a single
    join against the per-tenant answer table."""
    kind = (F.when(F.col("matched_category").isNotNull(), "category")
            .when(F.col("matched_region").isNotNull(), "region").otherwise("total"))
    target = F.when(kind == "category", F.col("matched_category")).when(kind == "region", F.col("matched_region"))
    t = tagged.withColumn("kind", kind).withColumn("target", target) \
        .withColumn("key", F.coalesce(F.lower("target"), F.lit("")))
    a = sales_answer_table(sales)
    j = t.join(a, ["user_id", "kind", "key"], "left")
    return j.select(*tagged.columns, "kind", "target",
                    as_double(F.coalesce("ans_sales", F.lit(0))).alias("sales_value"),
                    F.when(F.col("kind") == "total", F.coalesce("ans_units", F.lit(0))).cast("bigint")
                    .alias("sales_units"))


def answer_sales(messages: DataFrame, sales: DataFrame) -> DataFrame:
    """Q1a-c: revenue for the named category, else the named region, else
    total revenue and units; one row per sales question."""
    t = _tagged(messages, sales).where(F.col("intent") == "sales")
    return _sales_answers(t, sales).select("msg_id", "user_id", "kind", "target",
                                           F.col("sales_value").alias("total_sales"),
                                           F.col("sales_units").alias("units_sold"))


def tenant_answers(sales: DataFrame) -> DataFrame:
    """Scalar answers per tenant: revenue, profit, margin, customers,
    average stock, number of low-stock products."""
    low = F.when(F.col("inventory_level") < LOW_STOCK_THRESHOLD, F.col("product_name"))
    a = sales.groupBy("user_id").agg(
        F.sum("total_sales").alias("rev"), F.sum("total_profit").alias("prof"), F.sum("quantity").alias("units"),
        F.countDistinct("customer_id").alias("customers"), F.avg("inventory_level").alias("avg_stock"),
        F.countDistinct(low).alias("low_stock_products"))
    margin = F.when(as_double("rev") > 0, as_double("prof") / as_double("rev") * 100).otherwise(0.0)
    return a.select("user_id", as_double(F.coalesce("rev", F.lit(0))).alias("total_revenue"),
                    as_double(F.coalesce("prof", F.lit(0))).alias("total_profit"),
                    margin.alias("profit_margin_percent"),
                    F.col("units").cast("bigint").alias("units_sold"),
                    F.col("customers").cast("bigint").alias("customers"),
                    F.coalesce("avg_stock", F.lit(0.0)).alias("average_stock"),
                    F.col("low_stock_products").cast("bigint").alias("low_stock_count"))


def _asked(messages: DataFrame, intent: str) -> DataFrame:
    return tag_intents(messages).where(F.col("intent") == intent).select("msg_id", "user_id", "worst")


def answer_profit(messages: DataFrame, sales: DataFrame) -> DataFrame:
    """Q2: revenue, profit and margin % (unrounded) per profit question."""
    a = tenant_answers(sales).select("user_id", "total_revenue", "total_profit", "profit_margin_percent")
    return _asked(messages, "profit").drop("worst").join(a, "user_id", "left")


def product_ranking(sales: DataFrame, n: int = 5) -> DataFrame:
    """Top and bottom ``n`` products by revenue per tenant (long form)."""
    p = sales.groupBy("user_id", "product_name").agg(F.sum("total_sales").alias("s"), F.sum("quantity").alias("q"))
    out = []
    for worst, order in [(False, F.desc("s")), (True, F.asc("s"))]:
        # each ranking has its own window directly under its filter, so both
        # get a per-partition group limit (n rows per tenant and mapper)
        w = Window.partitionBy("user_id").orderBy(order, "product_name")
        out.append(p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                   .select("user_id", F.lit(worst).alias("worst"), "rank", "product_name", "s", "q"))
    return out[0].unionByName(out[1])


def answer_products(messages: DataFrame, sales: DataFrame, worst: bool | None = None) -> DataFrame:
    """Q3: the five best (or, when the question says worst/low/least, the
    five worst) products with revenue and units, per product question."""
    asked = _asked(messages, "product")
    if worst is not None:
        asked = asked.where(F.col("worst") == F.lit(worst))
    r = product_ranking(sales)
    return asked.join(r, ["user_id", "worst"]).select(
        "msg_id", "user_id", "worst", F.col("rank").cast("bigint").alias("rank"), "product_name",
        as_double("s").alias("revenue"), F.col("q").cast("bigint").alias("quantity"))


def segment_customer_counts(sales: DataFrame) -> DataFrame:
    return (sales.groupBy("user_id", F.coalesce("customer_segment", F.lit(DEFAULT_SEGMENT)).alias("segment"))
            .agg(F.countDistinct("customer_id").cast("bigint").alias("customers")))


def answer_customers(messages: DataFrame, sales: DataFrame) -> DataFrame:
    """Q4: distinct customers per segment (null segment -> Standard) and in total."""
    a = tenant_answers(sales).select("user_id", F.col("customers").alias("total_customers"))
    s = segment_customer_counts(sales)
    return _asked(messages, "customer").drop("worst").join(a, "user_id", "left").join(s, "user_id", "left")


def answer_inventory(messages: DataFrame, sales: DataFrame) -> DataFrame:
    """Q5: average stock and number of distinct products under 50 units."""
    a = tenant_answers(sales).select("user_id", "average_stock", "low_stock_count")
    return _asked(messages, "inventory").drop("worst").join(a, "user_id", "left")


def low_stock_rows(sales: DataFrame, n: int = 5) -> DataFrame:
    """Q5 list: ``n`` rows under the threshold per tenant, ordered by level
    then product then id (the unordered limit made deterministic)."""
    w = Window.partitionBy("user_id").orderBy("inventory_level", "product_name", "id")
    return (sales.where(F.col("inventory_level") < LOW_STOCK_THRESHOLD)
            .select("user_id", "id", "product_name", "inventory_level")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


def answer_inventory_items(messages: DataFrame, sales: DataFrame) -> DataFrame:
    r = low_stock_rows(sales).select("user_id", F.col("rank").cast("bigint").alias("rank"), "product_name",
                                     F.col("inventory_level").cast("bigint").alias("stock_level"))
    return _asked(messages, "inventory").drop("worst").join(r, "user_id")


def answer_groups(messages: DataFrame, sales: DataFrame, intent: str, dim: str) -> DataFrame:
    """Q6/Q7: revenue per category (or region) per question."""
    g = sales.groupBy("user_id", F.col(dim).alias(dim)).agg(as_double(F.sum("total_sales")).alias("sales"))
    return _asked(messages, intent).drop("worst").join(g, "user_id")


def _lines(df: DataFrame, order: list[str], line: Column, alias: str) -> DataFrame:
    """Per tenant, the rendered lines of a small answer table, in order."""
    return (df.groupBy("user_id")
            .agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order], line.alias("l")))).alias("xs"))
            .select("user_id", F.array_join(F.transform("xs", lambda x: x["l"]), "").alias(alias)))


def _numbered(r: DataFrame, alias: str) -> DataFrame:
    return _lines(r, ["rank"], F.format_string(REPLY_PRODUCT_LINE, F.col("rank"), F.col("product_name"),
                                               currency("s"), thousands("q")), alias)


def tenant_replies(sales: DataFrame) -> DataFrame:
    """Q10: the replies that a tenant's questions can get, apart from sales questions:
    one row per (tenant, topic), where a topic is an intent or ``worst``."""
    r = product_ranking(sales)
    seg = _lines(segment_customer_counts(sales), ["segment"], F.format_string(
        REPLY_SEGMENT_LINE, F.col("segment"), thousands("customers")), "seg_lines")
    cat = _lines(sales.groupBy("user_id", "category").agg(F.sum("total_sales").alias("s")), ["category"],
                 F.format_string(REPLY_CATEGORY_LINE, F.col("category"), currency("s")), "cat_lines")
    reg = _lines(sales.groupBy("user_id", "region").agg(F.sum("total_sales").alias("s")), ["region"],
                 F.format_string(REPLY_REGION_LINE, F.col("region"), currency("s")), "reg_lines")
    t = combine_by_tenant([tenant_answers(sales), _numbered(r.where(~F.col("worst")), "top_lines"),
                           _numbered(r.where(F.col("worst")), "worst_lines"), seg, cat, reg])
    lines = lambda c: F.coalesce(c, F.lit(""))
    stock_tail = F.when(F.col("low_stock_count") > 0, F.format_string(REPLY_STOCK_LOW, F.col("low_stock_count"))
                        ).otherwise(F.lit(REPLY_STOCK_OK))
    replies = {
        "profit": F.format_string(REPLY_PROFIT, currency("total_profit"), F.col("profit_margin_percent")),
        "worst": F.concat(F.lit(REPLY_WORST), lines("worst_lines")),
        "product": F.concat(F.lit(REPLY_TOP), lines("top_lines")),
        "customer": F.concat(F.format_string(REPLY_CUSTOMERS, thousands("customers")), lines("seg_lines")),
        "inventory": F.concat(F.format_string(REPLY_STOCK, F.col("average_stock").cast("bigint")), stock_tail),
        "category": F.concat(F.lit(REPLY_CATEGORIES), lines("cat_lines")),
        "region": F.concat(F.lit(REPLY_REGIONS), lines("reg_lines")),
        "forecast": F.lit(REPLY_FORECAST), "help": F.lit(REPLY_HELP)}
    return t.select("user_id", F.explode(F.array(*[F.struct(F.lit(k).alias("topic"), v.alias("reply"))
                                                  for k, v in replies.items()])).alias("r")).select("user_id", "r.*")


def sales_replies(sales: DataFrame) -> DataFrame:
    """Q10: the reply to every sales question a tenant can ask: one row per (tenant, kind,
    lower-cased name), the name of the total being ''."""
    a = sales_answer_table(sales)
    value = currency(as_double(F.coalesce("ans_sales", F.lit(0))))
    units = thousands(F.coalesce("ans_units", F.lit(0)).cast("bigint"))
    return a.select("user_id", "kind", "key", value.alias("value"),
                    F.format_string(REPLY_TOTAL, value, units).alias("total"))


def reply_text(messages: DataFrame, sales: DataFrame) -> DataFrame:
    """Q10: the reply text of every question (currency with two decimals and thousands
    separators; lists rendered one line per row). A reply is composed once for each
    tenant and topic; a question is joined with its reply only."""
    t = _tagged(messages, sales)
    i = F.col("intent")
    kind = (F.when(F.col("matched_category").isNotNull(), "category")
            .when(F.col("matched_region").isNotNull(), "region").otherwise("total"))
    target = F.coalesce("matched_category", "matched_region")
    t = t.select("msg_id", "user_id", "intent", F.when((i == "product") & F.col("worst"), "worst").otherwise(i)
                 .alias("topic"), F.when(i == "sales", kind).alias("kind"), target.alias("target"),
                 F.when(i == "sales", F.coalesce(F.lower(target), F.lit(""))).alias("key"))
    known = sales.select("user_id").distinct().withColumn("_known", F.lit(True))
    j = (t.join(tenant_replies(sales), ["user_id", "topic"], "left")
         .join(sales_replies(sales), ["user_id", "kind", "key"], "left").join(known, "user_id", "left"))
    reply = (F.when(F.col("_known").isNull(), F.lit(REPLY_NO_DATA))
             .when(F.col("kind") == "category", F.format_string(REPLY_SALES_CATEGORY, F.col("target"), F.col("value")))
             .when(F.col("kind") == "region", F.format_string(REPLY_SALES_REGION, F.col("target"), F.col("value")))
             .when(F.col("kind") == "total", F.col("total")).otherwise(F.col("reply")))
    return j.select("msg_id", "user_id", "intent", reply.alias("reply"))
