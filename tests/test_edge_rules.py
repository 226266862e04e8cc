"""Edge rules on hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from tillsight.functions.columns import parse_timestamp

from tillsight.operators import clean as cl
from tillsight.operators import filters as flt
from tillsight.operators import impute as imp
from tillsight.operators import intents as it
from tillsight.operators import ledger as led
from tillsight.operators import metrics as m
from tillsight.operators import segments as seg
from tillsight.operators import timeseries as ts
from tillsight.operators.clean import clean_upload
from tillsight.operators.impute import impute_date, impute_quantity
from tillsight.operators.mapping import resolve_mapping
from tillsight.plans.forecast import fallback_forecast
from tillsight.schema import SALES_SCHEMA
from tillsight.session import ensure_checkpoint_dir
from tillsight.sinks.writers import write_copy
from tillsight.sources.raw import read_raw_csv


def sales_frame(spark, rows):
    """rows: dicts with some canonical fields; the rest get defaults."""
    base = {"id": 0, "dataset_id": 1, "user_id": 1, "date": dt.datetime(2024, 1, 1), "product_name": "p",
            "category": "c", "sub_category": None, "quantity": 1, "unit_price": 1.0, "total_sales": 1.0,
            "total_profit": 0.15, "customer_id": "x", "customer_segment": None, "region": "r",
            "store_name": None, "country": None, "state": None, "city": None, "brand": None, "supplier": None,
            "customer_type": None, "payment_method": None, "sales_channel": None, "order_id": None,
            "inventory_level": 100}
    data = []
    for i, r in enumerate(rows):
        d = dict(base, id=i + 1)
        d.update(r)
        data.append(tuple(d[f.name] for f in SALES_SCHEMA.fields))
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in SALES_SCHEMA.fields])
    return spark.createDataFrame(data, nullable)


def test_empty_tenant_kpis_are_zero(spark):
    s = sales_frame(spark, [{"user_id": 1}])
    r = m.tenant_kpis(s, 99).collect()
    assert len(r) == 1
    assert r[0]["total_revenue"] == 0.0 and r[0]["total_customers"] == 0 and r[0]["sales_growth"] == 0.0


def test_zero_revenue_margin_and_growth(spark):
    s = sales_frame(spark, [{"total_sales": 0.0, "total_profit": 0.0, "date": dt.datetime(2024, 1, 5)},
                            {"total_sales": 10.0, "date": dt.datetime(2024, 2, 5)}])
    k = m.kpi_summary(s).collect()[0]
    assert k["sales_growth"] == 0.0          # previous month is zero
    one = sales_frame(spark, [{"total_sales": 0.0, "total_profit": 0.0}])
    assert m.kpi_summary(one).collect()[0]["profit_margin"] == 0.0


def test_growth_uses_last_two_months_present(spark):
    s = sales_frame(spark, [{"total_sales": 100.0, "date": dt.datetime(2024, 1, 5)},
                            {"total_sales": 150.0, "date": dt.datetime(2024, 4, 5)}])
    assert m.mom_growth(s).collect()[0]["sales_growth"] == 50.0


def test_top_and_worst_overlap_with_few_products(spark):
    s = sales_frame(spark, [{"product_name": "a", "total_sales": 1.0}, {"product_name": "b", "total_sales": 2.0}])
    top = [r["product_name"] for r in m.product_performance(s, 5).orderBy("rank").collect()]
    worst = [r["product_name"] for r in m.product_performance(s, 5, ascending=True).orderBy("rank").collect()]
    assert top == ["b", "a"] and worst == ["a", "b"]


def test_mode_tie_takes_smallest_and_empty_column_gets_other(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None), (3, None, None)], "_row long, t string, e string")
    out = cl.impute_mode(df, ["t", "e"]).orderBy("_row").collect()
    assert [r["t"] for r in out] == ["b", "a", "a"]
    assert {r["e"] for r in out} == {"Other"}


def test_all_null_numeric_column_becomes_zero(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "_row long, v double")
    assert {r["v"] for r in cl.impute_mean(df, ["v"]).collect()} == {0.0}


def test_iqr_zero_is_not_capped_and_id_headers_are_skipped(spark):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(1, 9)] + [(9, 500.0, 900.0)],
                               "_row long, v double, width double")
    out = cl.cap_outliers(df, ["v", "width"]).orderBy("_row").collect()
    assert out[-1]["v"] < 500.0            # capped
    assert out[-1]["width"] == 900.0       # 'width' contains 'id': skipped
    flat = spark.createDataFrame([(i, 1.0) for i in range(5)] + [(9, 9.0)], "_row long, v double")
    assert max(r["v"] for r in cl.cap_outliers(flat, ["v"]).collect()) == 9.0   # iqr = 0


def test_header_collision_later_wins_and_first_synonym(spark):
    m1 = resolve_mapping(["Unit_Price", "unit price", "Price"])
    assert m1["unit_price"] == "unit price"
    m2 = resolve_mapping(["Sales", "Revenue"])
    assert m2["total_sales"] == "Sales"
    assert resolve_mapping(["foo"])["date"] is None


def test_null_tokens_and_whitespace(spark):
    df = spark.createDataFrame([(1, "  a\t"), (2, "nan"), (3, "NULL"), (4, "")], "_row long, t string")
    out = [r["t"] for r in cl.normalise_text(df, ["t"]).orderBy("_row").collect()]
    assert out == ["a", None, None, None]


def test_forward_fill_crosses_chunks(spark):
    vals = [(i, dt.datetime(2024, 1, i) if i in (2, 7) else None) for i in range(1, 12)]
    df = spark.createDataFrame(vals, "_row long, date timestamp")
    out = imp.forward_fill(df, "date", chunk=3).orderBy("_row").collect()
    got = [r["date"].day if r["date"] else None for r in out]
    assert got == [None, 2, 2, 2, 2, 2, 7, 7, 7, 7, 7]


def test_quantity_price_rules(spark):
    df = spark.createDataFrame([("-3", "0"), ("2.9", "x"), (None, None)], "q string, p string")
    out = df.select(imp.impute_quantity("q").alias("q"), imp.impute_unit_price("p").alias("p")).collect()
    assert [(r["q"], r["p"]) for r in out] == [(1, 1.0), (2, 10.0), (1, 10.0)]


def test_dense_positions_match_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id"))
    pos = led.with_positions(df.repartition(7), [F.col("k").asc(), F.col("id").asc()])
    got = {(r["k"], r["pos"]) for r in pos.collect()}
    assert got == {(k, k + 1) for k in range(5000)}


def test_paging_clamps_to_last_page(spark):
    s = sales_frame(spark, [{"product_name": f"p{i:02d}"} for i in range(20)])
    page = led.ledger_page(s.select("id", "product_name"), "product_name", page=99).collect()
    assert len(page) == 4 and page[0]["caption"] == "17 to 20 of 20"


def test_null_dates_pass_date_filters(spark):
    s = sales_frame(spark, [{"date": None}, {"date": dt.datetime(2020, 1, 1)}, {"date": dt.datetime(2025, 1, 1)}])
    out = flt.apply_filters(s, {"start_date": "2024-01-01", "end_date": "2026-01-01"}).count()
    assert out == 2


def test_gender_filter_on_absent_column_keeps_nothing(spark):
    s = sales_frame(spark, [{}])
    assert flt.apply_filters(s, {"gender": "female"}).count() == 0


def test_short_series_status_and_fallback(spark):
    rows = [{"date": dt.datetime(2024, 1, d), "total_sales": float(d)} for d in range(1, 10)]
    s = sales_frame(spark, rows)
    assert ts.sufficiency(s).collect()[0]["status"] == "insufficient_data"
    f = ts.feature_table_with_fallback(s).collect()
    assert len(f) == 9 and all(r["sales_lag_14"] == 5.0 for r in f)   # mean of 1..9
    assert ts.feature_table(s).count() == 0


def test_one_customer_rule_segments(spark):
    s = sales_frame(spark, [{"customer_id": "solo", "total_sales": 2000.0}])
    r = seg.rule_segments(seg.rfm(s)).collect()[0]
    assert r["segment"] == "Champions"   # q75 = 1000 for a single customer


def test_segment_counts_include_all_names(spark):
    s = sales_frame(spark, [{"customer_id": "a", "total_sales": 1.0}, {"customer_id": "b", "total_sales": 9.0}])
    c = {r["segment"]: r["customers"] for r in seg.segment_counts(seg.rule_segments(seg.rfm(s))).collect()}
    assert set(c) >= {"Champions", "Loyal Customers", "At Risk", "New/Promising"}
    assert sum(c.values()) == 2


def test_kmeans_fewer_customers_than_clusters(spark):
    s = sales_frame(spark, [{"customer_id": c, "total_sales": v} for c, v in [("a", 1.0), ("b", 50.0), ("c", 900.0)]])
    out, model = seg.kmeans_segments(seg.scale_rfm(seg.rfm(s)), k=4)
    rows = out.collect()
    assert len(rows) == 3 and model.count() == 3
    top = [r for r in rows if r["customer_id"] == "c"][0]
    assert top["segment"] == "Champions"


def test_intents_first_group_wins_and_substrings(spark):
    msgs = spark.createDataFrame([(1, 1, "What are our earnings?"), (2, 1, "show html"),
                                  (3, 1, "worst item please"), (4, 1, "hi")], "msg_id long, user_id long, text string")
    got = {r["msg_id"]: (r["intent"], r["worst"]) for r in it.tag_intents(msgs).collect()}
    assert got[1][0] == "sales"        # 'earning' inside 'earnings' hides the profit group
    assert got[2][0] == "forecast"     # 'ml' inside 'html'
    assert got[3] == ("product", True)
    assert got[4][0] == "help"


def test_entity_match_is_substring_smallest_name(spark):
    s = sales_frame(spark, [{"category": "Tea"}, {"category": "Green Tea"}, {"region": "Asia"}])
    msgs = spark.createDataFrame([(1, 1, "revenue of green tea in asian stores")], "msg_id long, user_id long, text string")
    r = it.match_entities(msgs, s).collect()[0]
    assert r["matched_category"] == "Green Tea" and r["matched_region"] == "Asia"


def test_header_trim_and_ids_kept_numeric(spark):
    df = spark.createDataFrame([(1, " 5 ", "x")], "_row long, ` Qty ` string, `Name  ` string")
    out, numeric = cl.clean_upload(df)
    assert out.columns == ["Qty", "Name", "_row"] or set(out.columns) == {"Qty", "Name", "_row"}
    assert numeric == ["Qty"]


def test_dates_of_many_shapes(spark):
    texts = ["2024-01-05T10:00:00Z", "2024-01-05 10:00", "2024-01-05 10:00:00.5", "Jan 5, 2024",
             "05.01.2024", "20240105", "January 5 2024", "5 Jan 2024", "2024-01-05T10:00:00+02:00",
             "2024-13-05", "soon", "2024-01-05 25:00"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(F.date_format(parse_timestamp("x"), "yyyy-MM-dd HH:mm:ss.S")).collect()]
    day = "2024-01-05 "
    assert got == [day + "10:00:00.0", day + "10:00:00.0", day + "10:00:00.5", *[day + "00:00:00.0"] * 5,
                   day + "08:00:00.0", None, None, None]


def test_day_first_is_decided_by_the_column(spark):
    rows = [("a", "25/12/2023"), ("a", "05/01/2024"), ("b", "12/25/2023"), ("b", "05/01/2024"),
            ("c", "05/01/2024 08:30")]
    df = spark.createDataFrame([(u, i, d) for i, (u, d) in enumerate(rows)], "u string, _row long, date string")
    got = impute_date(df, "2024-06-01 00:00:00", by=("u",))
    days = {(r["u"], r["_row"]): str(r["date"])[:16] for r in got.collect()}
    assert days == {("a", 0): "2023-12-25 00:00", ("a", 1): "2024-01-05 00:00", ("b", 2): "2023-12-25 00:00",
                    ("b", 3): "2024-05-01 00:00", ("c", 4): "2024-05-01 08:30"}


def test_numbers_that_do_not_fit(spark):
    df = spark.createDataFrame([("NaN",), ("inf",), ("1e20",), ("7.9",), ("x",), (None,)], "q string")
    assert [r[0] for r in df.select(impute_quantity("q")).collect()] == [1, 1, 1, 7, 1, 1]
    filled, _ = clean_upload(spark.createDataFrame([(1, "NaN"), (2, "3")], "_row long, v string"))
    assert sorted(r["v"] for r in filled.collect()) == [3.0, 3.0]


def test_types_are_per_upload(spark):
    rows = [(1, i, str(i)) for i in range(1, 6)] + [(1, 6, None)] + [(2, i, "two" if i == 3 else "4") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "u long, _row long, v string")
    got = {(r["u"], r["_row"]): r["v"] for r in clean_upload(df, by=("u",))[0].collect()}
    assert got[1, 6] == "3.0" and got[1, 1] == "1.0" and got[2, 3] == "two"


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    texts = ['TV 40" flat, black', "two\nlines", "plain", '"', "a,b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    write_copy(df, f"{tmp_path}/copy", "csv")
    back = read_raw_csv(spark, f"{tmp_path}/copy")
    assert {int(r["i"]): r["t"] for r in back.collect()} == dict(enumerate(texts))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(lambda: {})  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_mapped_ids_are_not_filled_or_capped(spark):
    rows = [(i, str(i % 3), "5") for i in range(1, 20)] + [(20, "9000", "7"), (21, None, "6")]
    df = spark.createDataFrame(rows, "_row long, `Customer ID` string, Quantity string")
    kept = {r["_row"]: r["Customer ID"] for r in clean_upload(df)[0].collect()}
    assert kept[20] == 9000.0 and kept[21] is None
    strict = {r["_row"]: r["Customer ID"] for r in clean_upload(df, strict_reference=True)[0].collect()}
    assert strict[21] is not None


def test_forecast_start_date(spark):
    s = sales_frame(spark, [{"id": 1}, {"id": 2, "date": dt.datetime(2024, 1, 9)}])
    first = lambda **kw: str(fallback_forecast(s, **kw).agg(F.min("date")).first()[0])
    assert first() == "2024-01-10" and first(start_date="2025-03-01") == "2025-03-01"
