"""Partial aggregates, rank index, calendar ranges, entity index, date and number shapes, profile."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tillsight.functions.columns import date_orders, number_or_nan, parse_timestamp
from tillsight.operators import clean as cl
from tillsight.operators import filters as flt
from tillsight.operators import intents as it
from tillsight.operators import rank_index as rix
from tillsight.operators.ledger import ledger_page
from tillsight.plans import dashboard as dash
from tillsight.plans import partials as part
from tillsight.plans.catalog import sales
from tillsight.sinks.writers import load_sales, read_sales
from tillsight.sources.tables import Tables


def _payload(df):
    return {r.user_id: r.payload for r in df.collect()}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dashboard_of_partials_follows_a_reload_and_reads_no_sales_row(spark, tmp_path):
    s = sales(Tables(spark, SMALL))
    table, partials = str(tmp_path / "sales"), str(tmp_path / "partials")
    part.load_with_partials(s, table, partials)
    first = _payload(part.dashboard_of_partials(part.read_partials(spark, partials)))
    assert first == _payload(dash.dashboard_payload(read_sales(spark, table)))
    again = s.where("user_id = 3 AND dataset_id = 1996 AND quantity < 20")
    part.load_with_partials(again, table, partials)
    bundle = part.dashboard_of_partials(part.read_partials(spark, partials))
    second = _payload(bundle)
    assert second == _payload(dash.dashboard_payload(read_sales(spark, table)))
    assert {u for u in first if first[u] != second[u]} == {3}
    assert bundle.inputFiles() and all("/partials/" in f for f in bundle.inputFiles())


def test_partials_with_missing_values(spark, tmp_path):
    s = sales(Tables(spark, SMALL)).where("user_id = 1")
    hole = lambda c, m: F.when(F.pmod(F.xxhash64("id"), F.lit(m)) > 0, F.col(c)).alias(c)
    s = s.select(*[hole(c, 3) if c in ("category", "customer_id", "region", "store_name", "inventory_level") else c
                   for c in s.columns])
    table, partials = str(tmp_path / "sales"), str(tmp_path / "partials")
    part.load_with_partials(s, table, partials)
    assert _payload(part.dashboard_of_partials(part.read_partials(spark, partials))) == _payload(
        dash.dashboard_payload(read_sales(spark, table)))


@pytest.mark.parametrize("column,ascending", [("total_sales", True), ("product_name", False)])
def test_deep_pages_of_a_rank_index(spark, tmp_path, column, ascending):
    s = sales(Tables(spark, SMALL)).select("id", "user_id", "product_name", "total_sales")
    index = rix.build_rank_index(s, column, str(tmp_path / "index"), ascending, ranges=20)
    rows = lambda df: sorted(map(tuple, df.select("user_id", "pos", "id", "caption").collect()))
    for page in (1, 2, 40, 10 ** 9):
        assert rows(rix.indexed_page(index, page)) == rows(ledger_page(s, column, ascending, page))
    one = spark.createDataFrame([(3,)], "user_id long")
    got = rix.indexed_page(index, 10_000, tenant=one)
    assert {r.user_id for r in got.collect()} == {3} and got.count() > 0
    # of the index's ranges, the page opens one or two
    wanted = re.search(r"PartitionFilters: \[[^\]]*_range#\d+L? (?:= (\d+)|IN \(([\d,]+)\))", _plan(got))
    numbers = {int(n) for n in (wanted.group(1) or wanted.group(2)).split(",")}
    every = {r[0] for r in index.rows.select("_range").distinct().collect()}
    assert len(every) >= 15 and 1 <= len(numbers) <= 2 and numbers <= every


def test_calendar_filters_reach_the_scan_as_ranges(spark, tmp_path):
    load_sales(sales(Tables(spark, SMALL)), str(tmp_path / "sales"))
    s = read_sales(spark, str(tmp_path / "sales"))
    for filters in ({"year": "1997"}, {"quarter": "Q2"}, {"month": "May"}, {"year": 1996, "quarter": "Q4"},
                    {"quarter": "Q1", "month": "march"}, {"quarter": "Q1", "month": "may"},
                    {"year": "nineteen"}, {"month": "brumaire"}, {"quarter": "Q9", "year": "1997"}, {"year": "1850"}):
        f = {k: str(v) for k, v in filters.items()}
        want = s
        if "year" in f:
            want = want.where(F.year("date").cast("string") == f["year"])
        if "quarter" in f:
            want = want.where(F.concat(F.lit("Q"), F.quarter("date").cast("string")) == f["quarter"])
        if "month" in f:
            want = want.where(F.lower(F.date_format("date", "MMMM")) == f["month"].lower())
        got = flt.apply_filters(s, filters)
        key = lambda df: sorted(r.id for r in df.select("id").collect())
        assert key(got) == key(want), filters
    plan = _plan(flt.apply_filters(s, {"year": "1997", "quarter": "Q2"}))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert "GreaterThanOrEqual(date,1997-04-01" in pushed and "LessThan(date,1997-07-01" in pushed
    assert "PushedFilters: []" not in _plan(flt.apply_filters(s, {"month": "may"}))
    assert flt.calendar_ranges({"quarter": "Q4"}, range(1996, 1998)) == [
        (dt.date(1996, 10, 1), dt.date(1997, 1, 1)), (dt.date(1997, 10, 1), dt.date(1998, 1, 1))]
    assert flt.calendar_ranges({"year": "1996"}, range(0)) == [(dt.date(1996, 1, 1), dt.date(1997, 1, 1))]


def test_entities_by_rarest_gram_equal_a_plain_search(spark):
    values = ["Home", "home office", "TV", "A", "ab", "Büro", "Café & Co", "  x", "aaaa", "garden tools"]
    rows = [(u, v, w) for u in (1, 2) for i, (v, w) in enumerate(zip(values, values[::-1])) if (i + u) % 3]
    s = spark.createDataFrame(rows, "user_id long, category string, region string")
    texts = ["Sales for HOME OFFICE?", "tv and büro", "AAAAA", "", None, "a", "café & co gardens", "no match: zq",
             "garden  tools", "garden tools  x"]
    m = spark.createDataFrame([(i * 10 + u, u, t) for u in (1, 2, 3) for i, t in enumerate(texts)],
                              "msg_id long, user_id long, text string")
    got = {(r.msg_id, r.user_id): (r.matched_category, r.matched_region) for r in it.entity_table(m, s).collect()}
    want = {}
    for r in m.collect():
        hit = [min((x[d] for x in rows if x[0] == r.user_id and r.text is not None
                    and x[d].lower() in r.text.lower()), default=None) for d in (1, 2)]
        want[r.msg_id, r.user_id] = tuple(hit)
    assert got == want


def test_entity_index_explodes_no_more_than_the_distinct_grams(spark):
    texts = spark.createDataFrame([(1, "abcabcabc"), (1, "ab"), (1, "")], "user_id long, lt string")
    assert [r[0] for r in texts.select(F.size(it.grams(F.col("lt"), 3))).collect()] == [3, 0, 0]
    values = it.dimension_values(spark.createDataFrame(
        [(1, "abcd", "bcde"), (1, "bcdf", "x")], "user_id long, category string, region string"))
    chosen = {r.lv: r.gram for r in it.rarest_grams(values).collect()}
    assert chosen == {"abcd": "abc", "bcde": "cde", "bcdf": "cdf", "x": "x"}


DATES = {"5-Jan-2024": "2024-01-05 00:00:00", "2024-01": "2024-01-01 00:00:00", "01/05/24": "2024-01-05 00:00:00",
         "05-01-24": "2024-01-05 00:00:00", "2024-01-05 10:00 PM": "2024-01-05 22:00:00",
         "1/5/2024 3:04 PM": "2024-01-05 15:04:00", "05.01.99": "1999-01-05 00:00:00", "5 Jan 68": "2068-01-05 00:00:00",
         "2024-01-05 12:30 am": "2024-01-05 00:30:00", "2024-01-05 13:30 pm": None, "May-2024": "2024-05-01 00:00:00",
         "January 5, 2024": "2024-01-05 00:00:00", "2024-01-05T10:11:12+02:00": "2024-01-05 08:11:12",
         "31/31/2024": None, "2023-02-29": None, "12:30": None, "1d": None, "": None, "5-Foo-2024": None}


def test_date_shapes(spark):
    df = spark.createDataFrame([(t,) for t in DATES], "t string")
    assert {r.t: r.d for r in df.select("t", parse_timestamp("t").cast("string").alias("d")).collect()} == DATES


@pytest.mark.parametrize("texts,want", [
    (["13/01/2024", "5/6/2024"], ["2024-01-13", "2024-06-05"]), (["5/6/24", "1/13/24"], ["2024-05-06", "2024-01-13"]),
    (["01-13-2024", "02-03-2024"], ["2024-01-13", "2024-02-03"]), (["13.1.2024 10:00", "1.2.2024"], ["2024-01-13", "2024-02-01"]),
    (["13/1/2024", "1/13/2024", "2/3/2024"], [None, "2024-01-13", "2024-02-03"])])
def test_day_order_is_decided_by_the_column(spark, texts, want):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.crossJoin(df.agg(date_orders("t").alias("o"))).orderBy("i").select(
        F.to_date(parse_timestamp("t", day_first=F.col("o"))).cast("string"))
    assert [r[0] for r in out.collect()] == want


def test_codes_are_no_numbers(spark):
    texts = {"1d": None, "2F": None, "3L": None, "0x1A": None, "1_000": None, "1,000": None, "": None, "1e": None,
             "1.5": 1.5, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, " +7 ": 7.0, "-Infinity": float("-inf")}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.x for r in df.select("t", number_or_nan("t").alias("x")).collect()} == texts
    up = spark.createDataFrame([(i, c, str(i)) for i, c in enumerate(["1d", "2F", "3d"])], "_row long, code string, qty string")
    out, numeric = cl.clean_upload(up)
    assert numeric == ["qty"] and [r.code for r in out.orderBy("_row").collect()] == ["1d", "2F", "3d"]


def test_profile_counts_what_cleaning_did(spark, tmp_path):
    rows = [(1, "a", "1"), (2, "a", "1"), (3, None, "2"), (4, " nan ", "3"), (5, "b", None), (6, "b", "900"),
            (7, "c", "2"), (8, "d", "2")]
    raw = spark.createDataFrame(rows, "_row long, label string, qty string")
    profile = cl.CleaningProfile()
    out, _ = cl.clean_upload(raw, profile=profile)
    out.write.parquet(str(tmp_path / "out"))
    got = {(r.metric, r.column): r["count"] for r in profile.rows(spark).collect()}
    assert got == {("rows_in", None): 8, ("duplicates", None): 1, ("rows_out", None): 7, ("missing", "label"): 2,
                   ("missing", "qty"): 1, ("filled", "label"): 2, ("filled", "qty"): 1, ("capped", "qty"): 1}
    assert os.path.exists(tmp_path / "out")
