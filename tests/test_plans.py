"""Physical-plan properties of the registered queries."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tillsight.operators.filters import tenant_sales
from tillsight.session import scratch_path
from tillsight.sinks.writers import load_sales, read_sales
from tillsight.sources.fixtures import sales_from_star
from tillsight.sources.tables import Tables

PYTHON_NODES = ["BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"]
AGGREGATES = ["kpi_summary", "category_distribution", "trend_monthly", "top_products", "regional_sales",
              "ledger_kpis", "rfm", "segment_rules", "ts_features", "intent_tags", "reply_text",
              "etl_canonical", "intent_entity_match", "recommendations", "forecast_metrics"]


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", AGGREGATES)
def test_no_python_udf(spark, key):
    p = plan(E.queries()[key](spark, SMALL))
    assert not any(n in p for n in PYTHON_NODES), key


@pytest.mark.parametrize("key", ["kpi_summary", "category_distribution", "top_products", "rfm", "ts_features"])
def test_no_single_partition_exchange(spark, key):
    p = plan(E.queries()[key](spark, SMALL))
    assert "SinglePartition" not in p, key


def test_columns_pruned_at_scan(spark):
    p = plan(sales_from_star(Tables(spark, SMALL)))
    li = [ln for ln in p.splitlines() if "ReadSchema" in ln and "l_orderkey" in ln]
    assert li and "l_tax" not in li[0] and "l_returnflag" not in li[0]
    k = plan(E.queries()["kpi_summary"](spark, SMALL))
    scans = [ln for ln in k.splitlines() if "ReadSchema" in ln and "total_sales" in ln]
    assert scans and all("brand" not in ln and "supplier" not in ln for ln in scans)


def test_tenant_filter_prunes_partitions(spark):
    path = scratch_path(spark, "plan_table")
    load_sales(sales_from_star(Tables(spark, SMALL)), path)
    p = plan(tenant_sales(read_sales(spark, path), 3))
    assert "PartitionFilters" in p and "user_id" in p.split("PartitionFilters")[1].splitlines()[0]


def test_low_stock_filter_pushed_to_parquet(spark):
    p = plan(E.queries()["filter_low_stock"](spark, SMALL))
    assert "PushedFilters" in p


def test_dashboard_leaves_sales_scan_uncached(spark):
    """Building the dashboard must not cache the shared fact table: later
    queries still read Parquet with pushed filters."""
    E.queries()["dashboard_payload"](spark, SMALL).count()
    p = plan(E.queries()["filter_low_stock"](spark, SMALL))
    assert "InMemoryRelation" not in p and "PushedFilters" in p
