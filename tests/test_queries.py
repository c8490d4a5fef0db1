"""Every registered query against its SQL twin, and the plans that matter."""

import io
from contextlib import redirect_stdout

import pytest

import check
from __spark_entry__ import entry, oracle_sql
from __spark_entry__ import queries as registered
from oracle import oracle_queries
from tallyhouse.plans.registry import all_queries as queries

SQL = oracle_queries()


@pytest.fixture(scope="module")
def duck(request):
    return check.connect("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(queries()) <= set(registered()) and set(SQL) <= set(oracle_sql()) <= set(registered())
    assert set(queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, small, name):
    result = check.compare(spark, duck, small, name, SQL.get(name))
    assert result.startswith(("ok", "rows")), result


def test_entry(spark):
    assert entry(spark).count() == 10


def plan(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


def test_flat_pricing_orders_nothing_and_joins_by_broadcast(spark, small):
    text = plan(queries()["flat_prices"](spark, small))
    assert "Window" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "SortMergeJoin" not in text


def test_scans_read_only_what_is_needed(spark, small):
    text = plan(queries()["total_tokens"](spark, small))
    assert "l_extendedprice" not in text and "o_totalprice" not in text and "c_name" not in text


def test_top_spans_cuts_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plan(queries()["top_spans"](spark, small))


def test_top_customers_need_no_full_sort(spark, small):
    assert "TakeOrderedAndProject" in plan(queries()["top_customers_by_cost"](spark, small))


@pytest.mark.parametrize("name", ["root_cause", "pricing_recommendations", "profitability_products", "live_series"])
def test_no_cross_joins(spark, small, name):
    text = plan(queries()[name](spark, small))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
