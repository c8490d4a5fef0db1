"""Queries of the operators against their SQL twins."""

import pytest

import check
from __spark_entry__ import queries
from tallyhouse.llm.queries import ORACLES, QUERIES


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    folder = "/root/testdata/sf0.01"
    assert check.compare(spark, check.connect(folder), folder, name, ORACLES[name]).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
