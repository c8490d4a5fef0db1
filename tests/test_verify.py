"""Digests of tables, and rebuilds compared with what is kept."""

import pytest

from tallyhouse.plans.metering import rebuild
from tallyhouse.plans.verify import differing_parts, table_digest, table_digests
from tallyhouse.sources import price_lists
from tallyhouse.sources.catalog import catalog_from

from .helpers import events
from .test_budget import SCHEMA

STANDARD = catalog_from(price_lists.STANDARD)
DDL = "t string, name string, n bigint, share double"
ROWS = [("a", "x", 1, 0.5), ("a", "x", 1, 0.5), ("a", None, 2, None), (None, "", 3, 1 / 3), ("b", "12", 4, 2.0)]


def digest(spark, rows, ddl=DDL):
    return tuple(table_digest(spark.createDataFrame(rows, ddl)).first())


def test_digest_knows_rows_but_no_order(spark):
    whole = digest(spark, ROWS)
    assert whole[0] == 5 and digest(spark, ROWS[::-1]) == whole
    shuffled = spark.createDataFrame(ROWS, DDL).repartition(5).select("n", "t", "share", "name")
    assert tuple(table_digest(shuffled).first()) == whole
    changed = [
        ROWS[1:], [*ROWS, ROWS[0]], [("a", "x", 2, 0.5), *ROWS[1:]], [*ROWS[:2], ("a", "", 2, None), *ROWS[3:]],
        [*ROWS[:3], ("", "", 3, 1 / 3), ROWS[4]], [*ROWS[:4], ("b1", "2", 4, 2.0)],
    ]
    assert len({digest(spark, r) for r in changed} | {whole}) == len(changed) + 1
    assert digest(spark, []) == (0, "0")


def test_nested_columns_are_refused(spark):
    with pytest.raises(TypeError, match="nested"):
        table_digest(spark.createDataFrame([([1],)], "a array<int>"))


def test_parts_that_differ(spark):
    left = spark.createDataFrame(ROWS, DDL)
    same = left.repartition(3)
    assert differing_parts(left, same, ["t"]).count() == 0
    # One part lacks a copy, one has another value, one is on the right only, and the part without a name is the same.
    right = spark.createDataFrame([ROWS[0], *ROWS[2:4], ("b", "12", 5, 2.0), ("c", "new", 1, 1.0)], DDL)
    found = {r.t: r.rows_diff for r in differing_parts(left, right, ["t"]).collect()}
    assert found == {"a": 1, "b": 0, "c": -1}
    assert differing_parts(left.limit(0), right.limit(0), ["t"]).count() == 0


def test_rebuild_with_a_path_writes_once_and_gives_the_same(spark, tmp_path):
    rows = [
        {"event_id": f"e{i}", "tenant_id": f"t{i % 2}", "customer_id": f"c{i % 3}", "model_id": "gpt-4o-mini", "ts_ms": 1_704_067_200_000 + i * 4_000,
         "input_tokens": 1000 * i, "output_tokens": 10, "parent_span_id": f"s{i % 4}", "session_id": "x", "key_id": "k", "metadata": {"feature": "chat"}}
        for i in range(40)
    ]
    seeds = spark.createDataFrame([], SCHEMA)
    here = rebuild(events(spark, rows), seeds, STANDARD)
    there = rebuild(events(spark, rows), seeds, STANDARD, path=str(tmp_path))
    assert len(there) == 13
    one, two = ({r.table_name: (r.rows, r.digest) for r in table_digests(t).collect()} for t in (here, there))
    assert one == two and one["usage_by_customer"][0] == 6 and one["budget_state"] == (0, "0")
    missing = rebuild(events(spark, [r for r in rows if r["event_id"] != "e7"]), seeds, STANDARD)
    found = differing_parts(there["usage_by_customer"], missing["usage_by_customer"], ["tenant_id"]).collect()
    assert [(r.tenant_id, r.rows_diff) for r in found] == [("t1", 0)]
