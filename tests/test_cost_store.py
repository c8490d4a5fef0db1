"""Cost tables by month: late events, repeated batches, pruned readers."""

import io
import os
from contextlib import redirect_stdout

import pytest

from tallyhouse.operators import intelligence as intel
from tallyhouse.plans.cost_store import CostStore
from tallyhouse.plans.metering import cost_tables, priced_usage
from tallyhouse.sources import price_lists
from tallyhouse.sources.catalog import catalog_from

from .helpers import events

MAY, JUNE, JULY = 1_777_593_600_000, 1_780_272_000_000, 1_782_864_000_000
TIERED, STANDARD = catalog_from(price_lists.TIERED), catalog_from(price_lists.STANDARD)


def row(n, ts_ms, customer="c", tokens=600_000, model="claude-sonnet-4"):
    return {"event_id": f"e{n}", "tenant_id": "t", "customer_id": customer, "model_id": model, "ts_ms": ts_ms, "input_tokens": tokens, "metadata": {"feature": "chat"}}


def rows(tables):
    return {n: sorted(map(str, (sorted(r.asDict().items()) for r in t.collect()))) for n, t in tables.items()}


def files(path, name):
    """Files of each month of a table."""
    found = {}
    for folder, _, names in os.walk(f"{path}/{name}"):
        month = next((p for p in folder.split("/") if p.startswith("period=")), None)
        if month:
            found.setdefault(month, set()).update(f"{folder}/{n}" for n in names if n.endswith(".parquet"))
    return found


@pytest.mark.parametrize("catalog", [TIERED, STANDARD])
def test_late_events_change_one_month_and_all_prices_after_them(spark, tmp_path, catalog):
    store = CostStore(spark, str(tmp_path))
    first = [row(i, start + i * 60_000) for i, start in enumerate([MAY, MAY, JUNE, JUNE, JULY, JULY])]
    late = [row(100, JUNE), row(3, JUNE + 3 * 60_000)]  # one that comes before the month's others, one copy
    assert sorted(store.add(events(spark, first), "a", catalog)) == ["2026-05", "2026-06", "2026-07"]
    before = {n: files(tmp_path, n) for n in ("priced", "model_costs", "dim_costs", "daily")}
    assert store.add(events(spark, late), "b", catalog) == ["2026-06"]
    for name, old in before.items():
        new = files(tmp_path, name)
        assert {m for m in new if new[m] != old[m]} == {"period=2026-06"}, name
    want = cost_tables(priced_usage(events(spark, first + late), catalog, ("metadata",)))
    assert rows({n: t.select(*want[n].columns) for n, t in store.tables().items()}) == rows(want)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = CostStore(spark, str(tmp_path))
    batch = events(spark, [row(1, MAY), row(2, JUNE), {**row(3, JUNE), "event_id": None}])
    store.add(batch, "a", STANDARD)
    once = rows(store.tables())
    store.add(batch, "a", STANDARD)
    assert rows(store.tables()) == once
    assert store.read("events").count() == 3


def test_events_without_time_and_empty_batches(spark, tmp_path):
    store = CostStore(spark, str(tmp_path))
    assert store.add(events(spark, []), "none", STANDARD) == []
    assert set(store.add(events(spark, [row(1, None), row(2, MAY)]), "a", STANDARD)) == {None, "2026-05"}
    assert set(store.read("priced").select("period").distinct().toPandas()["period"]) == {None, "2026-05"}
    assert store.add(events(spark, []), "b", STANDARD) == []
    assert store.tables()["customer_costs"].filter("period = '2026-05'").count() == 1


def test_reports_open_the_folders_of_their_months_only(spark, tmp_path):
    store = CostStore(spark, str(tmp_path))
    store.add(events(spark, [row(i, t) for i, t in enumerate([MAY, JUNE, JULY])]), "a", STANDARD)
    t = store.tables()
    found = intel.root_cause(t["customer_costs"], t["model_costs"], t["dim_costs"], "2026-07", "2026-06")
    out = io.StringIO()
    with redirect_stdout(out):
        found.explain("formatted")
    scans = [line for line in out.getvalue().splitlines() if line.startswith("PartitionFilters")]
    assert scans and all("2026-06" in s and "2026-07" in s for s in scans)
    assert [r.key for r in found.filter("dimension = 'model'").collect()] == ["claude-sonnet-4"]


def test_a_lot_lands_in_few_files_however_many_tasks_bring_it(spark, tmp_path):
    store = CostStore(spark, str(tmp_path))
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows_ = [row(i, MAY if i % 2 else JUNE) for i in range(8 * tasks)]
    store.land(events(spark, rows_).repartition(tasks), "a")
    found = files(tmp_path, "events")
    assert set(found) == {"period=2026-05", "period=2026-06"}
    assert all(0 < len(names) <= tasks / 2 for names in found.values())
    assert store.read("events").count() == len(rows_)


@pytest.mark.parametrize("catalog", [TIERED, STANDARD])
def test_priced_rows_come_in_as_few_tasks_as_asked_for(spark, catalog):
    rows_ = [row(i, MAY + i * 1_000, customer=f"c{i % 7}") for i in range(60)]
    rows_ += [{**row(n, JUNE), "event_id": None} for n in range(20)] + rows_[:5]
    frame = events(spark, rows_).repartition(20)
    few, plain = priced_usage(frame, catalog, tasks=2), priced_usage(frame, catalog)
    assert few.rdd.getNumPartitions() <= 4
    assert rows({"t": few}) == rows({"t": plain}) and few.count() == 80
