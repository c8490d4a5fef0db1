"""Steps that move, order or repeat no more than their results need."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.running import find_hot, find_hot_of_many
from tallyhouse.operators import usage
from tallyhouse.operators.admission import check_decisions
from tallyhouse.operators.budget import budget_ledger, warn_ladder
from tallyhouse.operators.dedup import dedup_in_window, dedup_within
from tallyhouse.operators.holds import package_drawdown
from tallyhouse.plans import registry
from tallyhouse.plans.cost_store import CostStore
from tallyhouse.plans.metering import clean_usage
from tallyhouse.sources.sample_tables import usage_events
from tallyhouse.streaming import state

from .helpers import events
from .test_admission import CHARGES, REQUESTS
from .test_budget import frame, move

DAY = 86_400_000


def test_dedup_moves_core_columns_only(spark, small):
    for name in ("ttl_dedup", "tenant_packages"):
        plan = registry.all_queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "metadata" not in plan and "environment" not in plan


def test_export_cycles_price_once(spark, small, monkeypatch):
    priced, calls = registry._priced, []
    monkeypatch.setattr(registry, "_priced", lambda *a, **k: calls.append(1) or priced(*a, **k))
    assert registry.all_queries()["export_cycles"](spark, small).count() > 0
    assert len(calls) == 2  # for the cycles, and for the columns of the first marks


def test_landing_writes_from_each_task(spark, tmp_path):
    rows = [{"event_id": f"e{i}", "customer_id": "c", "model_id": "gpt-4o", "ts_ms": i % 2 * 40 * DAY} for i in range(30)]
    setting = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    store = CostStore(spark, str(tmp_path / "store"))
    assert sorted(store.land(events(spark, rows).repartition(3), "b")) == ["1970-01", "1970-02"]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == setting
    landed = store.read("events")
    assert landed.count() == 30 and landed.select("event_id").distinct().count() == 30
    assert landed.select(F.input_file_name()).distinct().count() == 6  # no shuffle puts a month into one file


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_line_items_are_joined_once(spark, small):
    plan = _optimized(usage_events(spark, small))
    assert plan.index("(l_orderkey") < plan.index("(o_custkey")  # customers meet orders below the join with line items


def _counted(spark, frame):
    """The frame, and an accumulator of how often its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(count, frame.schema), made


def test_ttl_dedup_moves_events_once(spark):
    rows = [{"event_id": f"e{i % 20}", "customer_id": "c", "model_id": "m", "ts_ms": i * 7 % 4_000} for i in range(200)]
    frame, made = _counted(spark, events(spark, rows).drop("metadata"))
    kept = dedup_within(frame, 300)
    assert made.value == 200  # measured
    # Dealt to tasks once, whatever is decided there; those without an id are looked for apart.
    assert len(kept.collect()) > 20 and made.value == 600


def test_packages_make_their_events_once(spark):
    rows = [{"event_id": f"e{i}", "customer_id": f"c{i % 3}", "tenant_id": "t", "input_tokens": i % 11, "ts_ms": i} for i in range(200)]
    for schema, owners in (("customer_id string, tokens long", [("c0", 90), ("c1", 0)]), ("tenant_id string, customer_id string, tokens long", [("t", "c0", 90), (None, "c1", 5)])):
        frame, made = _counted(spark, events(spark, rows).drop("metadata"))
        drawn = package_drawdown(frame, spark.createDataFrame(owners, schema))
        assert drawn.filter("accepted").count() > 0 and made.value == 200


def test_ids_are_counted_in_crowded_buckets_only(spark):
    frame = spark.createDataFrame([(f"e{i if i < 300 else 7}",) for i in range(400)], "id string")
    assert find_hot_of_many(frame, ["id"], 200).frame is None
    hot = find_hot_of_many(frame, ["id"], 50)
    assert [r.id for r in hot.frame.collect()] == ["e7"] and hot.total_rows == find_hot(frame, ["id"], 50).total_rows == 101


def _copies(spark, seed=3):
    pick = random.Random(seed)
    rows = [
        {
            "event_id": pick.choice(["a", "b", None]), "customer_id": "c", "model_id": "gpt-4o", "ts_ms": pick.choice([0, 1, 20_000]),
            "input_tokens": pick.randrange(3), "latency_ms": pick.randrange(2), "session_id": pick.choice(["s", "t", None]),
            "metadata": pick.choice([None, {"room_id": "1", "feature": "x"}, {"feature": "y"}]),
        }
        for _ in range(60)
    ]
    return events(spark, rows)


def test_dedup_moves_a_copy_once(spark):
    copies = _copies(spark)
    kept = dedup_in_window(copies)
    assert "min_by" not in _optimized(kept)
    assert [f.dataType for f in kept.select(*copies.columns).schema] == [f.dataType for f in copies.schema]
    given = {(r.event_id, r.ts_ms, r.input_tokens, r.session_id, str(sorted((r.metadata or {}).items()))) for r in copies.collect()}
    assert {(r.event_id, r.ts_ms, r.input_tokens, r.session_id, str(sorted((r.metadata or {}).items()))) for r in kept.collect()} <= given


def test_columns_after_the_last_that_is_read_decide_nothing(spark):
    copies = _copies(spark).drop("metadata").withColumn("metadata", F.lit(None).cast("map<string,string>"))
    few = clean_usage(copies, registry.STANDARD, only=())
    assert "session_id" not in few.columns and "latency_ms" not in few.columns
    whole = clean_usage(copies, registry.STANDARD).select(*few.columns)
    assert few.exceptAll(whole).isEmpty() and whole.exceptAll(few).isEmpty()


def test_priced_months_are_written_without_another_shuffle(spark, tmp_path, monkeypatch):
    dealt, replace = {}, CostStore._replace
    monkeypatch.setattr(CostStore, "_replace", lambda self, df, name, *by, deal=True: dealt.update({name: deal}) or replace(self, df, name, *by, deal=deal))
    store = CostStore(spark, str(tmp_path / "store"))
    rows = [{"event_id": f"e{i}", "customer_id": "c", "model_id": "gpt-4o", "ts_ms": i % 2 * 40 * DAY, "metadata": {"feature": "x"}} for i in range(30)]
    store.add(events(spark, rows), "b", registry.STANDARD)
    assert dealt["priced"] is False and store.read("priced").count() == 30


def test_warnings_of_all_rungs_are_counted_in_one_pass(spark):
    moves = [move("c", 1, "set", 100), *[move("c", 10 + i, "cost", 20, ref=str(i)) for i in range(6)]]
    plan = warn_ladder(budget_ledger(frame(spark, moves)).localCheckpoint())
    tree = _optimized(plan)
    assert tree.index("Generate explode") < tree.index("_run0")  # the runs are summed below, before rungs become rows


def test_each_gate_moves_requests_once(spark):
    request = [(None, "c", "r", 5, 1, "sp", "se", "k")]
    charge = [(None, "c", 1, 1, "sp", "se", "k")]
    got = check_decisions(
        spark.createDataFrame(request, REQUESTS), budget_ledger(frame(spark, [move("c", 0, "set", 9)])), spark.createDataFrame(charge, CHARGES),
        session_caps=spark.createDataFrame([("se", 1)], "session_id string, session_cap_micro bigint"),
        key_caps=spark.createDataFrame([("k", 9, 9)], "key_id string, daily_cap_micro bigint, monthly_cap_micro bigint"),
    ).select("request_id", "reason")
    plan = _optimized(got)
    assert "AS _request#" not in plan  # no copy of the whole request beside its columns
    assert [r.reason for r in got.collect()] == ["hierarchy_cap"]


def test_minutes_of_the_rollup_move_once(spark):
    rows = [
        {"event_id": f"e{i}", "tenant_id": "t" if i % 3 else None, "customer_id": f"c{i % 2}", "model_id": "gpt-4o", "ts_ms": None if i == 7 else 1_780_272_000_000 + i * 7_200_000,
         "input_tokens": i}
        for i in range(400)
    ]
    priced = events(spark, rows).withColumn("cost_micro", F.col("input_tokens") * 10)
    out = io.StringIO()
    with redirect_stdout(out):
        usage.usage_rollup(priced, ("minute",)).explain("simple")
    assert out.getvalue().count("Exchange") == 1
    whole = usage.usage_rollup(priced)
    for grain, form in usage.GRAIN_FORMAT.items():
        want = priced.groupBy("tenant_id", "customer_id", F.date_format(F.timestamp_millis("ts_ms"), form).alias("bucket")).agg(
            F.count("*").alias("event_count"), F.sum("cost_micro").alias("cost_micro")
        )
        got = whole.filter(F.col("grain") == grain).select(want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == want.count()


def test_a_batch_of_stamps_moves_its_events_once(spark, tmp_path, monkeypatch):
    rows = [
        {"event_id": f"e{i}", "tenant_id": "t" if i % 3 else None, "customer_id": f"c{i % 4}", "model_id": "gpt-4o", "ts_ms": 1_780_272_000_000 + i, "input_tokens": i}
        for i in range(120)
    ]
    frame = events(spark, rows).withColumn("arrival_seq", F.substring("event_id", 2, 9).cast("long"))
    moved = []
    real = state.running

    def watched(*args, **kwargs):
        stamped = real(*args, **kwargs)
        moved.append(stamped._jdf.queryExecution().optimizedPlan().toString())
        return stamped

    monkeypatch.setattr(state, "running", watched)
    monkeypatch.setattr(state, "null_safe_join", lambda *a: pytest.fail("events are joined with the totals"), raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for hot_rows in (1_000, 10):
        place = f"{tmp_path}/{hot_rows}"
        for n in range(3):
            frame.filter(f"arrival_seq % 3 = {n}").write.mode("append").parquet(f"{place}/in")
            stream = spark.readStream.schema(frame.schema).parquet(f"{place}/in")
            state.stamp_volume_batches(stream, ["arrival_seq"], f"{place}/table", f"{place}/checkpoint", hot_rows=hot_rows).awaitTermination()
        got = spark.read.parquet(f"{place}/table/events")
        assert got.count() == len(rows) and "_event" not in got.columns
        arrived = sorted(rows, key=lambda r: (int(r["event_id"][1:]) % 3, int(r["event_id"][1:])))
        sums, want = {}, {}
        for r in arrived:
            key = r["tenant_id"], r["customer_id"]
            want[r["event_id"]] = sums.get(key, 0)
            sums[key] = sums.get(key, 0) + r["input_tokens"]
        assert {r.event_id: r.volume_before for r in got.collect()} == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in moved[1] and "Union" in moved[1]
