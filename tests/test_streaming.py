"""Streams are fed as files, one per micro-batch, and compared with batch."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import usage
from tallyhouse.operators.budget import budget_alerts, budget_ledger
from tallyhouse.operators.cleaning import normalize_models
from tallyhouse.operators.pricing import price_events
from tallyhouse.operators.volume import stamp_volume
from tallyhouse.plans.metering import priced_usage, rebuild
from tallyhouse.schema import USAGE_EVENTS
from tallyhouse.sources import price_lists
from tallyhouse.sources.catalog import catalog_from
from tallyhouse.sources.events import decode_events, encode_events, land_events, read_events, read_events_stream
from tallyhouse.streaming import late, sinks, state, windows

from .helpers import by, events
from .test_budget import SCHEMA, frame, random_moves

STANDARD = catalog_from(price_lists.STANDARD)
TIERED = catalog_from(price_lists.TIERED)


def feed(batches, path):
    """Write frames as one parquet file each, in order."""
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(str(path))


def stream_of(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(query):
    query.awaitTermination()


def traffic(n, seed=2):
    rng = random.Random(seed)
    return [
        {"event_id": f"e{i}", "customer_id": f"c{rng.randrange(3)}", "model_id": rng.choice(["gpt-4o-mini", "claude-sonnet-4"]),
         "ts_ms": 1_704_067_200_000 + i * 700, "input_tokens": rng.randrange(1, 3_000_000), "output_tokens": rng.randrange(1, 900),
         "parent_span_id": rng.choice([None, "s1", "s2"]), "latency_ms": rng.randrange(100)}
        for i in range(n)
    ]


def test_late_triple(spark):
    rows = [(0, 1, 1_000), (0, 2, 10_001), (0, 3, 5_000), (0, 4, 15_000), (0, 5, 5_001), (1, 6, 5_000)]
    arrivals = spark.createDataFrame(rows, "source_partition int, arrival_seq bigint, ts_ms bigint")
    for hot_rows in (10**6, 2):
        on_time, behind = late.split_late(arrivals, hot_rows=hot_rows)
        # At 10 001 the watermark is 5 001: the window to 10 000 is open. At
        # 15 000 it closes; the other partition has a clock of its own.
        assert [r.arrival_seq for r in behind.collect()] == [5]
        assert on_time.count() == 5


def test_late_split_stream_equals_batch_and_replays_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 2, i, max(0, i * 900 - rng.choice([0, 0, 0, 30_000])), f"e{i}") for i in range(200)]
    arrivals = spark.createDataFrame(rows, "source_partition int, arrival_seq bigint, ts_ms bigint, event_id string")
    feed([arrivals.filter(f"arrival_seq BETWEEN {a} AND {a + 49}") for a in range(0, 200, 50)], tmp_path / "in")
    table = str(tmp_path / "out")
    run(late.split_late_stream(stream_of(spark, arrivals.schema, tmp_path / "in"), table, str(tmp_path / "cp")))
    _, behind = late.split_late(arrivals)
    want = {r.event_id for r in behind.collect()}
    assert want == {r.event_id for r in spark.read.parquet(f"{table}/late").collect()}
    assert 0 < len(want) < 200
    assert late.replay_dlq(spark, f"{table}/late", f"{table}/on_time", dry_run=True) == len(want)
    assert late.replay_dlq(spark, f"{table}/late", f"{table}/on_time", max_rows=3) == 3
    assert late.replay_dlq(spark, f"{table}/late", f"{table}/on_time") == len(want) - 3
    assert late.replay_dlq(spark, f"{table}/late", f"{table}/on_time") == 0
    assert spark.read.parquet(f"{table}/on_time").count() == 200


def test_json_events_to_windows_exactly_once(spark, tmp_path):
    """The full path on a stream: decode, dedup, price, window, idempotent sink."""
    rows = [r for row in traffic(60) for r in ([row, row] if row["ts_ms"] % 5 == 0 else [row])]
    start = 1_704_067_200_000
    frame_of = events(spark, rows)
    text = frame_of.select(encode_events(frame_of).alias("value"), "ts_ms")
    broken = spark.createDataFrame([("{not json", start)], "value string, ts_ms bigint")
    for low in (0, 15_000, 30_000):
        part = text.unionByName(broken).filter(F.col("ts_ms").between(start + low, start + low + 14_999))
        part.select("value").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    raw = read_events_stream(spark, str(tmp_path / "in"), max_files=1)
    ok, _ = decode_events(raw)
    named = normalize_models(windows.with_event_time(ok), STANDARD)
    closed = windows.usage_windows_stream(windows.dedup_window_stream(price_events(named, STANDARD)))
    run(sinks.write_windows(closed, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    newest = max(r["ts_ms"] for r in rows)
    want = usage.usage_windows(priced_usage(frame_of, STANDARD)).filter(
        F.col("window_end_ms") <= newest - windows.DELAY_MS
    ).select(got.columns)
    assert got.count() > 10
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    frame_of = events(spark, traffic(80))
    path, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        named = normalize_models(stream_of(spark, frame_of.schema, path), TIERED)
        run(sinks.write_windows(state.stamp_volume_stream(named), out, checkpoint))

    start = 1_704_067_200_000
    feed([frame_of.filter(F.col("ts_ms") < start + 20_000).orderBy("ts_ms")], path)
    go()
    feed([frame_of.filter(F.col("ts_ms") >= start + 20_000).orderBy("ts_ms")], path)
    go()
    got = spark.read.parquet(out).select("event_id", "volume_before")
    want = stamp_volume(normalize_models(frame_of, TIERED)).select("event_id", "volume_before")
    assert sorted(got.collect()) == sorted(want.collect())


def test_volume_batches_split_hot_keys(spark, tmp_path):
    frame_of = normalize_models(events(spark, traffic(90)), TIERED)
    start = 1_704_067_200_000
    feed([frame_of.filter(F.col("ts_ms").between(start + a, start + a + 19_999)) for a in range(0, 80_000, 20_000)], tmp_path / "in")
    run(state.stamp_volume_batches(
        stream_of(spark, frame_of.schema, tmp_path / "in"), ["ts_ms", "event_id"], str(tmp_path / "out"), str(tmp_path / "cp"), hot_rows=4,
    ))
    got = spark.read.parquet(str(tmp_path / "out" / "events")).select("event_id", "volume_before")
    assert sorted(got.collect()) == sorted(stamp_volume(frame_of).select("event_id", "volume_before").collect())


def test_months_out_of_order_keep_their_totals(spark, tmp_path):
    """January, February, March, April, a far future, January again: one event per micro-batch."""
    times = ["2024-01-05", "2024-02-05", "2024-03-05", "2024-04-05", "2099-01-01", "2024-01-06", "2024-04-06"]
    ms = lambda day: int(pd.Timestamp(day, tz="UTC").timestamp() * 1000)
    rows = [{"event_id": str(i), "customer_id": "c", "model_id": "m", "ts_ms": ms(t), "input_tokens": 100 + i} for i, t in enumerate(times)]
    feed([events(spark, [r]) for r in rows], tmp_path / "in")
    stream = stream_of(spark, USAGE_EVENTS, tmp_path / "in")
    run(sinks.write_windows(state.stamp_volume_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {r.event_id: r.volume_before for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"0": 0, "1": 0, "2": 0, "3": 0, "4": 0, "5": 100, "6": 103}


def test_rows_of_a_batch_are_stamped_in_arrival_order_and_old_months_expire(spark, tmp_path):
    ms = lambda day: int(pd.Timestamp(day, tz="UTC").timestamp() * 1000)
    day = 86_400_000
    first = [{"event_id": str(i), "customer_id": "c", "model_id": "m", "ts_ms": ms("2024-01-10") + (i * 7 % 5), "input_tokens": 2**i} for i in range(5)]
    later = [{"event_id": "n", "customer_id": "c", "model_id": "m", "ts_ms": ms("2024-03-20"), "input_tokens": 1}]
    batches = [events(spark, x).withColumn("arrival_seq", F.col("event_id").cast("long") if x is first else F.lit(9).cast("long")) for x in (first, later, [{**later[0], "event_id": "o"}])]
    batches[0] = batches[0].orderBy(F.desc("arrival_seq"))
    feed(batches, tmp_path / "in")
    stream = windows.with_event_time(stream_of(spark, batches[0].schema, tmp_path / "in"), "60 days")
    run(sinks.write_windows(state.stamp_volume_stream(stream, retain_ms=10 * day), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {r.event_id: r.volume_before for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"0": 0, "1": 1, "2": 3, "3": 7, "4": 15, "n": 0, "o": 1}
    with pytest.raises(ValueError):
        state.stamp_volume_stream(stream.drop("ts"), retain_ms=1)


def test_charges_wait_for_their_budget(spark, tmp_path):
    move = lambda ts, seq, ref, kind, amount: (None, "c", ts, seq, ref, kind, amount, None, None)
    batches = [[move(50, 3, "early", "cost", 5), move(200, 3, "x", "cost", 30)], [move(300, 3, "y", "cost", 20)], [move(100, 0, "first", "set", 100)], [move(400, 3, "z", "cost", 60)]]
    feed([spark.createDataFrame(b, SCHEMA) for b in batches], tmp_path / "in")
    stream = stream_of(spark, spark.createDataFrame(batches[0], SCHEMA).schema, tmp_path / "in")
    run(sinks.write_windows(state.budget_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = sorted((r.ts_ms, r.ref, r.balance_micro, r.debt_micro) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(100, "first", 100, 0), (200, "x", 70, 0), (300, "y", 50, 0), (400, "z", 0, 10)]


def test_replay_takes_one_row_per_id(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("b", 3, 30), ("k", 4, 40), (None, 5, 50)], "event_id string, arrival_seq bigint, input_tokens bigint")
    rows.filter("event_id = 'k'").write.parquet(str(tmp_path / "table" / "batch_id=0"))
    rows.write.parquet(str(tmp_path / "late" / "batch_id=0"))
    args = (spark, str(tmp_path / "late"), str(tmp_path / "table"))
    assert late.replay_dlq(*args, dry_run=True) == 3
    assert late.replay_dlq(*args, max_rows=1) == 1
    assert late.replay_dlq(*args) == 2
    assert late.replay_dlq(spark, str(tmp_path / "late"), str(tmp_path / "table")) == 1  # only the one without an id
    ids = sorted((r.event_id or "", r.input_tokens) for r in spark.read.parquet(str(tmp_path / "table")).collect())
    assert ids == [("", 50), ("", 50), ("a", 10), ("b", 30), ("k", 40)]


def test_volume_then_windows_in_one_stream(spark, tmp_path):
    frame_of = events(spark, traffic(60))
    feed([frame_of.filter(F.col("ts_ms") % 2 >= 0).orderBy("ts_ms")], tmp_path / "in")
    named = normalize_models(windows.with_event_time(stream_of(spark, frame_of.schema, tmp_path / "in")), TIERED)
    priced = price_events(state.stamp_volume_stream(named), TIERED, "volume_before")
    run(sinks.write_windows(windows.usage_windows_stream(priced), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = by(spark.read.parquet(str(tmp_path / "out")), "customer_id", "model_id", "window_start_ms")
    want = by(usage.usage_windows(priced_usage(frame_of, TIERED)), "customer_id", "model_id", "window_start_ms")
    assert len(got) > 5 and all(want[k]["cost_micro"] == v["cost_micro"] for k, v in got.items())


def test_budget_stream_equals_the_ledger(spark, tmp_path):
    moves = random_moves(random.Random(6), customers=4, length=60)
    ordered = sorted(moves, key=lambda m: m[2])
    feed([spark.createDataFrame(ordered[i:i + 80], SCHEMA) for i in range(0, len(ordered), 80)], tmp_path / "in")
    stream = stream_of(spark, spark.createDataFrame(moves, SCHEMA).schema, tmp_path / "in")
    run(sinks.write_windows(state.budget_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out"))
    ledger = budget_ledger(frame(spark, moves))
    key = ("customer_id", "ts_ms", "balance_micro", "debt_micro")
    assert sorted(tuple(r[k] for k in key) for r in got.collect()) == sorted(tuple(r[k] for k in key) for r in ledger.collect())
    alerts = sorted((r.customer_id, r.ts_ms, r.alert) for r in got.filter("alert IS NOT NULL").collect())
    assert alerts == sorted((r.customer_id, r.ts_ms, r.alert) for r in budget_alerts(ledger).collect())


def test_span_sessions_split_on_a_pause(spark):
    rows = [{"event_id": str(i), "customer_id": c, "model_id": "m", "parent_span_id": "s", "ts_ms": t, "input_tokens": 1, "tenant_id": "t" if i == 0 else None}
            for i, (t, c) in enumerate([(0, "a"), (59_999, "b"), (119_000, "c"), (200_000, "d")])]
    timed = events(spark, rows).withColumns({"ts": F.timestamp_millis("ts_ms"), "cost_micro": F.lit(1).cast("bigint")})
    found = sorted((r.first_ts_ms, r.duration_ms, r.call_count, r.customer_id, r.tenant_id) for r in usage.span_sessions(timed).collect())
    # the first event is another tenant's, so it is a run of its own
    assert found == [(0, 0, 1, "a", "t"), (59_999, 59_001, 2, "c", None), (200_000, 0, 1, "d", None)]


def test_rollup_stream_adds_up(spark, tmp_path):
    frame_of = price_events(normalize_models(events(spark, traffic(90)), STANDARD), STANDARD)
    feed([frame_of.filter(F.col("latency_ms") % 3 == i) for i in range(3)], tmp_path / "in")
    run(sinks.rollup_stream(stream_of(spark, frame_of.schema, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True}))
    got = sinks.read_rollup(spark, str(tmp_path / "out"))
    want = usage.usage_rollup(frame_of).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rebuild_from_landed_events(spark, tmp_path):
    rows = traffic(40)
    feed([events(spark, rows)], tmp_path / "in")
    run(land_events(stream_of(spark, USAGE_EVENTS, tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")))
    moves = frame(spark, [(None, "c0", 0, 0, "first", "set", 10_000_000, None, None)])
    tables = rebuild(read_events(spark, str(tmp_path / "log")), moves, TIERED)
    direct = priced_usage(events(spark, rows), TIERED)
    want = {r.customer_id: r.cost_micro for r in usage.usage_by_customer(direct).collect()}
    assert {r.customer_id: r.cost_micro for r in tables["usage_by_customer"].collect()} == want
    booked = tables["budget_state"].first()
    assert booked.deducted_micro == want["c0"]
    assert booked.balance_micro - booked.debt_micro == 10_000_000 - want["c0"]


def booked_one_by_one(moves, state):
    out = []
    for m in moves.itertuples(index=False):
        alert = None
        if m.kind == "set":
            given = m.alert_threshold_micro
            state = (m.amount_micro, 0, m.amount_micro * 0.1 if pd.isna(given) else float(given))
        elif state is None:
            continue
        else:
            before, debt, limit = state
            after = before + (m.amount_micro if m.kind == "topup" else -m.amount_micro)
            state = (max(0, after), debt + max(0, -after), limit)
            if m.kind == "cost" and state[0] <= 0:
                alert = "BUDGET_EXHAUSTED"
            elif m.kind == "cost" and state[0] <= limit < before:
                alert = "BUDGET_LOW"
        out.append((m.ts_ms, state[0], state[1], alert))
    return out, state


def test_movements_booked_at_once_are_those_booked_one_by_one():
    rng = random.Random(1)
    for _ in range(500):
        moves = pd.DataFrame(
            [(i, 0, f"r{i}", rng.choice(["cost"] * 5 + ["topup", "set"]), rng.randrange(60), rng.choice([None, 0, 5])) for i in range(rng.randint(0, 14))],
            columns=["ts_ms", "seq", "ref", "kind", "amount_micro", "alert_threshold_micro"],
        )
        start = rng.choice([None, (rng.randrange(90), rng.randrange(9), float(rng.randrange(20)))])
        want, end = booked_one_by_one(moves, start)
        got, state_after = state.book(moves, start)
        assert list(got[["ts_ms", "balance_micro", "debt_micro", "alert"]].itertuples(index=False, name=None)) == want
        assert state_after == end
