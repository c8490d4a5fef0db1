import random

from pyspark.sql import functions as F

from tallyhouse.operators import dedup
from tallyhouse.operators.dedup import apply_once, dedup_in_window, dedup_within, keep_every, retain, upsert_spans

from .helpers import events


def test_window_dedup_counts_copies_and_keeps_events_without_id(spark):
    rows = [
        {"event_id": "a", "ts_ms": 1_000, "input_tokens": 5},
        {"event_id": "a", "ts_ms": 9_999, "input_tokens": 6},
        {"event_id": "a", "ts_ms": 10_000, "input_tokens": 7},
        {"event_id": None, "ts_ms": 1_000},
        {"event_id": None, "ts_ms": 1_000},
    ]
    rows = [{"customer_id": "c", "model_id": "m", "metadata": {"feature": "x"}, **r} for r in rows]
    kept = dedup_in_window(events(spark, rows))
    found = sorted((r.event_id or "", r.ts_ms, r.copies) for r in kept.collect())
    assert found == [("", 1_000, 1), ("", 1_000, 1), ("a", 1_000, 2), ("a", 10_000, 1)]


def greedy(times, ttl):
    kept, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= ttl:
            kept.append(t)
            last = t
    return kept


def test_ttl_runs_from_the_first_kept_hit(spark):
    rng = random.Random(5)
    times = {f"e{i}": [rng.randrange(0, 4_000) for _ in range(rng.choice([1, 2, 40, 200]))] for i in range(30)}
    frame = events(spark, [{"event_id": e, "ts_ms": t} for e, ts in times.items() for t in ts] + [{"ts_ms": 1}] * 2)
    want = sorted([(e, t) for e, ts in times.items() for t in greedy(ts, 300)] + [("", 1)] * 2)
    for hot_rows in (10**6, 50):
        got = dedup_within(frame, 300, hot_rows=hot_rows)
        assert sorted((r.event_id or "", r.ts_ms) for r in got.collect()) == want


def test_a_hot_id_is_not_walked(spark, monkeypatch):
    rng = random.Random(2)
    times = {"hot": [rng.randrange(9_000) for _ in range(2_000)] + [20_000, 20_001], "cold": [5, 6]}
    rows = [(k, t) for k, ts in times.items() for t in sorted(set(ts))]
    frame = spark.createDataFrame(rows, "k string, at bigint")

    def walked(*_):
        def fail(batches):
            assert sum(map(len, batches)) == 0, "a run of a hot group came to one task"
            yield from ()

        return fail

    monkeypatch.setattr(dedup, "_walk", walked)
    got = sorted((r.k, r.at) for r in keep_every(frame, ["k"], "at", 40, 100).collect())
    assert got == sorted((k, t) for k, ts in times.items() for t in greedy(ts, 40))


def test_keep_every_walks_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(9)
        rows = [(None if k == "n" else k, t) for k in ("a", "b", "n") for t in set(rng.choices(range(2_000), k=300))]
        frame = spark.createDataFrame(rows, "k string, at bigint")
        got = sorted((r.k or "n", r.at) for r in keep_every(frame, ["k"], "at", 50).collect())
        want = sorted((k, t) for k in ("a", "b", "n") for t in greedy([t for g, t in rows if (g or "n") == k], 50))
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_windows_apply_once_with_and_without_tenant(spark):
    schema = "tenant_id string, customer_id string, model_id string, window_start_ms bigint"
    new = spark.createDataFrame([(None, "c", "m", 0), ("t", "c", "m", 0), (None, "c", "m", 10_000)], schema)
    applied = spark.createDataFrame([(None, "c", "m", 0)], schema)
    left = apply_once(new, applied)
    assert sorted((r.tenant_id or "", r.window_start_ms) for r in left.collect()) == [("", 10_000), ("t", 0)]
    assert apply_once(left, left).count() == 0


def test_span_upsert_and_retention(spark):
    old = spark.createDataFrame([("t", "s", 1, 10), ("t", "r", 1, 4)], "tenant_id string, parent_span_id string, version int, cost int")
    new = spark.createDataFrame([("t", "s", 2, 15)], old.schema)
    assert sorted((r.parent_span_id, r.cost) for r in upsert_spans(new, old, "version").collect()) == [("r", 4), ("s", 15)]
    assert retain(old.withColumn("at", F.col("cost") * 10), "at", 110, 20).count() == 1
