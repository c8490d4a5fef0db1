"""State of streams that ends: fed one file per micro-batch, with the number of state rows in the query's progress."""

from pyspark.sql import functions as F

from tallyhouse.operators.pricing import price_events
from tallyhouse.sources import price_lists
from tallyhouse.sources.catalog import catalog_from
from tallyhouse.sources.events import encode_events, read_events_stream
from tallyhouse.streaming import expiring, intake, sinks, state

from .helpers import by, events
from .test_streaming import feed, stream_of

STANDARD = catalog_from(price_lists.STANDARD)
START = 1_704_067_200_000
MINUTE = 60_000


def usage_rows(at, n, **more):
    return [
        {"event_id": f"e{at}-{i}", "customer_id": f"c{i % 3}", "model_id": "gpt-4o", "parent_span_id": f"s{at // (10 * MINUTE)}-{i % 5}",
         "ts_ms": START + at + i, "input_tokens": 10, "output_tokens": i} | more
        for i in range(n)
    ]


def run_lots(spark, tmp_path, lots, counted, mode="update"):
    """Feed lots as micro-batches; the rows written and the state rows after each batch."""
    frames = [price_events(events(spark, rows), STANDARD) for rows in lots]
    feed(frames, tmp_path / "in")
    stream = counted(stream_of(spark, frames[0].schema, tmp_path / "in"))
    query = sinks.write_windows(stream, str(tmp_path / "out"), str(tmp_path / "cp"), mode=mode)
    query.awaitTermination()
    kept = [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress if p.stateOperators]
    return spark.read.parquet(str(tmp_path / "out")), kept


def test_spans_go_after_their_retention(spark, tmp_path):
    lots = [usage_rows(0, 50), usage_rows(MINUTE, 10), *[usage_rows(h * 60 * MINUTE, 5) for h in (1, 2, 3)]]
    updates, kept = run_lots(spark, tmp_path, lots, lambda df: expiring.span_totals_stream(df, 10 * MINUTE))
    got = by(expiring.latest(updates, expiring.SPAN_KEYS), "parent_span_id")
    # The second lot adds to the spans of the first.
    assert got["s0-1",]["call_count"] == 12 and got["s0-1",]["total_tokens"] == sum(10 + i for i in range(1, 50, 5)) + 11 + 16
    assert (got["s0-1",]["first_ts_ms"], got["s0-1",]["last_ts_ms"]) == (START + 1, START + MINUTE + 6)
    assert len(got) == 5 + 3 * 5
    assert max(kept) >= 10 and kept[-1] < max(kept)  # old spans have gone


def test_a_span_that_comes_again_starts_anew(spark, tmp_path):
    lots = [usage_rows(0, 4, parent_span_id="s"), usage_rows(30 * MINUTE, 1, parent_span_id="other"), usage_rows(31 * MINUTE, 1, parent_span_id="other"),
            usage_rows(40 * MINUTE, 2, parent_span_id="s")]
    updates, _ = run_lots(spark, tmp_path, lots, lambda df: expiring.span_totals_stream(df, 10 * MINUTE))
    last = by(expiring.latest(updates, expiring.SPAN_KEYS), "parent_span_id")
    assert last["s",]["call_count"] == 2 and last["s",]["first_ts_ms"] == START + 40 * MINUTE


def test_minutes_and_ids_go_after_their_retention(spark, tmp_path):
    lots = [usage_rows(h * 60 * MINUTE, 40) for h in range(5)]
    lots[1] = lots[1] + lots[0][:7]  # copies that come within the time
    lots[1] += usage_rows(2 * MINUTE, 3)  # late, but within the time
    totals, kept = run_lots(spark, tmp_path / "minutes", lots, lambda df: expiring.counters_stream(df, "minute", 90 * MINUTE))
    got = by(expiring.latest(totals, ["tenant_id", "customer_id", "start_ms"]), "customer_id", "start_ms")
    assert got["c0", START]["event_count"] == 14 + 3 and got["c0", START + 2 * MINUTE]["event_count"] == 1
    assert kept[-1] < max(kept) <= 3 * 5
    ids, kept = run_lots(spark, tmp_path / "ids", lots, lambda df: expiring.kept_ids_stream(df, 90 * MINUTE), "append")
    assert ids.count() == 5 * 40 + 3 and ids.select("event_id").distinct().count() == 203
    assert kept[-1] < max(kept) < 203


def test_month_volumes_go_after_their_month(spark, tmp_path):
    """With several months and a watermark long past the first, its volume is forgotten."""
    day = 24 * 60 * MINUTE
    lots = [usage_rows(d * day, 3) for d in (0, 35, 70, 100, 130)]
    stamped = lambda df: state.stamp_volume_stream(
        df.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", "1 second"), retain_ms=5 * day
    )
    rows, kept = run_lots(spark, tmp_path, lots, stamped, "append")
    assert rows.count() == 15 and {r.volume_before for r in rows.collect()} == {0}
    assert kept[-1] < 3 * 5, kept  # five months of three customers would be left for good


def test_intake_parses_once_and_repeats_batches(spark, tmp_path):
    good = events(spark, usage_rows(0, 30) + usage_rows(MINUTE, 3, input_tokens=-1) + usage_rows(2 * MINUTE, 1, customer_id=" "))
    text = good.select(encode_events(good).alias("value")).unionByName(
        spark.createDataFrame([("{no json",), ("",), ("null",), ("[1, 2]",)], "value string")
    )
    out, raw = str(tmp_path / "out"), str(tmp_path / "in")

    def go(checkpoint):
        intake.intake_stream(read_events_stream(spark, raw, max_files=2), out, str(tmp_path / checkpoint)).awaitTermination()

    text.repartition(4).write.text(raw)
    go("cp")
    text.repartition(4).write.mode("append").text(raw)
    go("cp")
    want = {"json": 8, "input_tokens": 6, "customer_id": 2}
    for _ in range(2):
        accepted, rejected = intake.read_intake(spark, out)
        assert accepted.count() == 60 and accepted.select("event_id").distinct().count() == 30
        assert {r.e: r["count"] for r in rejected.groupBy(F.array_join("errors", ",").alias("e")).count().collect()} == want
        assert rejected.filter("value IS NULL").count() == 0 and "value" not in accepted.columns
        go("again")  # a stream that lost its checkpoint takes the same files in again, into the same folders
