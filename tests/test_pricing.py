import math
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.cleaning import normalize_models
from tallyhouse.operators.pricing import estimate_requests, price_events, simulate_model_switch, stream_kill_points
from tallyhouse.operators.volume import stamp_volume
from tallyhouse.plans.metering import priced_usage
from tallyhouse.schema import TOKEN_COLUMNS
from tallyhouse.sources import price_lists
from tallyhouse.sources.catalog import catalog_from, load_catalog, model_price, validate_catalogs, write_catalog

from .helpers import by, events

STANDARD = catalog_from(price_lists.STANDARD)
TIERED = catalog_from(price_lists.TIERED)


def cost(spark, catalog, model, volume=0, **tokens):
    frame = normalize_models(events(spark, [{"model_id": model, **tokens}]), catalog)
    return price_events(frame, catalog, volume).first()["cost_micro"]


def test_flat_golden_values(spark):
    cases = [
        ("gpt-4o", {"input_tokens": 1_000_000}, 2_500_000),
        ("deepseek-v4-flash", {"input_tokens": 1_000_000}, 140_000),
        ("claude-opus-4", {"input_tokens": 10_000, "output_tokens": 5_000}, 525_000),
        ("gpt-4o", {"cache_read_tokens": 1_000_000}, 1_250_000),
        ("gpt-4o-mini", {"input_tokens": 1_000}, 150),
        ("gpt-4o-2024-08-06", {"input_tokens": 1_000}, 2_500),
        ("gemini-1.5-flash", {"input_tokens": 1_000_000}, 75_000),
        ("never-heard-of", {"input_tokens": 1_000_000, "output_tokens": 1_000_000}, 4_000_000),
        ("hunyuan-lite", {"input_tokens": 1_000_000}, 0),
        (None, {"input_tokens": 1_000_000}, 1_000_000),
    ]
    frame = events(spark, [{"event_id": str(i), "model_id": m, **t} for i, (m, t, _) in enumerate(cases)])
    found = by(price_events(normalize_models(frame, STANDARD), STANDARD), "event_id")
    assert [found[(str(i),)]["cost_micro"] for i in range(len(cases))] == [c for _, _, c in cases]


def test_tiered_golden_values(spark):
    assert cost(spark, TIERED, "gpt-4o-mini", 9_000_000, input_tokens=1_000_000) == 150_000
    assert cost(spark, TIERED, "gpt-4o-mini", 10_000_000, input_tokens=1_000_000) == 120_000
    assert cost(spark, TIERED, "gpt-4o-mini", 9_999_999, input_tokens=100_000) == 15_000
    assert cost(spark, TIERED, "claude-sonnet-4", 900_000, input_tokens=100_000, output_tokens=100_000) == 400_000
    assert cost(spark, TIERED, "claude-sonnet-4", 0, input_tokens=50_000, output_tokens=50_000) == 300_000


def loop_price(model, tokens, volume, multiplier):
    """Graduated price, token chunk by token chunk."""
    cost, at = 0, volume
    for name, kind in (
        ("input_tokens", "input"), ("output_tokens", "output"), ("cache_read_tokens", "cache"),
        ("reasoning_tokens", "output"), ("cache_write_tokens", "input"), ("embedding_tokens", "embed"),
    ):
        left = tokens[name]
        while left > 0:
            tier = next(t for t in model.tiers if at < t.hi)
            chunk = min(left, tier.hi - at)
            rate = tier.input * multiplier if kind == "cache" else getattr(tier, kind)
            cost += math.floor(chunk * rate + 0.5)
            at, left = at + chunk, left - chunk
    return cost


def test_graduated_matches_the_loop(spark):
    model = model_price("m", {
        "pricing_mode": "graduated",
        "tiers": [
            {"up_to_tokens_m": 1, "input_per_m": 2.3, "output_per_m": 4.7, "embedding_per_m": 0.31},
            {"up_to_tokens_m": 3, "input_per_m": 1.1, "output_per_m": 2.9, "embedding_per_m": 0.17},
            {"up_to_tokens_m": 7, "input_per_m": 0.7, "output_per_m": 1.3, "embedding_per_m": 0.07},
            {"up_to_tokens_m": None, "input_per_m": 0.3, "output_per_m": 0.9, "embedding_per_m": 0.03},
        ],
    })
    catalog = TIERED.with_model(model)
    rng = random.Random(7)
    rows = [
        {"event_id": str(i), "model_id": "m", "ts_ms": rng.randrange(0, 9_000_000),
         **{c: rng.randrange(0, 1_500_000) for c in TOKEN_COLUMNS}}
        for i in range(200)
    ]
    frame = events(spark, rows)
    # The event time serves as the volume before it.
    found = by(price_events(frame, catalog, F.col("ts_ms")), "event_id")
    for row in rows:
        assert found[(row["event_id"],)]["cost_micro"] == loop_price(model, row, row["ts_ms"], 0.5)


def test_volume_stamp_restarts_each_month_and_ignores_duplicates(spark):
    jan, feb = 1_704_067_200_000, 1_706_745_600_000
    rows = [
        {"event_id": "a", "ts_ms": jan, "input_tokens": 10},
        {"event_id": "a", "ts_ms": jan, "input_tokens": 10},
        {"event_id": "b", "ts_ms": jan + 1, "input_tokens": 5},
        {"event_id": "c", "ts_ms": feb, "input_tokens": 7},
    ]
    rows = [{"customer_id": "c1", "model_id": "gpt-4o-mini", **r} for r in rows]
    found = by(priced_usage(events(spark, rows), TIERED), "event_id")
    assert {k[0]: v["volume_before"] for k, v in found.items()} == {"a": 0, "b": 10, "c": 0}


def test_volume_stamp_of_a_hot_key_is_the_same(spark):
    rng = random.Random(3)
    rows = [
        {"event_id": str(i), "tenant_id": None if i % 3 else "t", "customer_id": "big" if i % 4 else f"c{i % 9}",
         "model_id": "m", "ts_ms": rng.randrange(0, 50), "input_tokens": rng.randrange(1, 100)}
        for i in range(600)
    ]
    frame = events(spark, rows)
    plain = stamp_volume(frame).select("event_id", "volume_before")
    split = stamp_volume(frame, hot_rows=40).select("event_id", "volume_before")
    assert sorted(plain.collect()) == sorted(split.collect())


def test_catalog_round_trip_and_snapshot_wins(spark, tmp_path):
    file, snapshot = str(tmp_path / "file"), str(tmp_path / "snapshot")
    write_catalog(spark, STANDARD, file)
    assert load_catalog(spark, file).models == STANDARD.models
    assert load_catalog(spark, file, snapshot).models == STANDARD.models
    write_catalog(spark, TIERED, snapshot)
    assert load_catalog(spark, file, snapshot) == TIERED
    assert TIERED.frame(spark).count() == 2


def test_catalog_mistakes(spark):
    with pytest.raises(ValueError):
        model_price("m", {"pricing_mode": "flat", "tiers": [{"up_to_tokens_m": None}]})
    with pytest.raises(ValueError):
        model_price("m", {"pricing_mode": "graduated"})
    with pytest.raises(ValueError):
        model_price("m", {"pricing_mode": "daily"})
    docs = spark.createDataFrame([
        (1, '{"models": {}, "defaults": {}}'),
        (2, '{"models": {"a": {"tiers": [{"up_to_tokens_m": 5}, {"up_to_tokens_m": 5}, {}]}}, "defaults": {}}'),
        (3, '{"models": {"a": {"tiers": [{"up_to_tokens_m": 1.5}, {}]}}, "defaults": {}}'),
        (4, '{"models": {"a": {"tiers": [{"up_to_tokens_m": 1}, {"up_to_tokens_m": 2}]}}, "defaults": {}}'),
        (5, '{"volume_scope": "tenant", "defaults": {}}'),
    ], "id int, body string")
    found = {(r.doc_id, r.rule) for r in validate_catalogs(docs, "id", "body").collect()}
    assert found == {
        (2, "bounds_not_increasing"), (3, "bounds_not_increasing"), (4, "last_tier_not_open"),
        (5, "missing_models"), (5, "unsupported_volume_scope"),
    }


def test_request_estimate_has_a_floor(spark):
    requests = spark.createDataFrame([("hunyuan-lite", 10), ("gpt-4o", None), ("gpt-4o", 100)], "model_id string, max_tokens bigint")
    found = [r.estimate_micro for r in estimate_requests(requests, STANDARD).orderBy("model_id", "max_tokens").collect()]
    assert found == [1_280 + 10_240, 1_280 + 1_000, 1]


def test_stream_is_stopped_at_the_first_chunk_over_its_hold(spark):
    rows = [
        ("s", 1, "x" * 400, None, None), ("s", 2, "x" * 400, None, None),
        ("s", 3, "", 10, 20), ("s", 4, "x" * 4000, None, None), ("s", 5, "x", None, None),
    ]
    chunks = spark.createDataFrame(rows, "stream_id string, chunk_no int, content string, usage_input bigint, usage_output bigint")
    chunks = chunks.withColumn("model_id", F.lit("never-heard-of")).withColumn("reserved_micro", F.lit(700))
    row = stream_kill_points(chunks, STANDARD).first()
    # counted 100 + 100, replaced by 20, then 1000 more
    assert (row.chunk_no, row.input_tokens, row.output_tokens) == (4, 10, 1020)


def test_model_switch_text(spark):
    scenario = spark.createDataFrame(
        [(1_000_000, 500_000, "gpt-4o", "gpt-4o-mini", 2)],
        "input_tokens bigint, output_tokens bigint, from_model string, to_model string, monthly_occurrences int",
    )
    row = simulate_model_switch(scenario, STANDARD).first()
    assert row.annual_savings_usd == pytest.approx((7.5 - 0.45) * 24)
    assert row.notes == "Switch gpt-4o → gpt-4o-mini: $7.50/mo → $0.45/mo ($+7.05/mo)"


def test_a_catalog_of_100_000_models_and_prefixes(spark):
    from tallyhouse.operators.cleaning import normalize_models

    document = {
        "models": {f"m-{i}": {"input_per_m": float(i)} for i in range(100_000)},
        "prefix_models": ["m-1x", *[f"p-{i}" for i in range(100_000)], "p"],
    }
    large = catalog_from(document)
    ids = ["m-7", "m-99999", "m-100000", "m-1xyz", "p-12345", "p-12", "p!", "q", "", None, "it's"]
    rows = [{"event_id": str(n), "customer_id": "c", "model_id": m, "ts_ms": 1, "input_tokens": 1_000_000} for n, m in enumerate(ids)]
    got = price_events(normalize_models(events(spark, rows), large), large)
    names = {int(r.event_id): (r.raw_model_id, r.model_id) for r in got.collect()}
    assert names == dict(enumerate(zip(ids, ["m-7", "m-99999", "m-100000", "m-1x", "p-1", "p-1", "p", "q", "unknown", "unknown", "it's"])))
    assert {r.event_id: r.cost_micro for r in got.collect() if r.event_id in "01"} == {"0": 7_000_000, "1": 99_999_000_000}
