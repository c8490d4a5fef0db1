import pytest

from tallyhouse.operators.billing import (
    compare_external, due_exports, advance_marks, export_deltas, export_rows, rerate_apply, rerate_preview, rerate_replay,
    usage_cloudevents,
)
from tallyhouse.operators.budget import budget_ledger, latest_state
from tallyhouse.plans.metering import clean_usage
from tallyhouse.sources import price_lists
from tallyhouse.sources.catalog import catalog_from

from .helpers import events
from .test_budget import frame, move

STANDARD = catalog_from(price_lists.STANDARD)
TIERED = catalog_from(price_lists.TIERED)
USAGE = "tenant_id string, customer_id string, model_id string, input_tokens bigint, output_tokens bigint, cost_micro bigint"
CUT = {"model_id": "gpt-4o", "old_input_price": 2.5, "new_input_price": 2.0, "old_output_price": 10.0, "new_output_price": 10.0}


def test_rerate_preview_apply_and_credit(spark):
    usage = spark.createDataFrame([
        (None, "big", "gpt-4o", 2_000_000, 0, 5_000_000), (None, "big", "o1", 10, 0, 150),
        (None, "tiny", "gpt-4o", 100, 0, 250),
    ], USAGE)
    listed, totals = rerate_preview(usage, CUT, STANDARD)
    assert [(r.customer_id, r.adjustment_micro) for r in listed.collect()] == [("big", -1_000_000)]
    assert tuple(totals.first()) == (1, -1_000_000)
    _, customers, tenants, moves = rerate_apply(usage, CUT, STANDARD, 99)
    assert {r.customer_id: r.cost_micro for r in customers.collect()} == {"big": 4_000_150, "tiny": 250}
    assert tenants.first().cost_micro == 4_000_400
    seeds = frame(spark, [move("big", 0, "set", 6_000_000), move("big", 1, "cost", 5_000_150)])
    assert latest_state(budget_ledger(seeds.unionByName(moves))).first().balance_micro == 1_999_850


def test_tiered_models_are_not_rerated_from_totals(spark):
    usage = spark.createDataFrame([], USAGE)
    with pytest.raises(ValueError):
        rerate_preview(usage, {**CUT, "model_id": "gpt-4o-mini"}, TIERED)


def test_replay_reprices_with_the_volume_stamped_once(spark):
    rows = [
        {"event_id": str(i), "customer_id": "c", "model_id": "gpt-4o-mini", "ts_ms": i, "input_tokens": 6_000_000}
        for i in range(3)
    ]
    flat = TIERED.with_model(catalog_from({"models": {"gpt-4o-mini": {"input_per_m": 0.2}}}).models["gpt-4o-mini"])
    row = rerate_replay(clean_usage(events(spark, rows), TIERED), TIERED, flat).first()
    # two events start below 10M tokens, the third above
    assert (row.old_micro, row.new_micro) == (900_000 * 2 + 720_000, 3_600_000)


def exports(spark, marks):
    usage = spark.createDataFrame([("a", 10, 500, 300, 123_456), ("b", 1, 1, 1, 4_000), ("none", 9, 9, 9, 9)],
                                  "customer_id string, event_count bigint, input_tokens bigint, output_tokens bigint, cost_micro bigint")
    mark_frame = spark.createDataFrame(marks, "customer_id string, last_event_count bigint, last_input_tokens bigint, last_output_tokens bigint, last_cost_micro bigint")
    links = spark.createDataFrame([("a", "stripe", "cus_a"), ("a", "orb", "orb_a"), ("b", "metronome", "mtr_b")], "customer_id string, platform string, external_id string")
    return export_deltas(usage, mark_frame, links), mark_frame


def test_deltas_advance_their_marks(spark):
    deltas, marks = exports(spark, [("a", 4, 500, 400, 23_456), ("gone", 1, 1, 1, 1)])
    a = {r.customer_id: r for r in deltas.collect()}["a"]
    assert (a.new_event_count, a.new_input_tokens, a.new_output_tokens, a.new_cost_micro) == (6, 0, 0, 100_000)
    after = advance_marks(marks, deltas, export_rows(deltas, "events", "2026070112"), "events")
    assert {r.customer_id: tuple(r)[1:] for r in after.collect()} == {"a": (10, 500, 400, 23_456), "b": (1, 1, 1, 0), "gone": (1, 1, 1, 1)}
    paid = advance_marks(after, deltas, export_rows(deltas, "cost", "2026-07"), "cost")
    assert {r.customer_id: r.last_cost_micro for r in paid.collect()} == {"a": 123_456, "b": 4_000, "gone": 1}
    again, _ = exports(spark, [tuple(r) for r in paid.collect()])
    assert again.count() == 0


def cycles(spark, costs, platforms):
    """Reported micro-dollars per cycle, cost after cost."""
    links = spark.createDataFrame([("a", p, f"{p}_a") for p in platforms], "customer_id string, platform string, external_id string")
    marks = spark.createDataFrame([], "customer_id string, last_event_count bigint, last_input_tokens bigint, last_output_tokens bigint, last_cost_micro bigint")
    out = []
    for n, cost in enumerate(costs):
        usage = spark.createDataFrame([("a", 1, 1, 1, cost)], "customer_id string, event_count bigint, input_tokens bigint, output_tokens bigint, cost_micro bigint")
        deltas = export_deltas(usage, marks, links)
        rows = export_rows(deltas, "cost", str(n))
        marks = spark.createDataFrame([tuple(r) for r in advance_marks(marks, deltas, rows, "cost").collect()], marks.schema)
        out.append(sorted((r.platform, r.value) for r in rows.collect()))
    return out


def test_small_costs_add_up_to_the_cent(spark):
    got = cycles(spark, [4_000, 8_000, 12_000, 16_000, 20_000], ["stripe", "metronome"])
    assert sum(v for rows in got for p, v in rows if p == "stripe") == 2
    assert sum(v for rows in got for p, v in rows if p == "metronome") == 20_000
    assert cycles(spark, [4_000, 8_000], ["metronome"]) == [[("metronome", 4_000)], [("metronome", 4_000)]]


def test_a_total_that_falls_is_not_billed_again(spark):
    assert cycles(spark, [100_000, 90_000, 100_000, 110_000], ["stripe"]) == [[("stripe", 10)], [], [], [("stripe", 1)]]


def test_export_rows_per_platform(spark):
    deltas, _ = exports(spark, [])
    rows = {(r.platform, r.unit): (r.value, r.idempotency_key) for r in export_rows(deltas, "events", "2026070112").collect()}
    assert rows == {
        ("stripe", "events"): (10, "meter-a-2026070112-events"),
        ("orb", "input"): (500, "meter-a-2026070112-events-input"),
        ("orb", "output"): (300, "meter-a-2026070112-events-output"),
        ("metronome", "input_tokens"): (1, "meter-b-2026070112-events-input_tokens"),
        ("metronome", "output_tokens"): (1, "meter-b-2026070112-events-output_tokens"),
        ("metronome", "event_count"): (1, "meter-b-2026070112-events-event_count"),
    }
    assert len({(k[0], v[1]) for k, v in rows.items()}) == len(rows)
    cost = {(r.platform, r.unit): r.value for r in export_rows(deltas, "cost", "2026-07").collect()}
    assert cost == {("stripe", "cents"): 12, ("orb", "cents"): 12, ("metronome", "micro_usd"): 4_000}


def test_monthly_gate_cloudevents_and_comparison(spark):
    marks = spark.createDataFrame([("a", "2026-06"), ("b", "2026-07"), ("c", None)], "target string, last_period string")
    assert sorted(r.target for r in due_exports(marks, "2026-07").collect()) == ["a", "c"]
    usage = spark.createDataFrame([("a", 10, 2_500_000)], "customer_id string, total_tokens bigint, cost_micro bigint")
    body = usage_cloudevents(usage, "2026-07").first().body
    assert '"id":"meter-a-2026-07"' in body and '"cost_usd":2.5' in body
    other = spark.createDataFrame([("a", 10), ("b", 4)], "customer_id string, total_tokens bigint")
    assert [tuple(r) for r in compare_external(usage, other, ["customer_id"]).collect()] == [("b", 0, 4, -4)]
