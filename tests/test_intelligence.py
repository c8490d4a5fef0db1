import math
import random

import pytest

from tallyhouse.operators import intelligence as intel
from tallyhouse.sources import price_lists
from tallyhouse.sources.catalog import catalog_from

STANDARD = catalog_from(price_lists.STANDARD)


def costs(spark, rows):
    return spark.createDataFrame([(c, p, int(v * 1_000_000)) for c, p, v in rows], "customer_id string, period string, cost_micro bigint")


def models(spark, rows):
    return spark.createDataFrame(
        [(c, m, p, int(v * 1_000_000), i, o) for c, m, p, v, i, o in rows],
        "customer_id string, model_id string, period string, cost_micro bigint, input_tokens bigint, output_tokens bigint",
    )


def dims(spark, rows):
    return spark.createDataFrame([(k, v, p, int(c * 1_000_000)) for k, v, p, c in rows], "dim_key string, dim_value string, period string, cost_micro bigint")


def revenue(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, period string, revenue_usd double")


def test_root_cause_golden(spark):
    customers = costs(spark, [("c1", "2026-06", 100), ("c1", "2026-07", 140)])
    by_model = models(spark, [("c1", "gpt-4o", "2026-06", 60, 1, 1), ("c1", "gpt-4o", "2026-07", 120, 1, 1)])
    features = dims(spark, [("feature", "chat", "2026-07", 10)])
    top = intel.root_cause(customers, by_model, features, "2026-07", "2026-06").collect()
    assert (top[0].dimension, top[0].key, top[0].delta_usd, top[0].share_of_total_delta_pct) == ("model", "gpt-4o", 60.0, 150.0)
    # no baseline gives no percentage
    assert [r.delta_pct for r in top if r.dimension == "feature"] == [0.0]
    totals = intel.root_cause_totals(customers, "2026-07", "2026-06")
    summary = intel.root_cause_summary(totals, intel.root_cause(customers, by_model, features, "2026-07", "2026-06"), "2026-06").first()
    assert summary.delta_pct == pytest.approx(40)
    assert summary.summary == "Cost +40.0% vs 2026-06. Top driver: model gpt-4o (150% of change)."
    assert intel.detect_cost_spike(intel.root_cause_summary(totals, intel.root_cause(customers, by_model, features, "2026-07", "2026-06"), "2026-06"), "2026-07").count() == 1


def test_root_cause_of_nothing(spark):
    empty = costs(spark, [])
    totals = intel.root_cause_totals(empty, "2026-07", "2026-06")
    top = intel.root_cause(empty, models(spark, []), dims(spark, []), "2026-07", "2026-06")
    assert intel.root_cause_summary(totals, top, "2026-06").first().summary == "Cost +0.0% vs 2026-06. No significant contributors."


def test_economics_and_advice(spark):
    customers = costs(spark, [("loss", "2026-07", 620), ("switch", "2026-07", 100), ("thin", "2026-07", 95), ("new", "2026-07", 5)])
    earned = revenue(spark, [("loss", "2026-07", 500.0), ("switch", "2026-07", 50.0), ("thin", "2026-07", 100.0)])
    rows = {r.customer_id: r for r in intel.unit_economics(customers, earned, "2026-07").collect()}
    assert {k: r.status for k, r in rows.items()} == {"loss": "loss", "switch": "loss", "thin": "profitable", "new": "unknown_revenue"}
    assert rows["thin"].recommendation.startswith("Low margin")
    by_model = models(spark, [("switch", "gpt-4o", "2026-07", 100, 800, 200), ("loss", "x", "2026-06", 1, 1, 1)])
    advice = intel.pricing_recommendations(intel.unit_economics(customers, earned, "2026-07"), by_model, STANDARD, "2026-07")
    found = {(r.customer_id, r.action): r for r in advice.collect()}
    assert set(found) == {
        ("loss", "price_increase"), ("switch", "price_increase"), ("switch", "model_switch"),
        ("thin", "price_increase"), ("new", "connect_revenue"),
    }
    assert found["loss", "price_increase"].roi_annual_usd == pytest.approx((620 / 0.7 - 500) * 12)
    assert found["loss", "price_increase"].suggested_change == "Raise price to $885.71/mo for 30% margin (current $500.00)"
    assert "hunyuan-lite" in found["switch", "model_switch"].suggested_change
    assert found["switch", "model_switch"].confidence == "high"
    assert intel.ranked_recommendations(advice, 1).first().customer_id == "loss"


def test_dashboard_golden(spark):
    customers = costs(spark, [("c", "2026-06", 100), ("c", "2026-07", 150)])
    board = intel.profitability(customers, dims(spark, [("feature", "chat", "2026-07", 50)]), revenue(spark, [("c", "2026-07", 200.0)]), "2026-07", 3)
    totals = board["totals"].first()
    assert (totals.revenue_usd, totals.cost_usd, totals.margin_usd, totals.margin_pct) == (200, 150, 50, 25)
    assert [tuple(r) for r in board["trend"].collect()] == [("2026-05", 0.0, None, None), ("2026-06", 100.0, None, None), ("2026-07", 150.0, 200.0, 50.0)]
    product = board["by_product"].first()
    assert (product.product, product.revenue_usd, product.margin_usd, product.margin_pct) == ("chat", 200, 150, 75)
    assert board["by_customer"].count() == 1


def daily(spark, days, usd, period="2026-07"):
    return spark.createDataFrame([(f"{period}-{d:02}", int(usd * 1_000_000)) for d in range(1, days + 1)], "day string, cost_micro bigint")


def test_forecast_golden(spark):
    ten = intel.forecast(daily(spark, 10, 10), "2026-07", "2026-07-10").first()
    assert (ten.mtd_cost_usd, ten.forecast_eom_cost_usd, ten.status) == (100, 310, "no_budget")
    limit = spark.createDataFrame([(50.0,)], "budget_usd double")
    five = intel.forecast(daily(spark, 5, 20), "2026-07", "2026-07-05", budgets=limit)
    row = five.first()
    assert (row.status, row.variance_usd) == ("over_budget", 620 - 50)
    assert intel.detect_forecast_risk(five, "2026-07").first().summary == "Forecast EOM $620.00 exceeds budget $50.00 by $570.00"
    # a past month has elapsed whole
    assert intel.forecast(daily(spark, 10, 10), "2026-07", "2026-09-01").first().forecast_eom_cost_usd == 100


def test_margin_loss_names_five_and_debounce(spark):
    customers = costs(spark, [(f"c{i}", "2026-07", 10) for i in range(8)])
    earned = revenue(spark, [(f"c{i}", "2026-07", 1.0) for i in range(8)])
    economics = intel.unit_economics(customers, earned, "2026-07")
    previous = spark.createDataFrame([("c0",)], "customer_id string")
    alert, snapshot = intel.detect_margin_loss(economics, previous, "2026-07")
    assert alert.first().summary == "7 new unprofitable customer(s): c1, c2, c3, c4, c5 (+2 more)"
    assert intel.detect_margin_loss(economics, snapshot, "2026-07")[0].count() == 0
    day = 86_400_000
    sent = spark.createDataFrame([("INTEL_MARGIN_LOSS", "2026-07", 5 * day)], "type string, period string, sent_ms bigint")
    assert intel.debounce_alerts(alert, sent, 6 * day - 1).count() == 0
    assert intel.debounce_alerts(alert, sent, 6 * day).count() == 1


def random_catalog(rng, n):
    def entry():
        price = lambda: rng.choice([0.0, 0.1, 0.25, 0.5, 1.0, 2.5, 7.5, rng.random() * 20])
        if rng.random() < 0.7:
            return {"input_per_m": price(), "output_per_m": price()}
        bound = rng.choice([1, 2])
        tiers = [{"up_to_tokens_m": b, "input_per_m": price(), "output_per_m": price()} for b in (bound, None)]
        return {"pricing_mode": rng.choice(["graduated", "volume"]), "tiers": tiers}

    return catalog_from({"models": {f"m{i}": entry() for i in range(n)}, "prefix_models": ["m1"]})


def request_cost(model, i, o):
    half_up = lambda x: math.floor(x + 0.5)
    if model.mode != "graduated":
        return half_up(i * model.tiers[0].input) + half_up(o * model.tiers[0].output)
    part = lambda a, b, t: max(0, min(b, t.hi) - max(a, t.lo))
    return sum(half_up(part(0, i, t) * t.input) for t in model.tiers) + sum(half_up(part(i, i + o, t) * t.output) for t in model.tiers)


@pytest.mark.parametrize("seed", range(3))
def test_cheaper_model_against_every_model(spark, seed):
    rng = random.Random(seed)
    catalog = random_catalog(rng, 60)
    assert len(intel.cheapest_candidates(catalog)) < 40
    asked = [(f"c{k}", rng.choice([f"m{rng.randrange(60)}", "m1-late", "nobody's", None, ""]), rng.choice([0, 1, 7, 10**6, 2_500_000, rng.randrange(10**7)]),
              rng.choice([0, 1, 3, rng.randrange(10**6)]), "kept") for k in range(120)]
    rows = spark.createDataFrame(asked, "customer_id string, model_id string, input_tokens bigint, output_tokens bigint, raw_model_id string")
    got = {r.customer_id: r for r in intel.cheaper_model(rows, catalog).collect()}
    assert len(got) == 120
    for c, m, i, o, _ in asked:
        name = m if m in catalog.models else "m1" if m and m.startswith("m1") else m
        own = request_cost(catalog.models.get(name, catalog.defaults), i, o)
        cost, _, best = min((request_cost(p, i, o), n, k) for n, (k, p) in enumerate(catalog.models.items()))
        want = (own, best, cost) if cost < own else (own, None, None)
        r = got[c]
        assert (r.from_cost_micro, r.to_model, r.to_cost_micro) == want, (c, m, i, o)
        assert r.model_id == m and r.raw_model_id == "kept"


def test_dominated_models_are_never_priced(spark):
    """Of 3 000 models, each dearer than one before it but three, three are in the plan."""
    entries = {"low-in": {"input_per_m": 0.1, "output_per_m": 9.0}, "low-out": {"input_per_m": 9.0, "output_per_m": 0.1}, "even": {"input_per_m": 1.0, "output_per_m": 1.0}}
    entries |= {f"dear{i}": {"input_per_m": 9.0 + i, "output_per_m": 9.0 + i} for i in range(3_000)}
    catalog = catalog_from({"models": entries})
    assert [m.model_id for m in intel.cheapest_candidates(catalog)] == ["low-in", "low-out", "even"]
    rows = spark.createDataFrame([("dear7", 100, 1), ("dear8", 1, 100), ("low-in", 100, 0)], "model_id string, input_tokens bigint, output_tokens bigint")
    best = intel.cheaper_model(rows, catalog)
    assert "dear2999" not in best._jdf.queryExecution().toString()
    assert [(r.model_id, r.to_model) for r in best.orderBy("model_id").collect()] == [("dear7", "low-in"), ("dear8", "low-out"), ("low-in", None)]


def test_cheaper_model_without_models(spark):
    rows = spark.createDataFrame([("x", 100, 1)], "model_id string, input_tokens bigint, output_tokens bigint")
    assert [(r.from_cost_micro, r.to_model) for r in intel.cheaper_model(rows, catalog_from({})).collect()] == [(103, None)]
