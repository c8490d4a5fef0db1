"""Two tenants that use the same names stay apart."""

from pyspark.sql import functions as F

from tallyhouse.operators import intelligence as intel
from tallyhouse.operators.usage import dim_margin_series, usage_by_dim
from tallyhouse.schema import CUSTOMER
from tallyhouse.sources import price_lists
from tallyhouse.sources.catalog import catalog_from

from .helpers import by, events

STANDARD = catalog_from(price_lists.STANDARD)
KEY = "tenant_id string, customer_id string"


def costs(spark, rows):
    return spark.createDataFrame([(t, "c", p, v * 1_000_000) for t, p, v in rows], f"{KEY}, period string, cost_micro bigint")


def test_dimensions_by_tenant(spark):
    rows = [
        {"tenant_id": t, "customer_id": "c", "model_id": "m", "ts_ms": 1_704_067_200_000 + i, "metadata": {"feature": "chat"}}
        for i, t in enumerate(["a", "a", "b", None])
    ]
    priced = events(spark, rows).withColumn("cost_micro", F.lit(5).cast("bigint"))
    dims = usage_by_dim(priced)
    got = by(dims, "tenant_id", "dim_value", "period")
    assert {k: (r["cost_micro"], r["event_count"]) for k, r in got.items()} == {
        (t, "chat", p): (5 * n, n) for t, n in (("a", 2), ("b", 1), (None, 1)) for p in (None, "2024-01")
    }
    assert [(r.period, r.dim_value, r.cost_micro) for r in dim_margin_series(dims, "feature", ["2024-01"]).collect()] == [("2024-01", "chat", 20)]


def test_economics_and_advice_by_tenant(spark):
    customer_costs = costs(spark, [("a", "2026-07", 100), ("b", "2026-07", 10), (None, "2026-07", 7), ("a", "2026-06", 90)])
    earned = spark.createDataFrame([("a", "c", "2026-07", 50.0), ("b", "c", "2026-07", 90.0)], f"{KEY}, period string, revenue_usd double")
    economics = intel.unit_economics(customer_costs, earned, "2026-07", CUSTOMER)
    got = by(economics, "tenant_id")
    assert {k[0]: (r["status"], r["cost_usd"], r["revenue_usd"]) for k, r in got.items()} == {
        "a": ("loss", 100.0, 50.0), "b": ("profitable", 10.0, 90.0), None: ("unknown_revenue", 7.0, None)
    }
    models = spark.createDataFrame(
        [(t, "c", m, p, 100, 800_000, 200_000) for t, m, p in (("a", "gpt-4o", "2026-07"), ("b", "gpt-4o", "2026-07"), ("a", "gpt-4o", "2026-06"))],
        f"{KEY}, model_id string, period string, cost_micro bigint, input_tokens bigint, output_tokens bigint",
    )
    advice = by(intel.pricing_recommendations(economics, models, STANDARD, "2026-07", CUSTOMER), "tenant_id", "action")
    # Only tenant a used something in the month before.
    assert {k: r["confidence"] for k, r in advice.items()} == {
        ("a", "price_increase"): "high", ("a", "model_switch"): "high", ("b", "model_switch"): "medium", (None, "connect_revenue"): "medium"
    }
    assert advice["a", "price_increase"]["suggested_change"] == "Raise price to $142.86/mo for 30% margin (current $50.00)"


def test_spikes_by_tenant_keep_the_quarter_rule(spark):
    changes = [("a", 100, 126), ("b", 100, 125), (None, 4, 8), ("new", 0, 50)]
    customer_costs = costs(spark, [(t, p, v) for t, x, y in changes for p, v in (("2026-06", x), ("2026-07", y))])
    totals = intel.root_cause_totals(customer_costs, "2026-07", "2026-06", keys=CUSTOMER)
    alerts = by(intel.detect_cost_spike(intel.change_summary(totals, "2026-06"), "2026-07", keys=CUSTOMER), "tenant_id")
    assert {k[0]: r["summary"] for k, r in alerts.items()} == {"a": "Cost +26.0% vs 2026-06.", None: "Cost +100.0% vs 2026-06."}
    assert intel.detect_cost_spike(intel.change_summary(totals.filter("tenant_id = 'b'"), "2026-06"), "2026-07").count() == 0
