"""Re-rating and billing exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..functions.money import half_up, usd
from ..functions.running import HOT_ROWS
from ..schema import CUSTOMER, CUSTOMER_MODEL
from ..sources.catalog import Catalog
from .budget import movements
from .pricing import price_events
from .volume import stamp_volume

# Smallest adjustment worth booking, and what a preview lists.
NEGLIGIBLE_MICRO = 1_000
PREVIEW_ROWS = 50

PLATFORMS = ("stripe", "metronome", "orb")


def usage_between(windows: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Customer × model totals of the windows inside a time range, to re-rate part of the past."""
    chosen = windows
    if start_ms is not None:
        chosen = chosen.filter(F.col("window_start_ms") >= start_ms)
    if end_ms is not None:
        chosen = chosen.filter(F.col("window_end_ms") <= end_ms)
    return chosen.groupBy(*CUSTOMER_MODEL).agg(
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost_micro")]
    )


def rerate_adjustments(usage: DataFrame, change: dict, catalog: Catalog) -> DataFrame:
    """Adjustment of each customer for one flat model's price change.

    ``usage`` is customer × model totals. ``change``: ``model_id,
    old_input_price, new_input_price, old_output_price, new_output_price``.
    Tiered models need ``rerate_replay``.
    """
    model = change["model_id"]
    mode = catalog.models[model].mode if model in catalog.models else catalog.defaults.mode
    if mode != "flat":
        raise ValueError(f"{model} is priced by {mode} tiers; replay its events instead")
    exact = (
        F.col("input_tokens") * F.lit(change["new_input_price"] - change["old_input_price"])
        + F.col("output_tokens") * F.lit(change["new_output_price"] - change["old_output_price"])
    )
    return (
        usage.filter(F.col("model_id") == model)
        .withColumn("_exact", exact)
        .filter(F.abs("_exact") > NEGLIGIBLE_MICRO)
        .select(*CUSTOMER_MODEL, "input_tokens", "output_tokens", half_up(F.col("_exact")).alias("adjustment_micro"))
    )


def rerate_preview(usage: DataFrame, change: dict, catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    """(the 50 lowest adjustments, totals) of a price change."""
    found = rerate_adjustments(usage, change, catalog)
    totals = found.agg(
        F.count("*").alias("customers_affected"),
        F.coalesce(F.sum("adjustment_micro"), F.lit(0)).alias("total_adjustment_micro"),
    )
    listed = found.orderBy("adjustment_micro", *CUSTOMER).limit(PREVIEW_ROWS)
    return listed, totals


def rerate_apply(
    usage: DataFrame, change: dict, catalog: Catalog, now_ms: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Apply a price change: adjusted (model, customer, tenant) costs and ledger movements.

    A price cut credits the balance: its movement has a negative charge.
    """
    adjustments = rerate_adjustments(usage, change, catalog)
    by_model = null_safe_join(
        usage, adjustments.select(*CUSTOMER_MODEL, "adjustment_micro"), CUSTOMER_MODEL, "left"
    ).withColumn("adjustment_micro", F.coalesce("adjustment_micro", F.lit(0)))
    by_model = by_model.withColumn("cost_micro", F.col("cost_micro") + F.col("adjustment_micro"))

    def totals(*keys):
        return by_model.groupBy(*keys).agg(
            F.sum("cost_micro").alias("cost_micro"), F.sum("adjustment_micro").alias("adjustment_micro")
        )

    moves = movements(
        adjustments.select(
            *CUSTOMER, "model_id", F.lit(now_ms).cast("bigint").alias("ts_ms"),
            F.concat(F.lit("rerate|"), "model_id").alias("ref"),
            F.col("adjustment_micro").alias("amount_micro"),
        ),
        "rerate",
    )
    return by_model, totals(*CUSTOMER), totals("tenant_id"), moves


def rerate_replay(
    events: DataFrame, old: Catalog, new: Catalog, hot_rows: int = HOT_ROWS,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Price raw events under two catalogs; cost change per customer, model and month.

    The month volume is stamped once and serves both.
    """
    stamped = stamp_volume(events, hot_rows, sizes_from)
    both = price_events(
        price_events(stamped, old, "volume_before", "_old"), new, "volume_before", "_new"
    )
    return (
        both.groupBy(*CUSTOMER_MODEL, F.col("month").alias("period"))
        .agg(F.sum("_old").alias("old_micro"), F.sum("_new").alias("new_micro"))
        .withColumn("delta_micro", F.col("new_micro") - F.col("old_micro"))
    )


def linked_customers(links: DataFrame) -> DataFrame:
    """Customers linked to at least one billing platform."""
    return links.select("customer_id").distinct()


def billable_customers(usage: DataFrame, links: DataFrame) -> DataFrame:
    """Usage of linked customers, one column per platform id.

    ``links``: ``customer_id, platform, external_id``.
    """
    wide = links.groupBy("customer_id").agg(
        *[F.max(F.when(F.col("platform") == p, F.col("external_id"))).alias(f"{p}_id") for p in PLATFORMS]
    )
    return usage.join(wide, "customer_id")


MEASURES = ["event_count", "input_tokens", "output_tokens", "cost_micro"]


def export_deltas(usage: DataFrame, marks: DataFrame, links: DataFrame) -> DataFrame:
    """Linked customers whose usage has grown since what was reported.

    ``usage`` is per ``customer_id``: ``event_count, input_tokens,
    output_tokens, cost_micro``. ``marks`` has the same measures as
    ``last_*``. Deltas never go below zero.
    """
    joined = billable_customers(usage, links).join(marks, "customer_id", "left")
    deltas = joined.select(
        "customer_id", *[f"{p}_id" for p in PLATFORMS], *MEASURES,
        *[
            F.greatest(F.lit(0), F.col(m) - F.coalesce(f"last_{m}", F.lit(0))).alias(f"new_{m}")
            for m in MEASURES
        ],
    )
    return deltas.filter(" OR ".join(f"new_{m} > 0" for m in MEASURES))


def advance_marks(marks: DataFrame, deltas: DataFrame, rows: DataFrame, mode: str) -> DataFrame:
    """Marks after ``rows`` of the mode were reported.

    Only customers with a row move. In cost mode the mark grows by what was
    reported, in whole cents, so what rounding left is part of the next delta; a
    total that falls moves nothing and is not billed again when it recovers.
    """
    micro = F.when(F.col("unit") == "cents", F.col("value") * 10_000).otherwise(F.col("value"))
    sent = rows.groupBy("customer_id").agg(F.max(micro).alias("_reported"))
    if mode == "cost":
        moved = sent.select("customer_id", F.col("_reported").alias("_cost_micro"))
        moves = ["cost_micro"]
    else:
        moves = [m for m in MEASURES if m != "cost_micro"]
        moved = deltas.join(sent, "customer_id", "left_semi").select(
            "customer_id", *[F.col(f"new_{m}").alias(f"_{m}") for m in moves]
        )
    both = marks.join(moved, "customer_id", "full_outer")
    return both.select(
        "customer_id",
        *[
            (F.coalesce(f"last_{m}", F.lit(0)) + (F.coalesce(f"_{m}", F.lit(0)) if m in moves else 0)).alias(f"last_{m}")
            for m in MEASURES
        ],
    )


def export_rows(
    deltas: DataFrame, mode: str, period: str, source: str = "meter", targets: tuple[str, ...] = PLATFORMS
) -> DataFrame:
    """Rows to send to each platform: ``platform, external_id, name, idempotency_key, value, unit``.

    ``mode`` is ``events`` or ``cost``; ``period`` is the hour (yyyyMMddHH) or
    month (yyyy-MM) of the export cycle. Cost is in whole cents, and in
    micro-dollars for the platform that takes dollars (the same whole cents if
    the customer has another platform too). Each row has a key of its own.
    """
    if mode not in ("events", "cost"):
        raise ValueError(f"unknown export mode {mode}")
    cents = half_up(F.col("new_cost_micro") / 10_000)
    key = F.concat_ws("-", F.lit(source), "customer_id", F.lit(period), F.lit(mode))

    def row(platform, name, value, unit, when, suffix=""):
        return F.when(
            when & F.col(f"{platform}_id").isNotNull(),
            F.struct(
                F.lit(platform).alias("platform"), F.col(f"{platform}_id").alias("external_id"),
                F.lit(name).alias("name"), F.concat(key, F.lit(suffix)).alias("idempotency_key"),
                value.cast("bigint").alias("value"), F.lit(unit).alias("unit"),
            ),
        )

    events, given, made = (F.col(f"new_{m}") for m in ("event_count", "input_tokens", "output_tokens"))
    if mode == "cost":
        other = [F.col(f"{p}_id").isNotNull() for p in ("stripe", "orb") if p in targets]
        whole = other[0] | other[-1] if other else F.lit(False)
        cost = F.when(whole, cents * 10_000).otherwise(F.col("new_cost_micro"))
        rows = {
            "stripe": [row("stripe", "token_cost_usd_cents", cents, "cents", cents > 0)],
            "metronome": [row("metronome", "token_usage", cost, "micro_usd", cost > 0)],
            "orb": [row("orb", "token_usage", cents, "cents", cents > 0, "-cost")],
        }
    else:
        counted = (events > 0) | (given > 0)
        rows = {
            "stripe": [row("stripe", "token_events_processed", events, "events", events > 0)],
            "metronome": [
                row("metronome", "token_usage", given, "input_tokens", counted, "-input_tokens"),
                row("metronome", "token_usage", made, "output_tokens", counted, "-output_tokens"),
                row("metronome", "token_usage", events, "event_count", counted, "-event_count"),
            ],
            "orb": [
                row("orb", "token_usage", given, "input", given > 0, "-input"),
                row("orb", "token_usage", made, "output", made > 0, "-output"),
            ],
        }
    wanted = [r for p in PLATFORMS if p in targets for r in rows[p]]
    return deltas.select("customer_id", F.explode(F.array_compact(F.array(*wanted))).alias("_row")).select(
        "customer_id", "_row.*"
    )


def usage_quantities(usage: DataFrame, period: str) -> DataFrame:
    """Monthly quantity in millions of tokens, for invoice systems that take one number."""
    return usage.filter(F.col("period") == period).groupBy("customer_id", "period").agg(
        (F.sum("total_tokens") / F.lit(1e6)).alias("quantity_m_tokens"),
    )


def usage_cloudevents(usage: DataFrame, period: str, source: str = "meter") -> DataFrame:
    """Lifetime totals as one CloudEvents JSON text per customer.

    The id comes from customer and period, so a repeated export is the same event.
    """
    body = F.to_json(
        F.struct(
            F.lit("1.0").alias("specversion"),
            F.lit("ai.token.usage").alias("type"),
            F.lit(source).alias("source"),
            F.concat_ws("-", F.lit(source), "customer_id", F.lit(period)).alias("id"),
            F.col("customer_id").alias("subject"),
            F.struct("total_tokens", usd(F.col("cost_micro")).alias("cost_usd")).alias("data"),
        )
    )
    return usage.select("customer_id", body.alias("body"))


def due_exports(marks: DataFrame, period: str, mode: str = "monthly") -> DataFrame:
    """Export cycles to run now: monthly ones at most once per calendar month.

    ``marks``: ``target, last_period``.
    """
    if mode != "monthly":
        return marks
    return marks.filter(F.col("last_period").isNull() | (F.col("last_period") != period))


def compare_external(usage: DataFrame, external: DataFrame, keys: list[str], tolerance: int = 0) -> DataFrame:
    """Keys on which our total and another meter's differ; missing counts as 0.

    ``usage`` and ``external`` have the keys and ``total_tokens``.
    """
    ours = usage.select(*keys, F.col("total_tokens").alias("our_tokens"))
    theirs = external.select(*keys, F.col("total_tokens").alias("their_tokens"))
    joined = null_safe_join(ours, theirs, keys, "full_outer").fillna(0, ["our_tokens", "their_tokens"])
    return joined.withColumn("gap_tokens", F.col("our_tokens") - F.col("their_tokens")).filter(
        F.abs("gap_tokens") > tolerance
    )
