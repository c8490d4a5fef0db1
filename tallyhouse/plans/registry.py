"""Named queries over the supplied tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import billing_day, billing_month, trailing_periods
from ..operators import admission, billing, budget, cleaning, dedup, holds, intelligence, pricing, usage, volume
from ..schema import CUSTOMER, CUSTOMER_MODEL, TOKEN_COLUMNS
from ..session import configure, durable, shared_folder
from ..sources import events as source
from ..sources import price_lists
from ..sources import sample_tables as sample
from ..sources.catalog import Catalog, catalog_from, load_catalog, validate_catalogs, write_catalog
from ..streaming import chain, expiring, intake, late, sinks, state, windows
from .cost_store import CostStore
from .metering import billable_usage, clean_usage, core_usage, cost_tables, counters, customer_sizes, priced_usage, rebuild, stored
from .verify import differing_parts, table_digests

Query = Callable[[SparkSession, str], DataFrame]

STANDARD = catalog_from(price_lists.STANDARD)
TIERED = catalog_from(price_lists.TIERED)
# Enough tokens per event to cross tier bounds and to use up budgets.
TIER_SCALE = 2_000
BUDGET_SCALE = 20

PERIOD = "1998-06"
BASELINE = "1998-05"
TODAY = "1998-06-21"
RERATED = {
    "model_id": "gpt-4o", "old_input_price": 2.5, "new_input_price": 2.0,
    "old_output_price": 10.0, "new_output_price": 11.0,
}
BUDGETS_SET_MS = 788_918_400_000
BUDGETS_RESET_MS = 883_612_800_000
NOW_MS = 1_009_843_200_000
RERATE_END_MS = 946_684_800_000

_QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    def configured(spark: SparkSession, folder: str) -> DataFrame:
        return run(configure(spark), folder)

    _QUERIES[run.__name__] = configured
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _usage(spark, folder, scale=1):
    return sample.usage_events(spark, folder, scale)


def _priced(spark, folder, scale=1, catalog: Catalog = STANDARD, carry=(), only=None):
    return priced_usage(_usage(spark, folder, scale), catalog, carry, only=only)


def _clicks(spark, folder):
    return sample.click_usage(sample.table(spark, folder, "events"))


def _folder(spark, name) -> str:
    """A new folder name in the shared scratch space, where every executor sees it."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Cleaning ------------------------------------------------------------------


def _json_events(spark, folder, clicks=None):
    """Events as JSON text; every 97th is cut short."""
    clicks = _clicks(spark, folder) if clicks is None else clicks
    text = source.encode_events(clicks)
    return clicks.select(
        "arrival_seq", F.when(F.col("arrival_seq") % 97 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value")
    )


@query
def decoded_events(spark, folder):
    ok, _ = source.decode_events(_json_events(spark, folder))
    return ok.select(
        "arrival_seq", "event_id", "customer_id", "model_id", "input_tokens", "output_tokens",
        "reasoning_tokens", "ts_ms",
    )


@query
def rejected_events(spark, folder):
    return source.decode_events(_json_events(spark, folder))[1].select("arrival_seq", "value")


@query
def provider_payloads(spark, folder):
    """Raw provider responses in both shapes, normalised to one table."""
    events = _usage(spark, folder)
    anthropic = F.col("provider") == "anthropic"
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    openai_body = F.struct(
        F.col("event_id").alias("id"), F.col("model_id").alias("model"),
        F.struct(
            F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens"),
            F.struct(some("cache_read_tokens").alias("cached_tokens")).alias("prompt_tokens_details"),
            F.struct(some("reasoning_tokens").alias("reasoning_tokens")).alias("completion_tokens_details"),
        ).alias("usage"),
    )
    anthropic_body = F.struct(
        F.col("event_id").alias("id"), F.col("model_id").alias("model"),
        F.struct(
            "input_tokens", "output_tokens",
            some("cache_read_tokens").alias("cache_read_input_tokens"),
            some("cache_write_tokens").alias("cache_creation_input_tokens"),
        ).alias("usage"),
    )
    raw = events.select("provider", F.when(anthropic, F.to_json(anthropic_body)).otherwise(F.to_json(openai_body)).alias("payload"))
    both = source.normalize_openai(raw.filter(~anthropic)).unionByName(
        source.normalize_anthropic(raw.filter(anthropic))
    )
    return both.groupBy("provider", "model_id").agg(
        F.count("request_id").alias("requests"), *[F.sum(c).alias(c) for c in TOKEN_COLUMNS]
    )


@query
def billable_events(spark, folder):
    return cleaning.filter_billable(_usage(spark, folder)).groupBy(*CUSTOMER).agg(F.count("*").alias("events"))


def _dirty(spark, folder):
    """Events with blank customers, negative counts and unknown environments."""
    return _usage(spark, folder).withColumns(
        {
            "customer_id": F.when(F.col("latency_ms") % 53 == 0, " ").otherwise(F.col("customer_id")),
            "input_tokens": F.when(F.col("latency_ms") % 47 == 0, -1).otherwise(F.col("input_tokens")),
            "environment": F.when(F.col("latency_ms") % 41 == 0, "qa").otherwise(F.col("environment")),
        }
    )


@query
def valid_events(spark, folder):
    ok, _ = cleaning.validate_events(_dirty(spark, folder))
    return ok.groupBy("tenant_id", "environment").agg(
        F.count("*").alias("events"), F.sum("input_tokens").alias("input_tokens")
    )


@query
def quarantined_events(spark, folder):
    _, bad = cleaning.validate_events(_dirty(spark, folder))
    return bad.groupBy(F.concat_ws(",", "errors").alias("errors")).agg(F.count("*").alias("events"))


@query
def rejected_metadata(spark, folder):
    events = _usage(spark, folder).withColumn(
        "metadata",
        F.when(F.col("latency_ms") % 31 == 0, F.create_map(F.lit("feature"), F.lit("")))
        .when(F.col("latency_ms") % 29 == 0, None).otherwise(F.col("metadata")),
    )
    ok, bad = cleaning.validate_metadata(events)
    return bad.groupBy("reason").agg(F.count("*").alias("events")).unionByName(
        ok.groupBy(F.lit("accepted").alias("reason")).agg(F.count("*").alias("events"))
    )


@query
def filled_defaults(spark, folder):
    events = _usage(spark, folder).withColumn(
        "ts_ms", F.when(F.col("latency_ms") % 10 != 3, F.col("ts_ms"))
    )
    filled = cleaning.fill_defaults(events, NOW_MS)
    return filled.groupBy(*CUSTOMER).agg(
        F.max("ts_ms").alias("last_ts_ms"), F.count(F.when(F.col("ts_ms") == NOW_MS, 1)).alias("defaulted")
    )


@query
def generated_ids(spark, folder):
    """Events of which some have no id are given one; how many ids there are, and how many of them are the old ones."""
    missing = F.col("latency_ms") % 10 == 3
    events = _usage(spark, folder).withColumn("_old", F.col("event_id")).withColumn("event_id", F.when(~missing, F.col("event_id")))
    filled = stored(cleaning.fill_defaults(events, NOW_MS, new_ids=True).select(*CUSTOMER, "event_id", "_old"), f"{_folder(spark, 'ids')}/table")
    return filled.groupBy(*CUSTOMER).agg(
        F.count("*").alias("events"), F.countDistinct("event_id").alias("ids"),
        F.count(F.when(F.col("event_id") == F.col("_old"), 1)).alias("own_ids"),
    )


@query
def total_tokens(spark, folder):
    return cleaning.with_total_tokens(_usage(spark, folder)).groupBy("model_id").agg(
        F.sum("total_tokens").alias("total_tokens"), F.max("total_tokens").alias("largest")
    )


@query
def normalized_models(spark, folder):
    return cleaning.normalize_models(_usage(spark, folder), STANDARD).groupBy("raw_model_id", "model_id").agg(
        F.count("*").alias("events")
    )


@query
def scoped_tenants(spark, folder):
    events = _usage(spark, folder).withColumn(
        "tenant_id", F.when(F.col("tenant_id") == "t0", "  ").otherwise(F.concat(F.lit(" "), "tenant_id"))
    )
    return cleaning.scope_tenant(events).groupBy("tenant_id").agg(F.count("*").alias("events"))


@query
def billing_periods(spark, folder):
    return _usage(spark, folder).groupBy(
        billing_month(F.col("ts_ms")).alias("month"), billing_day(F.col("ts_ms")).alias("day")
    ).agg(F.count("*").alias("events"))


@query
def aggregation_keys(spark, folder):
    """Imported concatenated keys of three, two and one part."""
    keys = _usage(spark, folder).select(
        F.when(F.col("latency_ms") % 3 == 0, F.concat_ws("|", *CUSTOMER_MODEL))
        .when(F.col("latency_ms") % 3 == 1, F.concat_ws("|", "customer_id", "model_id"))
        .otherwise(F.col("customer_id")).alias("key")
    )
    return cleaning.split_aggregation_key(keys, "key").groupBy(*CUSTOMER_MODEL).agg(F.count("*").alias("events"))


def _overlay(spark, folder):
    return sample.table(spark, folder, "orders").selectExpr(
        "IF(o_orderstatus = 'F', 'Revenue', lower(o_orderstatus)) AS subject",
        "concat('cust_', CAST(o_custkey % 200 AS STRING)) AS customer_id",
        "o_totalprice AS value", "o_orderkey AS seq",
    )


@query
def revenue_overlay(spark, folder):
    return source.import_revenue(_overlay(spark, folder), PERIOD, "seq")[0]


@query
def revenue_overlay_counts(spark, folder):
    return source.import_revenue(_overlay(spark, folder), PERIOD, "seq")[1]


# Pricing -------------------------------------------------------------------


@query
def flat_prices(spark, folder):
    return _priced(spark, folder).select(*CUSTOMER_MODEL, "event_id", "ts_ms", "cost_micro")


@query
def customer_model_costs(spark, folder):
    """The flagship: cost per customer, model and month, dearest first."""
    months = usage.usage_by_customer_model_month(_priced(spark, folder))
    return months.orderBy(F.desc("cost_micro"), *CUSTOMER_MODEL, "period").limit(10)


@query
def volume_stamps(spark, folder):
    clean = clean_usage(_usage(spark, folder), STANDARD)
    return volume.stamp_volume(clean, sizes_from=billable_usage(_usage(spark, folder), STANDARD)).select(
        *CUSTOMER_MODEL, "month", "event_id", "ts_ms", "volume_before"
    )


@query
def tiered_prices(spark, folder):
    return _priced(spark, folder, TIER_SCALE, TIERED).select(
        *CUSTOMER_MODEL, "event_id", "ts_ms", "volume_before", "cost_micro"
    )


@query
def untiered_prices(spark, folder):
    """Tiered models priced without volume, as spans are."""
    clean = clean_usage(_usage(spark, folder, TIER_SCALE), TIERED)
    return pricing.price_events(clean, TIERED).groupBy(*CUSTOMER_MODEL).agg(F.sum("cost_micro").alias("cost_micro"))


@query
def request_estimates(spark, folder):
    requests = sample.table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", f"{sample.model_name('conv_id')} AS model_id",
        "IF(turn % 3 = 0, NULL, CAST(length(text) AS BIGINT)) AS max_tokens",
    )
    return pricing.estimate_requests(requests, STANDARD).select("conv_id", "turn", "model_id", "estimate_micro")


@query
def stream_kill_points(spark, folder):
    return pricing.stream_kill_points(sample.stream_chunks(spark, folder), STANDARD)


@query
def heartbeat_deltas(spark, folder):
    chunks = sample.stream_chunks(spark, folder).select(
        "stream_id", "chunk_ms", F.coalesce("usage_output", F.floor(F.length("content") / 4)).alias("output_tokens")
    )
    return pricing.heartbeat_deltas(chunks, 2_000)


@query
def model_switches(spark, folder):
    names = F.array(*[F.lit(m) for m in sample.MODEL_NAMES])
    scenarios = usage.usage_by_customer_model(_priced(spark, folder)).select(
        *CUSTOMER, F.col("model_id").alias("from_model"), "input_tokens", "output_tokens",
        F.get(names, (F.col("event_count") % 10).cast("int")).alias("to_model"),
        (F.col("event_count") % 4 + 1).alias("monthly_occurrences"),
    )
    return pricing.simulate_model_switch(scenarios, STANDARD).drop("notes")


@query
def prompt_reductions(spark, folder):
    scenarios = usage.usage_by_customer(_priced(spark, folder)).select(
        *CUSTOMER, (F.col("cost_micro") / 1e6).alias("cost_usd"),
        (F.col("event_count") % 50).cast("double").alias("input_reduction_pct"),
    )
    return pricing.simulate_prompt_reduction(scenarios).drop("notes")


@query
def token_grants(spark, folder):
    scenarios = usage.usage_by_customer(_priced(spark, folder)).select(
        *CUSTOMER, (F.col("cost_micro") / 1e6).alias("cost_usd"),
        (F.col("event_count") % 3 * 100_000).alias("grant_tokens"),
        (F.col("event_count") % 20).cast("double").alias("signup_lift_pct"),
        F.lit(49.0).alias("avg_revenue_per_customer_usd"),
        F.col("event_count").alias("customer_count"),
    )
    return pricing.simulate_token_grant(scenarios).drop("notes")


@query
def baseline_prices(spark, folder):
    return pricing.price_events_baseline(_usage(spark, folder)).select("event_id", "model_id", "ts_ms", "cost_nano")


@query
def catalog_violations(spark, folder):
    """One pricing document per part, many of them broken."""
    tier = "named_struct('up_to_tokens_m', {0}, 'input_per_m', p_retailprice)"
    documents = sample.table(spark, folder, "part").selectExpr(
        "p_partkey AS doc",
        "p_size", "p_retailprice",
        "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'flat' WHEN 2 THEN 'volume'"
        " WHEN 3 THEN 'graduated' ELSE 'daily' END AS mode",
        f"CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN array({tier.format('p_size')},"
        f" {tier.format('CAST(NULL AS INT)')}) ELSE array({tier.format('p_size')}, {tier.format('25')}) END AS tiers",
    ).selectExpr(
        "doc",
        "to_json(named_struct("
        "'volume_scope', IF(doc % 11 = 0, 'tenant', 'customer_model'),"
        "'defaults', IF(doc % 7 = 0, NULL, named_struct('input_per_m', 1.0D)),"
        "'models', map(concat('model-', CAST(doc AS STRING)),"
        " named_struct('pricing_mode', mode, 'tiers', tiers)))) AS body",
    )
    return validate_catalogs(documents, "doc", "body")


@query
def snapshot_prices(spark, folder):
    """Prices under a catalog that was written as a snapshot and read back."""
    path = f"{_folder(spark, 'catalog')}/snapshot"
    changed = STANDARD.with_model(
        catalog_from({"models": {"custom-llm": {"input_per_m": 4.0, "output_per_m": 8.0}}}).models["custom-llm"]
    )
    write_catalog(spark, changed, path)
    loaded = load_catalog(spark, path)
    priced = priced_usage(_usage(spark, folder), loaded)
    return priced.groupBy("model_id").agg(F.sum("cost_micro").alias("cost_micro"), F.count("*").alias("events"))


# Deduplication -------------------------------------------------------------


def _retried(spark, folder):
    """Usage plus client retries: the same event again a second or an hour later."""
    events = _usage(spark, folder)
    shift = F.when(F.col("cache_write_tokens") > 0, 1_000).when(F.col("cache_read_tokens") > 0, 5_400_000)
    retries = events.withColumn("_shift", shift).filter("_shift IS NOT NULL")
    return events.unionByName(retries.withColumn("ts_ms", F.col("ts_ms") + F.col("_shift")).drop("_shift"))


@query
def window_dedup(spark, folder):
    clean = clean_usage(_retried(spark, folder), STANDARD)
    return clean.select(*CUSTOMER_MODEL, "window_start_ms", "event_id", "ts_ms", "copies")


@query
def ttl_dedup(spark, folder):
    kept = dedup.dedup_within(core_usage(_retried(spark, folder), STANDARD), 3_600_000)
    return kept.select("event_id", "ts_ms", *CUSTOMER_MODEL)


def _windows(spark, folder, scale=1):
    return usage.usage_windows(_priced(spark, folder, scale))


@query
def windows_applied_once(spark, folder):
    found = _windows(spark, folder)
    applied = found.filter(F.col("window_start_ms") < BUDGETS_RESET_MS)
    return dedup.apply_once(found, applied).select(*dedup.WINDOW_KEYS, "cost_micro")


@query
def upserted_spans(spark, folder):
    spans = usage.usage_by_span(_priced(spark, folder))
    old = spans.withColumns({"version": F.lit(1), "total_tokens": F.lit(0).cast("bigint")})
    new = spans.filter("call_count > 3").withColumn("version", F.lit(2))
    return dedup.upsert_spans(new, old, "version").select(
        "tenant_id", "parent_span_id", "total_tokens", "cost_micro", "version"
    )


# Usage ---------------------------------------------------------------------


@query
def usage_windows(spark, folder):
    return usage.usage_windows(priced_usage(_retried(spark, folder), STANDARD))


@query
def merged_windows(spark, folder):
    priced = _priced(spark, folder)
    cached = F.col("cache_read_tokens") > 0
    return usage.merge_windows(
        usage.usage_windows(priced.filter(cached)), usage.usage_windows(priced.filter(~cached))
    )


@query
def usage_global(spark, folder):
    return usage.usage_global(_windows(spark, folder))


@query
def usage_by_customer(spark, folder):
    return usage.usage_by_customer(_priced(spark, folder))


@query
def usage_by_customer_model(spark, folder):
    return usage.usage_by_customer_model(_priced(spark, folder))


@query
def usage_rollup(spark, folder):
    return usage.usage_rollup(_priced(spark, folder))


@query
def usage_rollup_window_end(spark, folder):
    return usage.usage_rollup(_priced(spark, folder), ("day", "month"), "window_end")


@query
def usage_by_customer_model_month(spark, folder):
    return usage.usage_by_customer_model_month(_priced(spark, folder))


@query
def usage_by_session(spark, folder):
    return usage.usage_by_session(_priced(spark, folder))


@query
def retained_sessions(spark, folder):
    sessions = usage.usage_by_session(_priced(spark, folder))
    return dedup.retain(sessions, "last_ts_ms", BUDGETS_RESET_MS, dedup.RETENTION_MS["session"]).select(
        "session_id", "last_ts_ms"
    )


@query
def usage_by_span(spark, folder):
    return usage.usage_by_span(_priced(spark, folder))


@query
def span_costs_flat_and_actual(spark, folder):
    """Span cost at tier 0 and at the tier actually reached."""
    actual = _priced(spark, folder, TIER_SCALE, TIERED)
    both = pricing.price_events(actual, TIERED, 0, "flat_micro").filter("parent_span_id IS NOT NULL")
    return both.groupBy("tenant_id", "parent_span_id").agg(
        F.sum("flat_micro").alias("span_cost_flat_micro"), F.sum("cost_micro").alias("span_cost_actual_micro")
    )


@query
def span_sessions(spark, folder):
    priced = pricing.price_events(
        cleaning.normalize_models(
            _clicks(spark, folder).withColumn("ts", F.timestamp_millis("ts_ms")), STANDARD
        ),
        STANDARD,
    )
    return usage.span_sessions(priced)


@query
def usage_by_dim(spark, folder):
    return usage.usage_by_dim(_priced(spark, folder, carry=("metadata",)))


@query
def usage_per_minute(spark, folder):
    return usage.usage_per_minute(pricing.price_events_baseline(_usage(spark, folder)))


@query
def minute_totals(spark, folder):
    return usage.minute_totals(usage.usage_per_minute(pricing.price_events_baseline(_usage(spark, folder))))


def _cost_tables(spark, folder, scale=1):
    return cost_tables(_priced(spark, folder, scale, carry=("metadata",)))


@query
def global_period_costs(spark, folder):
    return usage.period_costs(_cost_tables(spark, folder)["customer_costs"], [])


@query
def customer_period_costs(spark, folder):
    return usage.period_costs(_cost_tables(spark, folder)["customer_costs"], ["customer_id"])


@query
def model_period_costs(spark, folder):
    return usage.period_costs(_cost_tables(spark, folder)["model_costs"], ["model_id"], [PERIOD, BASELINE])


@query
def global_daily_costs(spark, folder):
    return usage.daily_costs(usage.usage_rollup(_priced(spark, folder), ("day",)))


@query
def customer_daily_costs(spark, folder):
    return usage.daily_costs(usage.usage_rollup(_priced(spark, folder), ("day",)), CUSTOMER, PERIOD)


@query
def feature_cost_series(spark, folder):
    return usage.dim_margin_series(
        usage.usage_by_dim(_priced(spark, folder, carry=("metadata",))), "feature", [BASELINE, PERIOD]
    )


@query
def tenant_plan_usage(spark, folder):
    plans = F.array(*[F.lit(p[0]) for p in usage.PLAN_LIMITS])
    tenants = sample.table(spark, folder, "nation").select(
        F.concat(F.lit("t"), (F.col("n_nationkey") % 5).cast("string")).alias("tenant_id"),
        F.get(plans, F.col("n_nationkey") % 5 % 4).alias("plan"),
    ).distinct()
    return usage.tenant_plan_usage(_priced(spark, folder), tenants, usage.plan_limits(spark), PERIOD)


@query
def spend_by_key(spark, folder):
    return usage.spend_by_key(_priced(spark, folder))


@query
def freshness(spark, folder):
    return usage.freshness(_windows(spark, folder), NOW_MS, 60)


@query
def top_spans(spark, folder):
    return usage.top_spans(usage.usage_by_span(_priced(spark, folder)), 3).select(
        *CUSTOMER, "rank", "parent_span_id", "cost_micro"
    )


@query
def top_customers_by_cost(spark, folder):
    return usage.top_customers(usage.usage_by_customer(_priced(spark, folder)), "cost_micro").select(
        *CUSTOMER, "cost_micro", "total_tokens"
    )


@query
def top_customers_by_tokens(spark, folder):
    return usage.top_customers(usage.usage_by_customer(_priced(spark, folder)), "total_tokens").select(
        *CUSTOMER, "cost_micro", "total_tokens"
    )


@query
def live_series(spark, folder):
    return usage.live_series(_priced(spark, folder))


# Budgets -------------------------------------------------------------------


def _seed_movements(spark, folder):
    """Budgets set once, again for some customers, and their top-ups."""
    seeds = sample.budgets(spark, folder)

    def sets(frame, at, ref):
        return budget.movements(
            frame.select(
                *CUSTOMER, F.lit(at).cast("bigint").alias("ts_ms"), F.lit(ref).alias("ref"),
                F.col("initial_micro").alias("amount_micro"), "alert_threshold_micro",
            ),
            "set",
        )

    again = seeds.filter("CAST(substring(customer_id, 6) AS INT) % 7 = 0")
    return (
        sets(seeds, BUDGETS_SET_MS, "first")
        .unionByName(sets(again, BUDGETS_RESET_MS, "again"))
        .unionByName(budget.movements(sample.topups(spark, folder), "topup"))
    )


# What a usage window reads of events, beyond keys, time and tokens.
WINDOWED = ("latency_ms",)


def _ledger(spark, folder, priced=None):
    """The ledger of all events; ``priced`` are those, if they are stored."""
    seeds = _seed_movements(spark, folder)
    if priced is not None:
        hot = customer_sizes(priced, seeds)
        if hot.frame is None:
            # Windows are summed where their customer's ledger is made, instead of moving to be summed and again to be booked.
            priced, seeds = priced.repartition(*CUSTOMER), seeds.repartition(*CUSTOMER)
        return budget.budget_ledger(seeds.unionByName(budget.cost_movements(usage.usage_windows(priced))), hot)
    charges = budget.cost_movements(usage.usage_windows(_priced(spark, folder, BUDGET_SCALE, only=WINDOWED)))
    # Written once, for their sizes and for the ledger.
    return budget.budget_ledger(stored(seeds.unionByName(charges), f"{_folder(spark, 'moves')}/table"))


def _stored_priced(spark, folder, scale, carry=(), only=None):
    """The priced table, written once for queries that read it several times."""
    return stored(_priced(spark, folder, scale, carry=carry, only=only), f"{_folder(spark, 'priced')}/table")


@query
def budget_ledger(spark, folder):
    return _ledger(spark, folder).select(
        *CUSTOMER, "ts_ms", "ref", "kind", "epoch", "amount_micro", "balance_micro", "debt_micro",
        F.coalesce("balance_before_micro", F.lit(0)).alias("balance_before_micro"), "topup_micro", "deducted_micro",
    )


@query
def budget_alerts(spark, folder):
    return budget.budget_alerts(_ledger(spark, folder))


@query
def first_budget_alerts(spark, folder):
    return budget.budget_alerts(_ledger(spark, folder), first_only=True)


@query
def warn_ladder(spark, folder):
    ledger = _ledger(spark, folder).select(*budget.WARN_COLUMNS)
    return budget.warn_ladder(stored(ledger, f"{_folder(spark, 'ledger')}/table"))


@query
def budget_status(spark, folder):
    return budget.budget_status(
        _ledger(spark, folder), usage.usage_by_customer(_priced(spark, folder, BUDGET_SCALE))
    )


@query
def balance_drifts(spark, folder):
    return budget.reconcile(_ledger(spark, folder))[0]


@query
def balance_drift_report(spark, folder):
    return budget.listed_drifts(budget.reconcile(_ledger(spark, folder))[0])


@query
def balance_drift_summary(spark, folder):
    return budget.reconcile(_ledger(spark, folder))[1]


@query
def rebuilt_balances(spark, folder):
    """Budget state of one tenant, rebuilt from its stored events."""
    tables = rebuild(_usage(spark, folder, BUDGET_SCALE), _seed_movements(spark, folder), STANDARD, tenant="t1")
    return tables["budget_state"].select(*CUSTOMER, "balance_micro", "debt_micro", "deducted_micro")


# Columns of the rebuilt tables that are compared; of the others all.
_COMPARED = {
    "budget_ledger": [
        *CUSTOMER, "ts_ms", "seq", "ref", "kind", "epoch", "amount_micro", "balance_micro", "debt_micro", "topup_micro", "deducted_micro",
    ],
    "budget_state": [*CUSTOMER, "balance_micro", "debt_micro", "topup_micro", "deducted_micro"],
}


@query
def rebuild_digests(spark, folder):
    """Every table for all tenants, from months priced as their events came (in two lots) and rebuilt from all stored events."""
    out = _folder(spark, "rebuild")
    store, seeds = CostStore(spark, f"{out}/store"), _seed_movements(spark, folder)
    events = _usage(spark, folder, BUDGET_SCALE)
    late_lot = F.col("latency_ms") % 5 == 0
    store.add(events.filter(~late_lot), "first", STANDARD)
    store.add(events.filter(late_lot), "late", STANDARD)
    landed = store.read("events").drop("period", "batch")
    kept = store.read("priced").drop("period")
    sides = {
        "kept": counters(kept, seeds, customer_sizes(landed, seeds), f"{out}/kept"),
        "rebuilt": rebuild(landed, seeds, STANDARD, path=f"{out}/rebuilt"),
    }
    found = [
        table_digests({n: df.select(*_COMPARED.get(n, df.columns)) for n, df in tables.items()}).withColumn("side", F.lit(side))
        for side, tables in sides.items()
    ]
    return found[0].unionByName(found[1])


@query
def rebuild_stale_tenants(spark, folder):
    """Tenants whose stored monthly costs lack a lot of late events, found against the rebuilt ones."""
    priced = _stored_priced(spark, folder, BUDGET_SCALE)
    lost = F.col("tenant_id").isin("t1", "t3") & (F.col("latency_ms") % 5 == 0)
    stale = usage.usage_by_customer_model_month(priced.filter(~lost))
    return differing_parts(usage.usage_by_customer_model_month(priced), stale, ["tenant_id"])


def _request_id():
    return F.concat_ws("|", "event_id", "ts_ms", "model_id").alias("request_id")


def _requests(priced):
    """Each event as the request that led to it, estimated at its own price."""
    return priced.select(
        *CUSTOMER, _request_id(), "ts_ms", F.col("cost_micro").alias("estimate_micro"), "parent_span_id", "session_id", "key_id",
    )


@query
def asof_balances(spark, folder):
    priced = _stored_priced(spark, folder, BUDGET_SCALE, only=WINDOWED)
    ledger = _ledger(spark, folder, priced)
    states = ledger.select(
        *CUSTOMER, "ts_ms", admission.ledger_order().alias("state_seq"), "balance_micro"
    )
    requests = priced.select(*CUSTOMER, "ts_ms", _request_id())
    # A request and a charge are one priced event each at most, so the ledger is not made twice to measure it.
    hot = customer_sizes(priced.select(*CUSTOMER).unionByName(priced.select(*CUSTOMER)), _seed_movements(spark, folder))
    return admission.asof_state(requests, states, CUSTOMER, ["balance_micro"], ["request_id"], hot)


@query
def check_decisions(spark, folder):
    priced = _stored_priced(spark, folder, BUDGET_SCALE)
    limits = sample.budgets(spark, folder).select(*CUSTOMER, F.lit(1).alias("max_rpm"))
    span_caps = priced.filter("parent_span_id IS NOT NULL").groupBy("parent_span_id").agg(
        F.floor(F.sum("cost_micro") / 2).alias("span_cap_micro")
    )
    session_caps = priced.groupBy("session_id").agg((F.max("cost_micro") * 4).alias("session_cap_micro"))
    key_caps = priced.groupBy("key_id").agg(
        (F.max("cost_micro") * 2).alias("daily_cap_micro"), (F.max("cost_micro") * 3).alias("monthly_cap_micro")
    )
    decided = admission.check_decisions(
        _requests(priced), _ledger(spark, folder, priced), "estimate_micro", limits, span_caps, session_caps, key_caps
    )
    return decided.select(*CUSTOMER, "request_id", "balance_micro", "reason", "allowed")


@query
def hold_ledger(spark, folder):
    """Every event reserves its price when sent and reconciles when it ends; spans are capped at three quarters of what they cost."""
    priced = _stored_priced(spark, folder, BUDGET_SCALE, only=(*WINDOWED, "parent_span_id"))
    owners = priced.select(*CUSTOMER)
    # Two actions and at most one charge of each event, and the other movements.
    hot = customer_sizes(owners.unionByName(owners).unionByName(owners), _seed_movements(spark, folder))
    sent = priced.select(*CUSTOMER, "event_id", "ts_ms", "model_id", "parent_span_id", "latency_ms", "cost_micro")
    # Events move to their customer before each becomes two actions.
    sent = sent.repartition(*CUSTOMER) if hot.frame is None else sent
    request_id = F.concat_ws("|", "event_id", "ts_ms", "model_id")
    reserve_id = F.concat(F.lit("a|"), request_id)
    end = F.col("ts_ms") + F.col("latency_ms") * 3_000_000
    both = F.array(
        F.struct(F.lit("reserve").alias("action"), F.col("ts_ms").alias("ts_ms"), reserve_id.alias("action_id"), F.lit(None).cast("string").alias("reserve_id")),
        F.struct(F.lit("reconcile").alias("action"), end.alias("ts_ms"), F.concat(F.lit("b|"), request_id).alias("action_id"), reserve_id.alias("reserve_id")),
    )
    actions = sent.select(*CUSTOMER, "parent_span_id", F.col("cost_micro").alias("amount_micro"), F.explode(both).alias("_a"))
    actions = actions.select(*CUSTOMER, "parent_span_id", "amount_micro", "_a.*")
    states = _ledger(spark, folder, priced).select(
        *CUSTOMER, "ts_ms", admission.ledger_order().alias("state_seq"), "balance_micro"
    )
    with_balance = admission.asof_state(actions, states, CUSTOMER, ["balance_micro"], ["action_id"], hot)
    spans = priced.filter("parent_span_id IS NOT NULL").groupBy("parent_span_id")
    caps = spans.agg(F.floor(F.sum("cost_micro") * 3 / 4).alias("span_cap_micro"))
    return holds.hold_ledger(with_balance, caps, hot).select(*CUSTOMER, "action_id", "accepted", "held_micro", "reason")


def _draws(spark, folder):
    """Events that each draw once, with what a package reads of them."""
    events = dedup.dedup_within(core_usage(_usage(spark, folder), STANDARD), dedup.RETENTION_MS["dedup"])
    return events.select(*CUSTOMER, "event_id", "ts_ms", *TOKEN_COLUMNS)


@query
def package_drawdown(spark, folder):
    packages = sample.table(spark, folder, "customer").selectExpr("c_custkey % 200 AS n").distinct().filter(
        "n % 5 = 0"
    ).select(F.concat(F.lit("cust_"), F.col("n").cast("string")).alias("customer_id"), F.lit(50_000).cast("bigint").alias("tokens"))
    return holds.package_drawdown(_draws(spark, folder), packages).select(
        "customer_id", "event_id", "ts_ms", "total_tokens", "accepted", "remaining_tokens"
    )


@query
def tenant_packages(spark, folder):
    """Packages of each tenant's customers, of a size by tenant."""
    owners = sample.table(spark, folder, "customer").selectExpr("c_nationkey % 5 AS t", "c_custkey % 200 AS n").distinct().filter("n % 3 = 0")
    packages = owners.selectExpr(
        "concat('t', CAST(t AS STRING)) AS tenant_id", "concat('cust_', CAST(n AS STRING)) AS customer_id",
        "CAST(20000 + 10000 * t AS BIGINT) AS tokens",
    )
    return holds.package_drawdown(_draws(spark, folder), packages).select(
        *CUSTOMER, "event_id", "ts_ms", "total_tokens", "accepted", "remaining_tokens"
    )


# Billing -------------------------------------------------------------------


@query
def rerate_between(spark, folder):
    """The price change applied to two years only."""
    chosen = billing.usage_between(_windows(spark, folder), BUDGETS_RESET_MS, RERATE_END_MS)
    return billing.rerate_adjustments(chosen, RERATED, STANDARD)


@query
def rerate_preview(spark, folder):
    return billing.rerate_preview(usage.usage_by_customer_model(_priced(spark, folder)), RERATED, STANDARD)[0]


@query
def rerate_preview_totals(spark, folder):
    return billing.rerate_preview(usage.usage_by_customer_model(_priced(spark, folder)), RERATED, STANDARD)[1]


def _rerated(spark, folder, priced=None):
    priced = _priced(spark, folder) if priced is None else priced
    return billing.rerate_apply(usage.usage_by_customer_model(priced), RERATED, STANDARD, NOW_MS)


@query
def rerated_customers(spark, folder):
    return _rerated(spark, folder)[1]


@query
def rerated_tenants(spark, folder):
    return _rerated(spark, folder)[2]


@query
def rerated_balances(spark, folder):
    """Budget state after a re-rate was booked as ledger movements."""
    # Deduplicated once for both scales: the larger one multiplies the tokens of every copy alike.
    clean = stored(clean_usage(_usage(spark, folder), STANDARD, only=WINDOWED), f"{_folder(spark, 'clean')}/table")
    moves = _rerated(spark, folder, pricing.price_events(clean, STANDARD))[3]
    scaled = clean.withColumns({c: F.col(c) * BUDGET_SCALE for c in TOKEN_COLUMNS})
    charges = budget.cost_movements(usage.usage_windows(pricing.price_events(scaled, STANDARD)))
    seeds = _seed_movements(spark, folder)
    ledger = budget.budget_ledger(seeds.unionByName(charges).unionByName(moves), customer_sizes(clean, seeds))
    return budget.latest_state(ledger).select(*CUSTOMER, "balance_micro", "debt_micro")


@query
def rerate_replay(spark, folder):
    cheaper = TIERED.with_model(
        catalog_from({"models": {"gpt-4o-mini": {"input_per_m": 0.11, "output_per_m": 0.5}}}).models["gpt-4o-mini"]
    )
    events = _usage(spark, folder, TIER_SCALE)
    return billing.rerate_replay(
        clean_usage(events, TIERED), TIERED, cheaper, sizes_from=billable_usage(events, TIERED)
    ).filter("delta_micro <> 0")


def _customer_usage(spark, folder, until_ms=None, priced=None):
    """Usage per customer id, tenants together, as the export reads it."""
    priced = _priced(spark, folder) if priced is None else priced
    priced = priced if until_ms is None else priced.filter(F.col("ts_ms") < until_ms)
    return priced.groupBy("customer_id").agg(
        *[column.alias(name) for name, column in usage.event_measures().items()
          if name in ("event_count", "input_tokens", "output_tokens", "total_tokens", "cost_micro")]
    )


def _marks(spark, folder):
    """What was reported up to the reset day."""
    before = _priced(spark, folder).filter(F.col("ts_ms") < BUDGETS_RESET_MS)
    measures = usage.event_measures()
    return before.groupBy("customer_id").agg(
        *[measures[m].alias(f"last_{m}") for m in ("event_count", "input_tokens", "output_tokens", "cost_micro")]
    )


def _deltas(spark, folder):
    return billing.export_deltas(
        _customer_usage(spark, folder).drop("total_tokens"), _marks(spark, folder), sample.billing_links(spark, folder)
    )


@query
def billable_customers(spark, folder):
    return billing.billable_customers(
        _customer_usage(spark, folder).select("customer_id", "cost_micro"), sample.billing_links(spark, folder)
    )


@query
def linked_customers(spark, folder):
    return billing.linked_customers(sample.billing_links(spark, folder))


@query
def export_deltas(spark, folder):
    return _deltas(spark, folder)


@query
def export_marks(spark, folder):
    """Marks after the cost export."""
    deltas = _deltas(spark, folder)
    return billing.advance_marks(_marks(spark, folder), deltas, billing.export_rows(deltas, "cost", "1998-01"), "cost")


EXPORTED = ["customer_id", "ts_ms", *TOKEN_COLUMNS, "cost_micro"]
EXPORT_CYCLES_MS = [BUDGETS_SET_MS + 30 * 86_400_000, BUDGETS_SET_MS + 60 * 86_400_000, BUDGETS_RESET_MS, NOW_MS]


@query
def export_cycles(spark, folder):
    """Cents reported in four cost cycles, each from the marks of the one before."""
    marks, sent = _marks(spark, folder).limit(0), []
    links = sample.billing_links(spark, folder)
    # Deduplicated and priced once for all cycles.
    priced = stored(_priced(spark, folder, only=()).select(*EXPORTED), f"{_folder(spark, 'exported')}/table")
    for until in EXPORT_CYCLES_MS:
        deltas = billing.export_deltas(_customer_usage(spark, folder, until, priced).drop("total_tokens"), marks, links)
        rows = billing.export_rows(deltas, "cost", str(until))
        marks = durable(billing.advance_marks(marks, deltas, rows, "cost"))
        sent.append(rows)
    rows = sent[0].unionByName(sent[1]).unionByName(sent[2]).unionByName(sent[3])
    return rows.filter("unit = 'cents'").groupBy("customer_id", "platform").agg(
        F.sum("value").alias("cents"), (F.count("*") == F.count_distinct("idempotency_key")).alias("keys_differ")
    )


@query
def export_rows_events(spark, folder):
    return billing.export_rows(_deltas(spark, folder), "events", "1998010100")


@query
def export_rows_cost(spark, folder):
    return billing.export_rows(_deltas(spark, folder), "cost", "1998-01")


@query
def due_exports(spark, folder):
    """Per customer: the last exported month is that of its last order."""
    marks = sample.table(spark, folder, "orders").groupBy(
        F.concat(F.lit("cust_"), (F.col("o_custkey") % 200).cast("string")).alias("target")
    ).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("last_period"))
    return billing.due_exports(marks, "2001-07")


@query
def usage_quantities(spark, folder):
    return billing.usage_quantities(usage.usage_by_customer_model_month(_priced(spark, folder)), PERIOD)


@query
def usage_cloudevents(spark, folder):
    parsed = billing.usage_cloudevents(_customer_usage(spark, folder), PERIOD)
    return parsed.select(
        "customer_id", F.get_json_object("body", "$.id").alias("id"),
        F.get_json_object("body", "$.subject").alias("subject"),
        F.get_json_object("body", "$.data.total_tokens").cast("bigint").alias("total_tokens"),
    )


@query
def external_gaps(spark, folder):
    """Our totals against a meter that missed cached traffic of production."""
    priced = _priced(spark, folder, carry=("environment",))
    ours = priced.groupBy(*CUSTOMER).agg(F.sum(cleaning.total_tokens()).alias("total_tokens"))
    theirs = priced.filter("environment = 'staging' OR cache_read_tokens = 0").groupBy(*CUSTOMER).agg(
        F.sum(cleaning.total_tokens()).alias("total_tokens")
    )
    return billing.compare_external(ours, theirs, CUSTOMER, tolerance=10_000)


# Intelligence --------------------------------------------------------------


class _Stores:
    """Cost stores of this session by folder; a month is made when a report first reads it."""

    def __init__(self):
        self.known: dict[tuple[str, str, int], tuple[CostStore, list, set]] = {}

    def tables(self, spark, folder, periods, scale=BUDGET_SCALE):
        key = (spark.sparkContext.applicationId, folder, scale)
        if key not in self.known:
            store = CostStore(spark, _folder(spark, "costs"))
            self.known[key] = store, store.land(_usage(spark, folder, scale), "all"), set()
        store, landed, made = self.known[key]
        new = [p for p in landed if (periods is None or p in periods) and p not in made]
        store.refresh(STANDARD, new)
        made.update(new)
        return store.tables()


_STORES = _Stores()


def _tables(spark, folder, periods=(BASELINE, PERIOD)):
    """Stored cost tables with at least these months (None: all)."""
    found = _STORES.tables(spark, folder, periods)
    return found["customer_costs"], found["model_costs"], found["dim_costs"], found["daily"]


@query
def late_event_costs(spark, folder):
    """Costs of two months in a store to which events of the second came late, in a batch of their own that was landed twice."""
    store = CostStore(spark, _folder(spark, "costs"))
    months = billing_month(F.col("ts_ms")).isin(BASELINE, PERIOD)
    events = _usage(spark, folder).filter(months)
    late = (billing_month(F.col("ts_ms")) == PERIOD) & (F.col("latency_ms") % 5 == 0)
    store.add(events.filter(~late), "first", STANDARD)
    store.land(events.filter(late), "late")
    store.add(events.filter(late), "late", STANDARD)
    return usage.period_costs(store.tables()["model_costs"], ["model_id"], [PERIOD, BASELINE])


@query
def root_cause(spark, folder):
    customers, models, dims, _ = _tables(spark, folder)
    return intelligence.root_cause(customers, models, dims, PERIOD, BASELINE)


@query
def root_cause_of_customer(spark, folder):
    customers, models, dims, _ = _tables(spark, folder)
    return intelligence.root_cause(customers, models, dims, PERIOD, BASELINE, customer="cust_24")


@query
def root_cause_totals(spark, folder):
    return intelligence.root_cause_totals(_tables(spark, folder)[0], PERIOD, BASELINE)


def _summary(spark, folder):
    customers, models, dims, _ = _tables(spark, folder)
    return intelligence.root_cause_summary(
        intelligence.root_cause_totals(customers, PERIOD, BASELINE),
        intelligence.root_cause(customers, models, dims, PERIOD, BASELINE),
        BASELINE,
    )


@query
def root_cause_summary(spark, folder):
    return _summary(spark, folder).select("summary")


def _economics(spark, folder):
    return intelligence.unit_economics(_tables(spark, folder)[0], sample.revenue(spark, folder), PERIOD)


@query
def unit_economics(spark, folder):
    return _economics(spark, folder)


@query
def profitability_totals(spark, folder):
    return intelligence.profitability_totals(_economics(spark, folder))


@query
def profitability_products(spark, folder):
    return intelligence.profitability_products(_economics(spark, folder), _tables(spark, folder)[2], PERIOD)


@query
def profitability_trend(spark, folder):
    return intelligence.profitability_trend(
        _tables(spark, folder, trailing_periods(PERIOD, 6))[0], sample.revenue(spark, folder), PERIOD, 6
    )


@query
def cheaper_models(spark, folder):
    return intelligence.cheaper_model(usage.usage_by_customer_model(_priced(spark, folder)), STANDARD).select(
        *CUSTOMER_MODEL, "from_cost_micro", "to_model", "to_cost_micro"
    )


@query
def pricing_recommendations(spark, folder):
    advice = intelligence.pricing_recommendations(
        _economics(spark, folder), _tables(spark, folder)[1], STANDARD, PERIOD
    )
    return advice.drop("suggested_change")


@query
def top_recommendations(spark, folder):
    advice = intelligence.pricing_recommendations(
        _economics(spark, folder), _tables(spark, folder)[1], STANDARD, PERIOD
    )
    return intelligence.ranked_recommendations(advice, 5).select("customer_id", "action", "roi_annual_usd")


@query
def global_forecast(spark, folder):
    return intelligence.forecast(_tables(spark, folder)[3], PERIOD, TODAY)


def _customer_forecasts(spark, folder):
    budgets = sample.budgets(spark, folder).select(
        *CUSTOMER, (F.col("initial_micro") / 1e7).alias("budget_usd")
    )
    return intelligence.forecast(_tables(spark, folder)[3], PERIOD, TODAY, CUSTOMER, budgets)


@query
def customer_forecasts(spark, folder):
    return _customer_forecasts(spark, folder).drop("summary")


def _previous_losers(spark, folder):
    economics = intelligence.unit_economics(
        _tables(spark, folder)[0], sample.revenue(spark, folder), BASELINE
    )
    return economics.filter("status = 'loss'").select("customer_id")


@query
def margin_loss_alert(spark, folder):
    return intelligence.detect_margin_loss(
        _economics(spark, folder), _previous_losers(spark, folder), PERIOD
    )[0]


@query
def cost_spike_alert(spark, folder):
    return intelligence.detect_cost_spike(_summary(spark, folder), PERIOD, limit_pct=-100.0)


@query
def forecast_risk_alerts(spark, folder):
    return intelligence.detect_forecast_risk(_customer_forecasts(spark, folder), PERIOD).groupBy("type", "period").agg(
        F.count("*").alias("alerts")
    )


@query
def debounced_alerts(spark, folder):
    """Forecast alerts of every month against those sent in the last day."""
    months = _tables(spark, folder, None)[0].select("period").distinct()
    alerts = months.select(F.lit("INTEL_FORECAST_RISK").alias("type"), "period")
    sent = months.filter("period < '1998-01'").select(
        F.lit("INTEL_FORECAST_RISK").alias("type"), "period",
        (F.lit(NOW_MS) - F.substring("period", 6, 2).cast("bigint") * 10_000_000).alias("sent_ms"),
    )
    return intelligence.debounce_alerts(alerts, sent, NOW_MS)


@query
def report_headline(spark, folder):
    customers, models, dims, daily = _tables(spark, folder, trailing_periods(PERIOD, 6))
    return intelligence.report(customers, models, dims, daily, sample.revenue(spark, folder), STANDARD, PERIOD, TODAY)["headline"]


def _report_part(name: str, part: str) -> None:
    """Register one part of the monthly report, made by the report itself."""
    def run(spark, folder):
        customers, models, dims, daily = _tables(spark, folder, trailing_periods(PERIOD, 6))
        parts = intelligence.report(customers, models, dims, daily, sample.revenue(spark, folder), STANDARD, PERIOD, TODAY)
        return parts[part]

    run.__name__ = name
    query(run)


for _name, _part in (
    ("report_root_cause", "root_cause"), ("report_contributors", "contributors"), ("report_losses", "loss_customers"),
    ("report_profitability", "profitability_totals"), ("report_by_customer", "profitability_by_customer"),
    ("report_by_product", "profitability_by_product"), ("report_trend", "profitability_trend"),
    ("report_recommendations", "top_recommendations"), ("report_forecast", "forecast"),
):
    _report_part(_name, _part)


@query
def recommendation_texts(spark, folder):
    """All advice of the month with its wording."""
    return intelligence.pricing_recommendations(_economics(spark, folder), _tables(spark, folder)[1], STANDARD, PERIOD)


def _tenant_economics(spark, folder):
    return intelligence.unit_economics(_tables(spark, folder)[0], sample.tenant_revenue(spark, folder), PERIOD, CUSTOMER)


@query
def tenant_economics(spark, folder):
    """Economics of each tenant's customers; one name in two tenants is two customers."""
    return _tenant_economics(spark, folder)


@query
def tenant_recommendations(spark, folder):
    return intelligence.pricing_recommendations(
        _tenant_economics(spark, folder), _tables(spark, folder)[1], STANDARD, PERIOD, CUSTOMER
    )


@query
def forecast_summaries(spark, folder):
    return _customer_forecasts(spark, folder).select(*CUSTOMER, "status", "summary")


@query
def forecast_risk_texts(spark, folder):
    return intelligence.detect_forecast_risk(_customer_forecasts(spark, folder), PERIOD, CUSTOMER)


@query
def cost_spike_customers(spark, folder):
    """Customers of each tenant whose cost rose by more than a quarter over the month before."""
    totals = intelligence.root_cause_totals(_tables(spark, folder)[0], PERIOD, BASELINE, keys=CUSTOMER)
    return intelligence.detect_cost_spike(intelligence.change_summary(totals, BASELINE), PERIOD, keys=CUSTOMER)


# Streams -------------------------------------------------------------------


def _click_stream(spark, folder):
    """The events table as a stream, in file order."""
    raw = (
        spark.readStream.schema(sample.table(spark, folder, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
    )
    return sample.click_usage(raw)


def _lots(spark, folder, out):
    """Priced events in a stream's folder, as five lots that come one after the other in time."""
    named = cleaning.normalize_models(_clicks(spark, folder), STANDARD)
    priced = pricing.price_events(named, STANDARD)
    lot = F.least(F.lit(4), F.floor((F.dayofmonth(F.timestamp_millis("ts_ms")) - 1) / 6))
    lots = stored(priced.withColumn("lot", lot), f"{out}/lots")
    for n in range(5):
        lots.filter(F.col("lot") == n).drop("lot").write.mode("append").parquet(f"{out}/in")
        yield spark.readStream.schema(lots.drop("lot").schema).parquet(f"{out}/in")


def _updates(spark, folder, name, counted):
    """The last update of each key of a stream that runs over the lots with a restart between them."""
    out = _folder(spark, name)
    for stream in _lots(spark, folder, out):
        _finish(sinks.write_windows(counted(stream), f"{out}/table", f"{out}/checkpoint", mode="update"))
    return spark.read.parquet(f"{out}/table")


@query
def stream_kept_spans(spark, folder):
    """Span totals of a stream that forgets a span a day after its last event."""
    return expiring.latest(_updates(spark, folder, "spans", expiring.span_totals_stream), expiring.SPAN_KEYS)


@query
def stream_kept_minutes(spark, folder):
    """Minute totals of a stream that forgets a minute after a day."""
    updates = _updates(spark, folder, "minutes", lambda df: expiring.counters_stream(df, "minute"))
    return expiring.latest(updates, [*CUSTOMER, "start_ms"])


def _taken_in(spark, folder):
    """JSON events from a folder of text files that fills up in four lots, with a restart between them."""
    out = _folder(spark, "intake")
    clicks = _clicks(spark, folder).withColumn("latency_ms", F.when(F.col("arrival_seq") % 89 == 0, -1).otherwise(F.col("latency_ms")))
    lots = stored(_json_events(spark, folder, clicks), f"{out}/lots")
    for n in range(4):
        lots.filter(F.col("arrival_seq") % 4 == n).select("value").write.mode("append").text(f"{out}/in")
        raw = source.read_events_stream(spark, f"{out}/in")
        _finish(intake.intake_stream(raw, f"{out}/table", f"{out}/checkpoint"))
    return intake.read_intake(spark, f"{out}/table")


@query
def stream_accepted_events(spark, folder):
    return _taken_in(spark, folder)[0].select(
        "event_id", "customer_id", "model_id", "input_tokens", "output_tokens", "reasoning_tokens", "ts_ms", "latency_ms"
    )


@query
def stream_rejected_events(spark, folder):
    return _taken_in(spark, folder)[1].select(F.concat_ws(",", "errors").alias("errors"), F.substring("value", 1, 20).alias("head"))


def _finish(query) -> None:
    query.awaitTermination()


def _priced_stream(spark, folder):
    named = cleaning.normalize_models(windows.with_event_time(_click_stream(spark, folder)), STANDARD)
    return pricing.price_events(named, STANDARD)


@query
def stream_windows(spark, folder):
    """Windows closed by the watermark, written exactly once."""
    out = _folder(spark, "windows")
    stream = windows.usage_windows_stream(windows.dedup_window_stream(_priced_stream(spark, folder)))
    _finish(sinks.write_windows(stream, f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table").drop("batch_id")


@query
def stream_span_sessions(spark, folder):
    out = _folder(spark, "sessions")
    _finish(
        sinks.write_windows(
            windows.span_sessions_stream(_priced_stream(spark, folder)), f"{out}/table", f"{out}/checkpoint"
        )
    )
    return spark.read.parquet(f"{out}/table").drop("batch_id")


@query
def stream_volume_stamps(spark, folder):
    out = _folder(spark, "volume")
    named = cleaning.normalize_models(_click_stream(spark, folder), STANDARD)
    stream = state.stamp_volume_stream(named)
    _finish(sinks.write_windows(stream, f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table").select("event_id", "customer_id", "model_id", "month", "volume_before")


ARRIVAL = ["arrival_seq", "event_id", "input_tokens", "output_tokens"]


@query
def stream_month_volumes(spark, folder):
    """Month volumes of several years that arrive in four lots, months out of order; the stream is stopped and restarted between them.

    ``arrival_seq`` is the order of arrival: the lot, then event time backwards.
    """
    out = _folder(spark, "months")
    cleaned = clean_usage(_usage(spark, folder, TIER_SCALE), TIERED, only=()).drop("metadata", "copies", "window_start_ms")
    lot = F.pmod(F.length("event_id") + F.ascii(F.element_at(F.split("event_id", "-"), 2)), F.lit(4))
    named = cleaned.withColumn("lot", lot).withColumn("arrival_seq", F.col("lot").cast("long") * 10**14 - F.col("ts_ms"))
    named.write.partitionBy("lot").parquet(f"{out}/lots")  # each lot is read once, alone
    schema = named.drop("lot").schema
    for n in range(4):
        spark.read.schema(named.schema).parquet(f"{out}/lots").filter(F.col("lot") == n).drop("lot").write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(schema).parquet(f"{out}/in")
        _finish(state.stamp_volume_batches(stream, ARRIVAL, f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table/events").select("event_id", *CUSTOMER_MODEL, "month", "volume_before")


def _budget_seeds(spark, folder, scale):
    """A budget for each customer of the table, as a stream of movements."""
    raw = spark.readStream.schema(sample.table(spark, folder, "customer").schema).option("pathGlobFilter", "customer.parquet").parquet(folder)
    return raw.selectExpr(
        "CAST(NULL AS STRING) AS tenant_id", "concat('cust_', CAST(c_custkey AS STRING)) AS customer_id",
        "0L AS ts_ms", "0L AS seq", "'first' AS ref", "'set' AS kind",
        f"CAST(floor(abs(c_acctbal) * {scale} + 0.5D) AS BIGINT) AS amount_micro",
        "CAST(NULL AS BIGINT) AS alert_threshold_micro", "CAST(NULL AS STRING) AS model_id",
    )


@query
def stream_metered_budgets(spark, folder):
    """The whole job on events that come twice and in four lots, with a restart between lots: dedup, volume, tiered price, windows, budgets, alerts.

    A last event of nobody's, weeks later, closes the windows of all others.
    """
    out = _folder(spark, "metered")
    clicks = _clicks(spark, folder).withColumns({c: F.col(c) * 20_000 for c in TOKEN_COLUMNS})
    clicks = clicks.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    twice = clicks.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    last = clicks.orderBy(F.desc("ts_ms")).limit(1).withColumns(
        {"ts_ms": F.col("ts_ms") + 86_400_000 * 40, "customer_id": F.lit("nobody"), "event_id": F.lit("last")}
    )
    lot = F.least(F.lit(3), F.floor((F.dayofmonth(F.timestamp_millis("ts_ms")) - 1) / 8))
    lots = stored(twice.withColumn("lot", lot).unionByName(last.withColumn("lot", F.lit(4).cast("long"))), f"{out}/lots")
    for n in range(5):
        lots.filter(F.col("lot") == n).drop("lot").write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(lots.drop("lot").schema).parquet(f"{out}/in")
        chain.run_metering(stream, _budget_seeds(spark, folder, 200_000), TIERED, f"{out}/job", ["arrival_seq"])
    return spark.read.parquet(f"{out}/job/ledger").drop("batch_id")


@query
def stream_tiered_windows(spark, folder):
    """One stream: dedup, month volume, tiered price, windows that the watermark has closed."""
    out = _folder(spark, "tiered")
    clicks = _click_stream(spark, folder)
    twice = clicks.withColumn("event_id", F.explode(F.array("event_id", "event_id")))
    named = cleaning.normalize_models(windows.with_event_time(twice), TIERED)
    kept = windows.dedup_within_stream(named)
    scaled = kept.withColumns({c: F.col(c) * 20_000 for c in TOKEN_COLUMNS})
    priced = pricing.price_events(state.stamp_volume_stream(scaled), TIERED, "volume_before")
    _finish(sinks.write_windows(windows.usage_windows_stream(priced), f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table").select(*CUSTOMER_MODEL, "window_start_ms", "event_count", "total_tokens", "cost_micro")


@query
def stream_volume_batches(spark, folder):
    """The same stamps for streams with hot keys, per micro-batch."""
    out = _folder(spark, "volume_batches")
    named = cleaning.normalize_models(_click_stream(spark, folder), STANDARD)
    _finish(state.stamp_volume_batches(named, ["arrival_seq"], f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table/events").select("event_id", "customer_id", "model_id", "month", "volume_before")


@query
def stream_rollup(spark, folder):
    out = _folder(spark, "rollup")
    _finish(
        sinks.rollup_stream(_priced_stream(spark, folder), f"{out}/table", f"{out}/checkpoint", {"availableNow": True})
    )
    return sinks.read_rollup(spark, f"{out}/table")


@query
def stream_landed_events(spark, folder):
    out = _folder(spark, "landed")
    _finish(source.land_events(_click_stream(spark, folder), f"{out}/table", f"{out}/checkpoint"))
    return source.read_events(spark, f"{out}/table").select("event_id", "customer_id", "ts_ms", F.col("day").cast("string").alias("day"))


@query
def stream_dedup(spark, folder):
    out = _folder(spark, "dedup")
    doubled = _click_stream(spark, folder).withColumn("event_id", F.explode(F.array("event_id", "event_id")))
    kept = windows.dedup_within_stream(windows.with_event_time(doubled, "10 minutes"))
    _finish(sinks.write_windows(kept, f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table").select("event_id", "ts_ms")


@query
def stream_budget(spark, folder):
    """Closed windows, from their table as a stream, charge each customer's budget."""
    out = _folder(spark, "budget")
    closed = windows.usage_windows_stream(windows.dedup_window_stream(_priced_stream(spark, folder)))
    _finish(sinks.write_windows(closed, f"{out}/windows", f"{out}/windows_checkpoint"))
    log = spark.readStream.schema(closed.schema).parquet(f"{out}/windows/batch_id=*")
    charges = budget.cost_movements(log)
    seeds = _budget_seeds(spark, folder, 10)
    stream = state.budget_stream(charges.unionByName(seeds))
    _finish(sinks.write_windows(stream, f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table").drop("batch_id")


@query
def late_events(spark, folder):
    """Late events of the arrival-ordered replay, in batch."""
    ordered = _clicks(spark, folder).withColumn("arrival_seq", F.col("arrival_ms") * 1_000_000 + F.col("arrival_seq"))
    return late.split_late(ordered)[1].select("event_id", "customer_id", "ts_ms", "arrival_ms")


@query
def stream_late_events(spark, folder):
    """The same split on a stream, through a sink of its own."""
    out = _folder(spark, "late")
    stream = _click_stream(spark, folder).withColumn(
        "arrival_seq", F.col("arrival_ms") * 1_000_000 + F.col("arrival_seq")
    )
    _finish(late.split_late_stream(stream, f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table/late").select("event_id", "customer_id", "ts_ms", "arrival_ms")


@query
def replayed_late_events(spark, folder):
    """Totals after late events were replayed into the on-time table, twice."""
    out = _folder(spark, "replay")
    stream = _click_stream(spark, folder).withColumn(
        "arrival_seq", F.col("arrival_ms") * 1_000_000 + F.col("arrival_seq")
    )
    _finish(late.split_late_stream(stream, f"{out}/table", f"{out}/checkpoint"))
    for _ in range(2):
        late.replay_dlq(spark, f"{out}/table/late", f"{out}/table/on_time")
    return spark.read.parquet(f"{out}/table/on_time").groupBy("customer_id").agg(
        F.count("*").alias("events"), F.sum("input_tokens").alias("input_tokens")
    )
