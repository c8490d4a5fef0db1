"""Usage totals: windows, counters, rollups, sessions, spans and dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.periods import billing_day, billing_month
from ..schema import CUSTOMER, CUSTOMER_MODEL, DIMENSIONS, TOKEN_COLUMNS
from .cleaning import total_tokens
from .dedup import WINDOW_KEYS, window_start

ROLLUP_MEASURES = [
    "input_tokens", "output_tokens", "total_tokens", "event_count", "cost_micro",
    "cache_read_tokens", "reasoning_tokens",
]

WINDOW_MEASURES = [
    *TOKEN_COLUMNS, "total_tokens", "cost_micro", "event_count", "total_latency_ms", "duplicate_count",
]


def _sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def event_measures() -> dict[str, Column]:
    """Sums over priced events, by output name."""
    return {
        **{c: F.sum(c) for c in TOKEN_COLUMNS},
        "total_tokens": F.sum(total_tokens()),
        "cost_micro": F.sum("cost_micro"),
        "event_count": F.count("*"),
        "total_latency_ms": F.sum(F.greatest(F.coalesce("latency_ms", F.lit(0)), F.lit(0))),
    }


def _measures(names: list[str]) -> list[Column]:
    known = event_measures()
    return [known[n].alias(n) for n in names]


def usage_windows(df: DataFrame, width_ms: int = 10_000) -> DataFrame:
    """Tumbling windows per tenant, customer and model.

    ``df`` is priced and deduplicated; its ``copies`` column, when present,
    gives the duplicate count.
    """
    copies = F.col("copies") if "copies" in df.columns else F.lit(1)
    return with_average_latency(
        df.withColumn("window_start_ms", window_start(width_ms))
        .groupBy(*WINDOW_KEYS)
        .agg(*_measures(WINDOW_MEASURES[:-1]), F.sum(copies - 1).alias("duplicate_count"))
        .withColumn("window_end_ms", F.col("window_start_ms") + width_ms)
    )


def with_average_latency(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_latency_ms", F.col("total_latency_ms") / F.col("event_count"))


def merge_windows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge partial window results; all measures are sums."""
    keys = [*WINDOW_KEYS, "window_end_ms"]
    both = a.select(*keys, *WINDOW_MEASURES).unionByName(b.select(*keys, *WINDOW_MEASURES))
    return with_average_latency(both.groupBy(*keys).agg(*_sums(*WINDOW_MEASURES)))


def usage_global(windows: DataFrame) -> DataFrame:
    """Running totals of each tenant over all windows."""
    return windows.groupBy("tenant_id").agg(
        *_sums("total_tokens", "input_tokens", "output_tokens", "event_count", "cost_micro"),
        F.max("window_end_ms").alias("last_window_end_ms"),
    )


def usage_by_customer(df: DataFrame) -> DataFrame:
    """Lifetime totals per customer."""
    return df.groupBy(*CUSTOMER).agg(*_measures(ROLLUP_MEASURES))


def usage_by_customer_model(df: DataFrame) -> DataFrame:
    return df.groupBy(*CUSTOMER_MODEL).agg(*_measures(ROLLUP_MEASURES))


def usage_by_customer_model_month(df: DataFrame) -> DataFrame:
    return df.groupBy(*CUSTOMER_MODEL, billing_month(F.col("ts_ms")).alias("period")).agg(
        *_measures(["cost_micro", "event_count", "total_tokens", "input_tokens", "output_tokens"])
    )


GRAIN_FORMAT = {"minute": "yyyy-MM-dd HH:mm", "day": "yyyy-MM-dd", "month": "yyyy-MM"}


def usage_rollup(
    df: DataFrame, grains: tuple[str, ...] = ("minute", "day", "month"), bucket_by: str = "event_time"
) -> DataFrame:
    """Customer totals per minute, day and month bucket, as rows of one table.

    ``bucket_by="window_end"`` places an event in the bucket that holds the
    end of its ten-second window. Events are summed to minutes once, which no later
    step moves; days are sums of minutes, months of days.
    """
    ts = F.col("ts_ms") if bucket_by == "event_time" else window_start(10_000) + 10_000
    at_minute = ts - F.pmod(ts, F.lit(60_000))
    minutes = (
        df.withColumn("_minute", at_minute)
        .groupBy(*CUSTOMER, "_minute")
        .agg(*_measures(ROLLUP_MEASURES))
    )
    time = F.timestamp_millis("_minute")

    def named(rows: DataFrame, grain: str, time: Column) -> DataFrame:
        bucket = F.date_format(time, GRAIN_FORMAT[grain])
        return rows.select(*CUSTOMER, F.lit(grain).alias("grain"), bucket.alias("bucket"), *ROLLUP_MEASURES)

    days = minutes.groupBy(*CUSTOMER, time.cast("date").alias("_day")).agg(*_sums(*ROLLUP_MEASURES))
    months = days.groupBy(*CUSTOMER, F.trunc("_day", "month").alias("_month")).agg(*_sums(*ROLLUP_MEASURES))
    parts = {
        "minute": named(minutes, "minute", time), "day": named(days, "day", F.col("_day")),
        "month": named(months, "month", F.col("_month")),
    }
    return reduce(DataFrame.unionByName, [parts[g] for g in dict.fromkeys(grains)])


def usage_by_session(df: DataFrame) -> DataFrame:
    """Totals per tenant and session; the session belongs to its latest customer."""
    return (
        df.filter("session_id IS NOT NULL")
        .groupBy("tenant_id", "session_id")
        .agg(
            F.max_by("customer_id", F.struct("ts_ms", "customer_id")).alias("customer_id"),
            *_measures(ROLLUP_MEASURES),
            F.max("ts_ms").alias("last_ts_ms"),
        )
    )


def usage_by_span(df: DataFrame, cost: str = "cost_micro") -> DataFrame:
    """Totals per agent run: tokens, cost, calls, first and last event."""
    return (
        df.filter("parent_span_id IS NOT NULL")
        .groupBy("tenant_id", "parent_span_id")
        .agg(
            F.max_by("customer_id", F.struct("ts_ms", "customer_id")).alias("customer_id"),
            F.sum(total_tokens()).alias("total_tokens"),
            F.sum(cost).alias("cost_micro"),
            F.count("*").alias("call_count"),
            F.min("ts_ms").alias("first_ts_ms"),
            F.max("ts_ms").alias("last_ts_ms"),
        )
        .withColumn("duration_ms", F.col("last_ts_ms") - F.col("first_ts_ms"))
    )


def span_sessions(df: DataFrame, gap: str = "60 seconds", cost: str = "cost_micro") -> DataFrame:
    """Runs of one tenant's span with no pause of ``gap``; batch or stream.

    The customer is that of the last event.
    """
    last = F.struct("ts_ms", "customer_id")
    return (
        df.filter("parent_span_id IS NOT NULL")
        .groupBy("parent_span_id", "tenant_id", F.session_window("ts", gap).alias("_session"))
        .agg(
            F.max_by("customer_id", last).alias("customer_id"),
            F.sum(total_tokens()).alias("total_tokens"),
            *_sums("input_tokens", "output_tokens", "reasoning_tokens"),
            F.sum(cost).alias("cost_micro"),
            F.count("*").alias("call_count"),
            F.min("ts_ms").alias("first_ts_ms"),
            F.max("ts_ms").alias("last_ts_ms"),
        )
        .drop("_session")
        .withColumn("duration_ms", F.col("last_ts_ms") - F.col("first_ts_ms"))
    )


def usage_by_dim(df: DataFrame, dims: list[str] = DIMENSIONS) -> DataFrame:
    """Cost and events of each tenant per metadata dimension, lifetime (``period`` null) and monthly."""
    pairs = F.array(*[F.struct(F.lit(d).alias("k"), F.col("metadata")[d].alias("v")) for d in dims])
    monthly = (
        df.filter(F.col("cost_micro") > 0)
        .select(
            "tenant_id", F.explode(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("_d"),
            billing_month(F.col("ts_ms")).alias("period"), "cost_micro",
        )
        .groupBy("tenant_id", F.col("_d.k").alias("dim_key"), F.col("_d.v").alias("dim_value"), "period")
        .agg(F.sum("cost_micro").alias("cost_micro"), F.count("*").alias("event_count"))
    )
    return (
        monthly.select(
            "tenant_id", "dim_key", "dim_value",
            F.explode(F.array(F.col("period"), F.lit(None))).alias("period"),
            "cost_micro", "event_count",
        )
        .groupBy("tenant_id", "dim_key", "dim_value", "period")
        .agg(*_sums("cost_micro", "event_count"))
    )


def usage_per_minute(df: DataFrame) -> DataFrame:
    """Per-minute usage with the baseline price rule."""
    minute = F.timestamp_millis(F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(60_000)))
    return df.groupBy(minute.alias("window_start"), "customer_id", "provider", "model_id").agg(
        *_sums("input_tokens", "output_tokens", "cache_read_tokens", "reasoning_tokens"),
        F.sum(total_tokens()).alias("total_tokens"),
        F.count("*").alias("event_count"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.sum("cost_nano").alias("cost_nano"),
    )


def minute_totals(minutes: DataFrame) -> DataFrame:
    return minutes.agg(
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("event_count").alias("total_events"),
        (F.sum(F.col("cost_nano").cast("decimal(28,0)")).cast("double") / 1e9).alias("total_cost_usd"),
    )


def freshness(windows: DataFrame, now_ms: int, stall_s: int, end: str = "window_end_ms") -> DataFrame:
    """Age of the newest window, and whether the feed has stalled."""
    newest = windows.agg(F.max(end).alias("newest_ms"))
    lag = F.floor((F.lit(now_ms) - F.col("newest_ms")) / 1000).cast("bigint")
    return newest.withColumn("lag_seconds", lag).withColumn("stalled", F.col("lag_seconds") > stall_s)


def period_costs(rollup: DataFrame, by: list[str], periods: list[str] | None = None) -> DataFrame:
    """Monthly cost by any of the table's keys; no keys gives global totals.

    ``rollup`` has ``period`` and ``cost_micro`` columns.
    """
    chosen = rollup if periods is None else rollup.filter(F.col("period").isin(*periods))
    return chosen.groupBy("period", *by).agg(F.sum("cost_micro").alias("cost_micro"))


def daily_costs(rollup: DataFrame, by: list[str] | None = None, period: str | None = None) -> DataFrame:
    """Daily cost from the day grain of the rollup, globally or by key."""
    days = rollup.filter(F.col("grain") == "day")
    if period is not None:
        days = days.filter(F.col("bucket").startswith(period))
    return days.groupBy(F.col("bucket").alias("day"), *(by or [])).agg(
        F.sum("cost_micro").alias("cost_micro")
    )


def dim_margin_series(dims: DataFrame, dim_key: str, periods: list[str]) -> DataFrame:
    """Cost of each value of one dimension over several months, tenants together."""
    return dims.filter(
        (F.col("dim_key") == dim_key) & F.col("period").isin(*periods) & (F.col("cost_micro") > 0)
    ).groupBy("period", "dim_value").agg(F.sum("cost_micro").alias("cost_micro"))


# Limits of the four plans; -1 means unlimited.
PLAN_LIMITS = [
    ("free", 100_000, 100, 10),
    ("growth", 10_000_000, 10_000, 1_000),
    ("scale", 100_000_000, 100_000, 10_000),
    ("enterprise", -1, -1, -1),
]


def plan_limits(spark) -> DataFrame:
    return spark.createDataFrame(
        PLAN_LIMITS, "plan string, max_events_per_month bigint, max_eps bigint, max_customers bigint"
    )


def tenant_plan_usage(df: DataFrame, tenants: DataFrame, limits: DataFrame, period: str) -> DataFrame:
    """Each tenant's totals and this month's events against its plan.

    ``tenants``: ``tenant_id, plan``. ``limits`` is the four-row plan table.
    Customers are counted from per-customer subtotals.
    """
    by_customer = df.filter("tenant_id IS NOT NULL").groupBy(*CUSTOMER).agg(
        F.count("*").alias("_events"),
        F.sum(total_tokens()).alias("_tokens"),
        F.sum("cost_micro").alias("_cost"),
        F.count(F.when(billing_month(F.col("ts_ms")) == period, 1)).alias("_month"),
    )
    totals = by_customer.groupBy("tenant_id").agg(
        F.sum("_events").alias("total_events"),
        F.sum("_tokens").alias("total_tokens"),
        F.sum("_cost").alias("total_cost_micro"),
        F.sum("_month").alias("events_this_month"),
        F.count("*").alias("customers"),
    )
    measures = ["total_events", "total_tokens", "total_cost_micro", "events_this_month", "customers"]

    def over(used, limit):
        return (F.col(limit) >= 0) & (F.col(used) > F.col(limit))

    return (
        tenants.join(totals, "tenant_id", "left")
        .fillna(0, measures)
        .join(F.broadcast(limits), "plan")
        .select(
            "tenant_id", "plan", *measures, "max_events_per_month", "max_customers",
            over("events_this_month", "max_events_per_month").alias("over_events"),
            over("customers", "max_customers").alias("over_customers"),
        )
    )


def spend_by_key(df: DataFrame) -> DataFrame:
    """API-key spend per day and month; free events are not spend."""
    daily = (
        df.filter("key_id IS NOT NULL AND cost_micro > 0")
        .groupBy("key_id", billing_day(F.col("ts_ms")).alias("_day"))
        .agg(F.sum("cost_micro").alias("cost_micro"))
    )
    buckets = F.array(
        F.struct(F.lit("day").alias("grain"), F.col("_day").alias("bucket")),
        F.struct(F.lit("month").alias("grain"), F.substring("_day", 1, 7).alias("bucket")),
    )
    return (
        daily.select("key_id", F.explode(buckets).alias("_b"), "cost_micro")
        .groupBy("key_id", F.col("_b.grain").alias("grain"), F.col("_b.bucket").alias("bucket"))
        .agg(F.sum("cost_micro").alias("cost_micro"))
    )


def top_spans(spans: DataFrame, n: int) -> DataFrame:
    """The ``n`` dearest spans of each customer; the cut is made before the shuffle too."""
    order = Window.partitionBy(*CUSTOMER).orderBy(F.desc("cost_micro"), "parent_span_id")
    return spans.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_customers(totals: DataFrame, by: str, n: int = 10) -> DataFrame:
    return totals.orderBy(F.desc(by), *CUSTOMER).limit(n)


def live_series(df: DataFrame, grain_ms: int = 60_000) -> DataFrame:
    """Events and cost per bucket, with running totals over all time.

    Running totals are taken inside each month and shifted by the months
    before it, so no task holds more than a month of buckets.
    """
    bucket = F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(grain_ms))
    buckets = df.groupBy(bucket.alias("bucket_ms")).agg(
        F.count("*").alias("event_count"), F.sum("cost_micro").alias("cost_micro")
    ).withColumn("_month", billing_month(F.col("bucket_ms")))
    months = buckets.groupBy("_month").agg(*_sums("event_count", "cost_micro"))
    before = Window.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    # One row per calendar month of data.
    offsets = months.select(
        "_month",
        F.coalesce(F.sum("event_count").over(before), F.lit(0)).alias("_events"),
        F.coalesce(F.sum("cost_micro").over(before), F.lit(0)).alias("_cost"),
    )
    inside = Window.partitionBy("_month").orderBy("bucket_ms").rowsBetween(Window.unboundedPreceding, 0)
    return (
        buckets.withColumn("_e", F.sum("event_count").over(inside))
        .withColumn("_c", F.sum("cost_micro").over(inside))
        .join(F.broadcast(offsets), "_month")
        .select(
            "bucket_ms", "event_count", "cost_micro",
            (F.col("_e") + F.col("_events")).alias("running_events"),
            (F.col("_c") + F.col("_cost")).alias("running_cost_micro"),
        )
    )
