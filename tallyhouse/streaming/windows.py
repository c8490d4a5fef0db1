"""Streaming twins of the window and span aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import window_start
from ..operators.usage import event_measures, span_sessions, with_average_latency
from ..schema import CUSTOMER_MODEL

DELAY = "5 seconds"
DELAY_MS = 5_000


def with_event_time(df: DataFrame, delay: str = DELAY) -> DataFrame:
    """Event-time column ``ts`` with a watermark ``delay`` behind the newest event."""
    return df.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


def dedup_window_stream(df: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Keep one event per id, customer, model and window; state ends with the window.

    The event-time column becomes the ``window`` column.
    """
    windowed = df.withColumn("window", F.window("ts", width)).drop("ts")
    kept = windowed.filter(F.col("event_id").isNotNull()).dropDuplicates(
        [*CUSTOMER_MODEL, "window", "event_id"]
    )
    return kept.unionByName(windowed.filter(F.col("event_id").isNull()))


def dedup_within_stream(df: DataFrame) -> DataFrame:
    """Drop ids seen within the watermark delay; events without an id pass."""
    kept = df.filter(F.col("event_id").isNotNull()).dropDuplicatesWithinWatermark(["event_id"])
    return kept.unionByName(df.filter(F.col("event_id").isNull()))


def usage_windows_stream(df: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Closed tumbling windows of a priced stream; events behind them are not let in."""
    measures = event_measures()
    window = F.col("window") if "window" in df.columns else F.window("ts", width)
    closed = df.groupBy(window.alias("_window"), *CUSTOMER_MODEL).agg(
        *[column.alias(name) for name, column in measures.items()]
    )
    return with_average_latency(
        closed.select(
            *CUSTOMER_MODEL,
            F.unix_millis("_window.start").alias("window_start_ms"),
            F.unix_millis("_window.end").alias("window_end_ms"),
            *measures,
        )
    )


def span_sessions_stream(df: DataFrame, gap: str = "60 seconds", cost: str = "cost_micro") -> DataFrame:
    return span_sessions(df, gap, cost)


def window_end(width_ms: int = 10_000):
    return window_start(width_ms) + width_ms
