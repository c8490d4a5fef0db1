"""Counters on streams whose state ends: each is dropped once the watermark is its retention time past it.

Ids, minutes and days expire by Spark's own rule: their watermark is delayed by the retention time, and
state behind the watermark goes. Spans have no window; a timer in event time drops them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.cleaning import total_tokens
from ..operators.dedup import RETENTION_MS
from ..schema import CUSTOMER
from .state import bucket, known_values
from .windows import dedup_within_stream, with_event_time

GRAINS = {"minute": "1 minute", "day": "1 day"}


def _delay(kind: str, retain_ms: int | None) -> str:
    return f"{RETENTION_MS[kind] if retain_ms is None else retain_ms} milliseconds"


def kept_ids_stream(df: DataFrame, retain_ms: int | None = None) -> DataFrame:
    """Drop ids that came within the retention time; older ids are forgotten."""
    return dedup_within_stream(with_event_time(df, _delay("dedup", retain_ms)))


def counters_stream(priced: DataFrame, grain: str, retain_ms: int | None = None) -> DataFrame:
    """Totals per customer and minute or day as they change, to be written in ``update`` mode.

    Each micro-batch brings the whole totals of what it touched (``latest`` picks the last). A
    minute stays open for late events for its retention time; then its state goes and events for it
    are not let in. Sums have a partial step, so a hot customer reaches its task as one row per minute and task.
    """
    timed = with_event_time(priced, _delay(grain, retain_ms))
    window = F.window("ts", GRAINS[grain])
    return timed.groupBy(window.alias("_window"), *CUSTOMER).agg(
        F.count("*").alias("event_count"), F.sum(total_tokens()).alias("total_tokens"), F.sum("cost_micro").alias("cost_micro")
    ).select(*CUSTOMER, F.unix_millis("_window.start").alias("start_ms"), "event_count", "total_tokens", "cost_micro")


_STATE = T.StructType(
    [T.StructField("customer_id", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("total_tokens", "cost_micro", "call_count", "first_ts_ms", "last_ts_ms")]
)
SPAN_TOTALS = T.StructType([T.StructField("tenant_id", T.StringType()), T.StructField("parent_span_id", T.StringType()), *_STATE.fields])
SPAN_KEYS = ["tenant_id", "parent_span_id"]


class SpanTotals(StatefulProcessor):
    """Totals of the spans of one bucket, added up frame by frame; they go a retention time after a span's last event.

    A bucket has one timer, at the time when the first of its spans ends or before it.
    """

    def __init__(self, retain_ms: int):
        self._retain = retain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._totals = handle.getMapState("totals", T.StructType(SPAN_TOTALS.fields[:2]), _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        empty, totals = not self._totals.exists(), {}
        for frame in rows:
            number = frame.groupby(SPAN_KEYS, dropna=False, sort=False).ngroup()
            spans = known_values(frame.loc[~number.duplicated(), SPAN_KEYS])
            sums = frame.groupby(number).agg(
                first=("ts_ms", "min"), last=("ts_ms", "max"), tokens=("event_tokens", "sum"), cost=("cost_micro", "sum"), calls=("ts_ms", "size")
            )
            # Of events at one time the greatest customer counts, as in the batch table.
            newest = (frame["ts_ms"] == number.map(sums["last"])) & frame["customer_id"].notna()
            tops = frame.loc[newest, "customer_id"].groupby(number[newest]).max().to_dict()
            for n, first, newest, tokens, cost, calls in sums.itertuples(name=None):
                span, top = spans[n], tops.get(n)
                if span not in totals:
                    totals[span] = (None if empty else self._totals.getValue(span)) or (None, 0, 0, 0, first, None)
                customer, had_tokens, had_cost, had_calls, had_first, last = totals[span]
                if last is None or (newest, top or "") > (last, customer or ""):
                    customer = top
                totals[span] = (
                    customer, had_tokens + int(tokens), had_cost + int(cost), had_calls + int(calls),
                    min(had_first, int(first)), int(newest) if last is None else max(int(newest), last),
                )
        for span, state in totals.items():
            self._totals.updateValue(span, state)
        self._wake(min(state[-1] for state in totals.values()))
        yield pd.DataFrame([(*span, *state) for span, state in totals.items()], columns=SPAN_TOTALS.names)

    def _wake(self, last: int) -> None:
        """See to it that the timer comes no later than the end of a span with this last event."""
        set_at = list(self._handle.listTimers())
        if not set_at or last + self._retain < min(set_at):
            for t in set_at:
                self._handle.deleteTimer(t)
            self._handle.registerTimer(last + self._retain)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = None
        for span, state in list(self._totals.iterator()):
            if state[-1] + self._retain <= timerValues.getCurrentWatermarkInMs():
                self._totals.removeKey(tuple(span))
            else:
                left = state[-1] if left is None else min(left, state[-1])
        if left is not None:
            self._handle.registerTimer(left + self._retain)
        return iter(())

    def close(self) -> None:
        pass


def span_totals_stream(priced: DataFrame, retain_ms: int | None = None, delay: str = "5 seconds") -> DataFrame:
    """Totals per span as they change, to be written in ``update`` mode; each row carries the whole span.

    Spans are dealt to buckets. Their events come frame by frame, each of one Arrow batch, and are added up, so a hot span needs no more
    memory than any other. A span that goes on after its state has gone starts anew.
    """
    timed = with_event_time(priced.filter("parent_span_id IS NOT NULL AND ts_ms IS NOT NULL"), delay)
    rows = timed.select(*SPAN_KEYS, "customer_id", "ts_ms", "ts", "cost_micro", total_tokens().alias("event_tokens"))
    retain = RETENTION_MS["span"] if retain_ms is None else retain_ms
    dealt = rows.withColumn("_bucket", bucket(SPAN_KEYS)).groupBy("_bucket")
    return dealt.transformWithStateInPandas(SpanTotals(retain), SPAN_TOTALS, "update", "eventTime")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of the updates that a sink has stored per ``batch_id``, the last of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_last")).select(*keys, "_last.*")
