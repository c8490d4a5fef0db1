"""Deduplication and idempotent application."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import null_safe_join
from ..functions.running import HOT_ROWS, Hot, HotGroups, Running, find_hot, find_hot_of_many, parted, running
from ..schema import CUSTOMER_MODEL, TOKEN_COLUMNS
from ..session import durable

# Of several copies the first in this order is kept; copies that agree in all
# of these columns differ in nothing a total depends on.
SURVIVOR_ORDER = [
    "ts_ms", *TOKEN_COLUMNS, "latency_ms", "parent_span_id", "session_id", "key_id",
]

WINDOW_KEYS = ["tenant_id", "customer_id", "model_id", "window_start_ms"]


def survivor_columns(names: list[str]) -> list[str]:
    """What a dedup must be given so that ``names`` come out as if it had been given all columns.

    The order compares one column after the other, so those after the last that is asked for decide nothing.
    """
    if not set(names) <= {"event_id", *CUSTOMER_MODEL, *SURVIVOR_ORDER}:
        return ["event_id", *CUSTOMER_MODEL, *SURVIVOR_ORDER, *[n for n in names if n not in ("event_id", *CUSTOMER_MODEL, *SURVIVOR_ORDER)]]
    last = max([SURVIVOR_ORDER.index(n) for n in names if n in SURVIVOR_ORDER] + [0])
    return ["event_id", *CUSTOMER_MODEL, *SURVIVOR_ORDER[: last + 1]]


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind)
    return _sortable(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType)


def _first_copy(df: DataFrame, payload: list[str], order: list[str]) -> tuple[Column, list[Column]]:
    """(aggregate that picks the first copy, its columns): one struct that both sorts and travels.

    Maps have no order; they travel as their sorted entries.
    """
    named = [*order, *[c for c in payload if c not in order]]
    kinds = {c: df.schema[c].dataType for c in named}
    maps = [c for c in named if isinstance(kinds[c], T.MapType)]
    if not all(_sortable(kinds[c].keyType) and _sortable(kinds[c].valueType) if c in maps else _sortable(kinds[c]) for c in named):
        return F.min_by(F.struct(*payload), F.struct(*order)), [F.col(f"_first.{c}") for c in payload]
    first = F.min(F.struct(*[F.sort_array(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in named]))
    return first, [F.map_from_entries(f"_first.{c}").alias(c) if c in maps else F.col(f"_first.{c}") for c in payload]


def window_start(width_ms: int):
    return F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(width_ms))


def dedup_in_window(df: DataFrame, width_ms: int = 10_000, tasks: int | None = None) -> DataFrame:
    """Keep one event per id, customer, model and tumbling window.

    Adds ``window_start_ms`` and ``copies``, the number of events the kept row
    stands for. Events without an id always count. Copies are merged before
    the shuffle, so an id repeated a billion times sends one row per task. All
    columns of ``df`` travel with the event: drop what is not needed first.
    ``tasks`` bounds the tasks that the events with an id come in, and those that the others do.
    """
    windowed = df.withColumn("window_start_ms", window_start(width_ms))
    # Number and id first: the sort before the merge then mostly compares those.
    keys = ["window_start_ms", "event_id", *CUSTOMER_MODEL]
    payload = [c for c in windowed.columns if c not in keys]
    order = [c for c in SURVIVOR_ORDER if c in windowed.columns]
    first, columns = _first_copy(windowed, payload, order)
    kept = (
        windowed.filter(F.col("event_id").isNotNull())
        .groupBy(*keys)
        .agg(first.alias("_first"), F.count("*").alias("copies"))
        .select(*keys, *columns, "copies")
    )
    kept = kept if tasks is None else kept.coalesce(tasks)
    if not windowed.schema["event_id"].nullable:
        return kept
    without_id = windowed.filter(F.col("event_id").isNull()).withColumn("copies", F.lit(1).cast("bigint"))
    without_id = without_id if tasks is None else without_id.coalesce(tasks)
    return kept.unionByName(without_id)


def dedup_within(
    df: DataFrame, ttl_ms: int, clock: str = "ts_ms", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Keep an event when its id was not kept in the ``ttl_ms`` before it.

    The time to live runs from the first kept hit. An id's events move once, to one task, which
    also merges equal times; equal times of hot ids are merged before the shuffle. Events without an id always stay.
    """
    named = df.filter(F.col("event_id").isNotNull())
    order = [c for c in dict.fromkeys([clock, *SURVIVOR_ORDER]) if c in df.columns]
    payload = [c for c in df.columns if c not in ("event_id", clock)]
    first, columns = _first_copy(df, payload, order)

    def merged(rows):
        return rows.groupBy("event_id", clock).agg(first.alias("_first"))

    # Merged rows are no more than the events, so ids are counted on those.
    hot = find_hot_of_many(named, ["event_id"], hot_rows)
    if hot.frame is None:
        kept = _kept_in_groups(merged(named.repartition("event_id")), ["event_id"], clock, ttl_ms)
    else:
        few, many = parted(named, hot)
        kept = _kept_in_groups(merged(few.repartition("event_id")), ["event_id"], clock, ttl_ms).unionByName(
            _kept_in_slices(merged(many), ["event_id"], clock, ttl_ms, hot)
        )
    kept = kept.select("event_id", clock, *columns).select(*df.columns)
    if not df.schema["event_id"].nullable:
        return kept
    return kept.unionByName(df.filter(F.col("event_id").isNull()))


def keep_every(
    df: DataFrame, keys: list[str], clock: str, ttl_ms: int, hot: Hot = HOT_ROWS
) -> DataFrame:
    """From each group keep the first row, then each first row ``ttl_ms`` after the last kept.

    ``clock`` is unique in a group. A row ``ttl_ms`` or more after its
    predecessor is always kept, so such rows cut a group into independent
    runs. Only runs that last ``ttl_ms`` or longer have more to decide: in small groups
    by a walk in time order, which holds one time per run, in hot ones by
    pointer doubling.
    """
    hot = hot if isinstance(hot, HotGroups) else find_hot(df, keys, hot)
    if hot.frame is None:
        return _kept_in_groups(df, keys, clock, ttl_ms)
    few, many = parted(df, hot)
    return _kept_in_groups(few, keys, clock, ttl_ms).unionByName(_kept_in_slices(many, keys, clock, ttl_ms, hot))


def _runs(df: DataFrame, keys: list[str], clock: str, ttl_ms: int, hot: HotGroups) -> DataFrame:
    """Rows with the start of their run, and whether they are that start (``_opens``)."""
    runs = running(
        df, keys, [clock], {"_before": Running("last", clock, inclusive=False)}, hot
    ).withColumn(
        "_opens",
        F.when(F.col("_before").isNull() | (F.col(clock) - F.col("_before") >= ttl_ms), F.col(clock)),
    )
    return running(runs, keys, [clock], {"_run": Running("last", "_opens")}, hot)


def _to_decide(runs: DataFrame, clock: str, ttl_ms: int) -> DataFrame:
    """Rows that open a run are kept; rows inside the first ttl of a run are not.

    What is left is decided with nothing else of its run: the run's start is known.
    """
    return runs.filter(F.col("_opens").isNull() & (F.col(clock) - F.col("_run") >= ttl_ms))


def _kept_in_groups(df: DataFrame, keys: list[str], clock: str, ttl_ms: int) -> DataFrame:
    """Kept rows of groups that each fit one task: the walk goes on where the rows lie, in the order they have."""
    runs = _runs(df, keys, clock, ttl_ms, HotGroups(keys, 0, HOT_ROWS, None))
    late = _to_decide(runs, clock, ttl_ms).sortWithinPartitions(*keys, clock)
    picked = late.mapInArrow(_walk(keys, clock, ttl_ms), late.schema)
    return runs.filter("_opens IS NOT NULL").unionByName(picked).drop("_before", "_opens", "_run")


def _kept_in_slices(df: DataFrame, keys: list[str], clock: str, ttl_ms: int, hot: HotGroups) -> DataFrame:
    """Kept rows of groups that no task holds whole."""
    runs = _runs(df, keys, clock, ttl_ms, hot)
    times = _to_decide(runs, clock, ttl_ms).select(*keys, "_run", clock)
    picked = _leapt(times, keys, clock, ttl_ms, hot).select(*keys, clock, F.lit(True).alias("_picked"))
    open_or_late = F.col("_opens").isNotNull() | (F.col(clock) - F.col("_run") >= ttl_ms)
    kept = null_safe_join(runs.filter(open_or_late), picked, [*keys, clock], "left")
    return kept.filter(F.col("_opens").isNotNull() | F.col("_picked")).drop("_before", "_opens", "_run", "_picked")


def _leapt(times: DataFrame, keys: list[str], clock: str, ttl_ms: int, hot: HotGroups) -> DataFrame:
    """Kept rows of runs of any length, by pointer doubling: no task holds a run.

    Every row points to the first row ``ttl_ms`` or more after it, found in one running pass over
    rows and looked-up times together. The kept rows are those on the way from the run's
    start. Each round adds to the rows reached what they point to, and makes all pointers
    twice as long by joining them with themselves, so n rows on the way take log2(n) rounds.
    """
    group = [*keys, "_run"]
    times = durable(times)
    starts = times.select(*group).distinct().withColumn("_at", F.col("_run"))
    asked = times.select(*group, F.col(clock).alias("_at")).unionByName(starts)
    both = times.select(*group, F.col(clock).alias("_row"), F.lit(None).cast("long").alias("_at"), (-F.col(clock)).alias("_order"), F.lit(0).alias("_asks"))
    both = both.unionByName(
        asked.select(*group, F.lit(None).cast("long").alias("_row"), "_at", (-F.col("_at") - ttl_ms).alias("_order"), F.lit(1).alias("_asks"))
    )
    # Rows come in falling order of time, before what is asked for at the same time: the last row seen is the next one.
    seen = running(both, group, ["_order", "_asks"], {"_to": Running("last", "_row")}, HotGroups(hot.keys, 2 * hot.total_rows, hot.hot_rows, hot.frame))
    pointers = durable(seen.filter("_asks = 1 AND _to IS NOT NULL").select(*group, "_at", "_to"))
    reached = durable(starts)
    while True:
        step = null_safe_join(reached, pointers, [*group, "_at"], "inner").select(*group, F.col("_to").alias("_at"))
        step = durable(step)
        if step.isEmpty():
            break
        reached = durable(reached.unionByName(step))
        onward = pointers.select(*group, F.col("_at").alias("_via"), F.col("_to").alias("_end"))
        longer = null_safe_join(pointers.withColumnRenamed("_to", "_via"), onward, [*group, "_via"], "inner")
        pointers = durable(longer.select(*group, "_at", F.col("_end").alias("_to")))
    return reached.filter(F.col("_at") != F.col("_run")).withColumnRenamed("_at", clock).select(*times.columns)


def group_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First row of each group of consecutive rows that agree in ``keys``; null agrees with null."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for key in keys:
        codes = pc.dictionary_encode(batch.column(key), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _walk(keys: list[str], clock: str, ttl_ms: int):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last = None, None
        for batch in batches:
            starts = group_starts(batch, [*keys, "_run"])
            ends = np.append(starts[1:], batch.num_rows)
            times = batch.column(clock).to_numpy()
            chosen = []
            for start, end in zip(starts.tolist(), ends.tolist()):
                this = tuple(batch.column(c)[start].as_py() for c in [*keys, "_run"])
                if this != run:
                    run, last = this, this[-1]
                at = start + np.searchsorted(times[start:end], last + ttl_ms)
                while at < end:
                    chosen.append(at)
                    last = times[at]
                    at += np.searchsorted(times[at:end], last + ttl_ms)
            yield batch.take(pa.array(chosen, pa.int64()))

    return pick


def apply_once(new: DataFrame, applied: DataFrame, keys: list[str] = WINDOW_KEYS) -> DataFrame:
    """Windows of ``new`` whose key is not in ``applied``."""
    return null_safe_join(new, applied.select(*keys), keys, "left_anti")


def upsert_spans(
    new: DataFrame, old: DataFrame, version: str, keys: list[str] | None = None
) -> DataFrame:
    """Latest version of each span; each firing carries the whole aggregate."""
    keys = keys or ["tenant_id", "parent_span_id"]
    both = new.unionByName(old)
    rest = [c for c in both.columns if c not in keys]
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), version).alias("_last"))
        .select(*keys, "_last.*")
    )


def retain(df: DataFrame, last_ts: str, now_ms: int, ttl_ms: int) -> DataFrame:
    """Rows whose last event is within the retention time."""
    return df.filter(F.col(last_ts) >= F.lit(now_ms - ttl_ms))


# Retention of derived tables, in milliseconds.
RETENTION_MS = {
    "dedup": 600_000,
    "minute": 86_400_000,
    "span": 86_400_000,
    "session": 90 * 86_400_000,
    "day": 400 * 86_400_000,
    "month": 400 * 86_400_000,
    "dim": 400 * 86_400_000,
}
