"""Stateful stream operators: month volume and budget drawdown."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.periods import billing_month
from ..functions.running import HOT_ROWS, Running, hot_among, running
from ..operators.budget import DEFAULT_THRESHOLD_SHARE
from ..operators.cleaning import total_tokens
from ..schema import CUSTOMER, CUSTOMER_MODEL
from .merged import MergedSums


def _month_end_ms(month: str) -> int:
    return int((pd.Period(month, "M") + 1).start_time.tz_localize("UTC").timestamp() * 1000)


# Keys that share a state and are worked on at once: a call into Python costs some milliseconds whatever it is given.
BUCKETS = 1024


def bucket(keys: list[str]) -> Column:
    """Which bucket the rows of a key go to."""
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))


def known_values(frame: pd.DataFrame) -> list[tuple]:
    """Rows as tuples in which what is missing is None."""
    return list(frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))


class MonthVolume(StatefulProcessor):
    """Tokens per customer, model and month of one bucket of them, in arrival order.

    Every month that was seen is kept, in whatever order months come. With
    ``retain_ms`` a timer drops a month once the watermark is that far past its end.
    """

    def __init__(self, columns: list[str], order: list[str], retain_ms: int | None):
        self._columns = columns
        self._order = order
        self._retain = retain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._months = handle.getMapState(
            "months",
            T.StructType([T.StructField(k, T.StringType()) for k in (*CUSTOMER_MODEL, "month")]),
            T.StructType([T.StructField("tokens", T.LongType())]),
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        keys = [*CUSTOMER_MODEL, "month"]
        frame = pd.concat(list(rows)).sort_values(self._order, kind="stable", ignore_index=True)
        groups = frame.groupby(keys, dropna=False, sort=False)["event_tokens"]
        number = groups.ngroup().to_numpy()
        _, first = np.unique(number, return_index=True)
        before = (groups.cumsum() - frame["event_tokens"]).to_numpy(np.int64)
        known, months = np.zeros(len(first), np.int64), set()
        empty = not self._months.exists()
        for n, (named, tokens) in enumerate(zip(known_values(frame.loc[first, keys]), groups.sum().to_numpy(np.int64))):
            seen = None if empty else self._months.getValue(named)
            if seen is not None:
                known[n] = seen[0]
            elif named[-1] is not None:
                months.add(named[-1])
            self._months.updateValue(named, (int(known[n] + tokens),))
        if self._retain is not None:
            for month in months:
                self._handle.registerTimer(_month_end_ms(month) + self._retain)
        yield frame.assign(volume_before=before + known[number])[self._columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for named in list(self._months.keys()):
            month = named[-1]
            if month is not None and _month_end_ms(month) + self._retain <= expiredTimerInfo.getExpiryTimeInMs():
                self._months.removeKey(tuple(named))
        return iter(())

    def close(self) -> None:
        pass


def stamp_volume_stream(
    df: DataFrame, order: list[str] | None = None, retain_ms: int | None = None
) -> DataFrame:
    """Add ``volume_before`` in arrival order; the stream keeps its event time.

    Keys are dealt to ``BUCKETS`` buckets; the rows that a micro-batch brings to one are held in one frame.
    ``order`` sorts the rows of one key and micro-batch: ``arrival_seq`` if there
    is one, else event time and id. Months stay in state for good unless
    ``retain_ms`` is given; then they go once the watermark is that long past
    their end, so it must cover how late events may come, and the stream needs ``ts``.
    """
    if retain_ms is not None and "ts" not in df.columns:
        raise ValueError("retain_ms needs a stream with event time")
    order = order or (["arrival_seq"] if "arrival_seq" in df.columns else ["ts_ms", "event_id"])
    keyed = df.withColumns({"month": billing_month(F.col("ts_ms")), "event_tokens": total_tokens()})
    kept = [f for f in keyed.schema.fields if f.name != "event_tokens"]
    schema = T.StructType([*kept, T.StructField("volume_before", T.LongType())])
    processor = MonthVolume(schema.names, order, retain_ms)
    dealt = keyed.withColumn("_bucket", bucket(CUSTOMER_MODEL)).groupBy("_bucket")
    if "ts" in df.columns:
        return dealt.transformWithStateInPandas(processor, schema, "append", "eventTime", eventTimeColumnName="ts")
    return dealt.transformWithStateInPandas(processor, schema, "append", "none")


BUDGET_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("ref", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("amount_micro", T.LongType()),
        T.StructField("balance_micro", T.LongType()),
        T.StructField("debt_micro", T.LongType()),
        T.StructField("alert", T.StringType()),
    ]
)


_MOVES = ["ts_ms", "seq", "ref", "kind", "amount_micro", "alert_threshold_micro"]


def book(moves: pd.DataFrame, state: tuple[int, int, float] | None) -> tuple[pd.DataFrame, tuple[int, int, float] | None]:
    """Movements of one customer in order with balance, debt and alert, and the state after them: balance, debt, threshold."""
    who = np.zeros(len(moves), np.int64)
    booked, after = book_all(moves, who, [state])
    return booked, after.get(0, state)


def book_all(
    moves: pd.DataFrame, who: np.ndarray, states: list[tuple[int, int, float] | None]
) -> tuple[pd.DataFrame, dict[int, tuple[int, int, float]]]:
    """Movements of many customers, each one's in order, with balance, debt and alert, and the states after them.

    ``who`` numbers the customers and rises; ``states`` has one entry for each number.
    What a row of movements does to a balance depends on two numbers, their sum and their lowest running sum: where the
    balance would fall below zero it stays at zero, and the rest is debt. So balances come
    from a running sum lifted by its own running minimum, for all movements between two ``set`` at once. Without a
    state, movements before the first ``set`` are left out.
    """
    kind, amount = moves["kind"].to_numpy(object), moves["amount_micro"].to_numpy(np.int64)
    is_set = kind == "set"
    opens = is_set | np.concatenate(([True], who[1:] != who[:-1]))[: len(who)]
    part, first = np.cumsum(opens) - 1, np.flatnonzero(opens)
    # What each part, from a set or a customer's first movement on, starts from.
    by_set, owner = is_set[first], who[first]
    given = moves["alert_threshold_micro"].astype(float).to_numpy()[first]
    given = np.where(np.isnan(given), amount[first] * DEFAULT_THRESHOLD_SHARE, given)
    lasting = [states[n] or (0, 0, 0.0) for n in owner]
    start = np.where(by_set, amount[first], np.array([s[0] for s in lasting], np.int64))
    owed = np.where(by_set, 0, np.array([s[1] for s in lasting], np.int64))
    threshold = np.where(by_set, given, np.array([s[2] for s in lasting], float))
    live = by_set | np.array([states[n] is not None for n in owner], bool)

    total = np.cumsum(np.where(is_set, 0, np.where(kind == "topup", amount, -amount)))
    passed = np.concatenate(([0], total))[first]
    total = total - passed[part] + start[part]
    low = pd.Series(np.where(is_set, np.iinfo(np.int64).max, total)).groupby(part).cummin().to_numpy(np.int64)
    lift = np.where(low < 0, -low, 0)
    balance, debt, limit = total + lift, owed[part] + lift, threshold[part]
    before = np.where(opens, start[part], np.concatenate(([0], balance))[: len(balance)])
    cost = kind == "cost"
    alert = np.full(len(moves), None, object)
    alert[cost & (balance <= limit) & (limit < before)] = "BUDGET_LOW"
    alert[cost & (balance <= 0)] = "BUDGET_EXHAUSTED"
    booked = moves[["ts_ms", "ref", "kind", "amount_micro"]].assign(balance_micro=balance, debt_micro=debt, alert=alert)
    last = np.flatnonzero(np.concatenate((who[1:] != who[:-1], [True]))[: len(who)])
    after = {int(who[i]): (int(balance[i]), int(debt[i]), float(limit[i])) for i in last if live[part[i]]}
    return booked[live[part]], after


class BudgetDrawdown(StatefulProcessor):
    """Balance and debt of each customer of one bucket, movement by movement.

    Movements that come before a customer's first ``set`` wait in state; when it comes,
    those after it in time are booked, as the batch ledger does.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        customer = [T.StructField(c, T.StringType()) for c in CUSTOMER]
        # A customer without a budget has no balance, but a number of lots of movements that wait.
        self._budgets = handle.getMapState(
            "budgets",
            T.StructType(customer),
            T.StructType(
                [
                    T.StructField("balance", T.LongType()),
                    T.StructField("debt", T.LongType()),
                    T.StructField("threshold", T.DoubleType()),
                    T.StructField("lots", T.LongType()),
                ]
            ),
        )
        self._waiting = handle.getMapState(
            "waiting",
            T.StructType([*customer, T.StructField("lot", T.LongType())]),
            T.StructType([T.StructField("moves", T.StringType())]),
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        moves = pd.concat(list(rows), ignore_index=True)[[*CUSTOMER, *_MOVES]]
        number = moves.groupby(CUSTOMER, dropna=False, sort=False).ngroup()
        names, number = known_values(moves.loc[~number.duplicated(), CUSTOMER]), number.to_numpy(np.int64)
        empty = not self._budgets.exists()
        known = [None if empty else self._budgets.getValue(name) for name in names]
        states = [None if k is None or k[0] is None else tuple(k)[:3] for k in known]
        given = set(number[moves["kind"] == "set"].tolist())
        waits = np.array([state is None and n not in given for n, state in enumerate(states)])[number]
        for n, lot in moves.loc[waits, _MOVES].groupby(number[waits]):
            lots = 0 if known[n] is None else known[n][3]
            self._waiting.updateValue((*names[n], lots), (json.dumps([
                (int(m.ts_ms), int(m.seq), None if pd.isna(m.ref) else m.ref, m.kind, int(m.amount_micro), None) for m in lot.itertuples(index=False)
            ]),))
            self._budgets.updateValue(names[n], (None, None, None, lots + 1))
        ready = moves.assign(_who=number)[~waits]
        late = []
        for n in given:
            for lot in range(known[n][3] if states[n] is None and known[n] is not None else 0):
                came = json.loads(self._waiting.getValue((*names[n], lot))[0])
                late += [(*names[n], *move, n) for move in came]
                self._waiting.removeKey((*names[n], lot))
        if late:
            ready = pd.concat([pd.DataFrame(late, columns=ready.columns), ready])
        if not len(ready):
            return
        ready = ready.sort_values(["_who", "ts_ms", "seq", "ref"], ignore_index=True)
        booked, after = book_all(ready, ready["_who"].to_numpy(np.int64), states)
        for n, state in after.items():
            self._budgets.updateValue(names[n], (*state, 0))
        if len(booked):
            yield booked.join(ready[CUSTOMER])[BUDGET_SCHEMA.names]

    def close(self) -> None:
        pass


def budget_stream(movements: DataFrame) -> DataFrame:
    """Ledger and alerts of a stream of budget movements.

    Movements of one micro-batch are applied in time order. A micro-batch
    brings few per customer, because charges are closed windows; customers are dealt
    to ``BUCKETS`` buckets, each booked in one frame. A budget that
    comes after its charges books those that are later than it in time.
    """
    return movements.withColumn("_bucket", bucket(CUSTOMER)).groupBy("_bucket").transformWithStateInPandas(
        BudgetDrawdown(), BUDGET_SCHEMA, "append", "none"
    )


def stamp_volume_batches(
    stream: DataFrame, order: list[str], path: str, checkpoint: str, trigger: dict | None = None,
    hot_rows: int = HOT_ROWS,
) -> StreamingQuery:
    """Stamp volumes per micro-batch, for streams with keys too hot for one task.

    ``order`` gives the arrival order inside a micro-batch. Stamped events go
    to ``path/events``, what the batch adds to the month totals to ``path/totals``, each in a
    folder of its batch that a repeated batch overwrites; the totals are merged now and then. Inside a
    batch hot keys are split like in a batch job. The totals before the batch are each the first row of their key in the
    running sum, so that events are moved and sorted once; sizes and sums of the keys are taken in one pass.
    """
    keys = [*CUSTOMER_MODEL, "month"]
    totals = MergedSums(stream.sparkSession, f"{path}/totals", keys, ["tokens"])

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumns({"month": billing_month(F.col("ts_ms")), "event_tokens": total_tokens()})
        sums = keyed.groupBy(*keys).agg(F.sum("event_tokens").alias("tokens"), F.count("*").alias("_rows"))
        # One file per core and batch, not one per shuffle partition.
        sums = sums.coalesce(batch.sparkSession.sparkContext.defaultParallelism).persist()
        try:
            # A total makes a group one row larger, at most.
            hot = hot_among(sums.withColumn("_rows", F.col("_rows") + 1), keys, hot_rows)
            rows = keyed.withColumn("_event", F.lit(True))
            known = totals.read(before=batch_id) if batch_id else None
            if known is not None:
                before = known.select(*keys, F.col("tokens").alias("event_tokens"), F.lit(False).alias("_event"))
                rows = rows.unionByName(before, allowMissingColumns=True)
            stamped = running(
                rows, keys, ["_event", *order], {"volume_before": Running("sum", "event_tokens", inclusive=False)}, hot
            ).filter("_event").withColumn("volume_before", F.coalesce("volume_before", F.lit(0)))
            stamped.drop("event_tokens", "_event").write.mode("overwrite").parquet(f"{path}/events/batch_id={batch_id}")
            totals.add(sums, batch_id)
        finally:
            sums.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
