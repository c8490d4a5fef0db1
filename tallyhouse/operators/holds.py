"""Streaming holds and prepaid token packages.

Whether a hold or a package draw is accepted depends on what was accepted
before it. Most of a history needs no replay in order: running sums decide it
as long as nothing is refused. What follows a refusal is cut into independent
parts where the state is known. Only those parts are replayed row by row: small ones
by one task, large ones in slices that start from guesses.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import null_safe_join
from ..functions.running import HOT_ROWS, Hot, HotGroups, Running, find_hot, parted, running
from ..schema import CUSTOMER
from ..session import durable, written
from .cleaning import total_tokens
from .dedup import group_starts

PACKAGE_ORDER = ["ts_ms", "event_id"]


def package_drawdown(events: DataFrame, packages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Draw events from prepaid token packages.

    An event larger than what remains is rejected, and a smaller later one may
    still pass. ``packages``: ``customer_id, tokens``; customers without one
    are not limited and are left out. ``ts_ms, event_id`` is unique per
    customer. Output adds ``accepted`` and ``remaining_tokens`` after the event.
    Packages with a ``tenant_id`` are of that tenant's customer (null: of the one without a tenant); without the column a
    customer's package serves whatever tenant its events name.
    """
    tenants = "tenant_id" in packages.columns
    owner = F.to_json(F.struct("tenant_id", "customer_id")) if tenants else F.col("customer_id")
    columns = [*events.columns, "total_tokens", "accepted", "remaining_tokens"]
    drawn = events.withColumns({"total_tokens": total_tokens(), "_owner": owner}).join(
        packages.select(owner.alias("_owner"), F.col("tokens").alias("_left")), "_owner"
    ).filter("_left IS NOT NULL")
    # Read for its sizes and for each way below: events that come from long plans are not made again.
    drawn = written(drawn)
    hot = find_hot(drawn, ["_owner"], hot_rows)
    if hot.frame is None:
        return _drawn(drawn, refused=False).select(*columns)
    few, many = parted(drawn, hot)
    return _drawn(few, refused=False).select(*columns).unionByName(_drawn_by_sums(many, hot).select(*columns))


def _drawn(rows: DataFrame, refused: bool) -> DataFrame:
    """Draws of customers that each fit one task, walked once in order; ``refused`` if an event was refused before."""
    dealt = rows.repartition("_owner").sortWithinPartitions("_owner", *PACKAGE_ORDER)
    schema = T.StructType([*rows.schema, T.StructField("accepted", T.BooleanType()), T.StructField("remaining_tokens", T.LongType())])
    return dealt.mapInArrow(_draw_walk(refused), schema)


def _drawn_by_sums(drawn: DataFrame, hot: HotGroups) -> DataFrame:
    """Draws of customers that no task holds whole."""
    found = [*drawn.columns, "accepted", "remaining_tokens"]
    # An event larger than what is left never passes and draws nothing.
    fits = F.col("total_tokens") <= F.col("_left")
    summed = running(
        drawn.withColumn("_draw", F.when(fits, F.col("total_tokens")).otherwise(0)),
        ["_owner"], PACKAGE_ORDER, {"_sum": Running("sum", "_draw")}, hot,
    )
    refused = F.col("_sum") > F.col("_left")
    smooth = summed.filter(~refused).withColumns(
        {"accepted": fits, "remaining_tokens": F.col("_left") - F.col("_sum")}
    )
    later = summed.filter(refused)
    # What the package still held at the first refusal.
    left = later.groupBy("_owner").agg(
        F.min_by(F.col("_left") - (F.col("_sum") - F.col("_draw")), F.struct(*PACKAGE_ORDER)).alias("_left")
    )
    rest = later.drop("_draw", "_sum", "_left").join(left, "_owner").select(*drawn.columns)
    decided = [smooth.select(*found)]
    while hot.frame is not None:
        # Too many rows of one customer to walk: halve what is left with
        # running sums until few rows remain undecided.
        halved, rest = _halve(rest, hot)
        decided.append(halved.select(*found))
        rest = durable(rest)
        hot = find_hot(rest.filter("_left > 0"), ["_owner"], hot.hot_rows)
    # Where nothing is left only events of no tokens pass, whatever came before.
    spent = rest.filter("_left <= 0").withColumns({"accepted": F.coalesce(fits, F.lit(False)), "remaining_tokens": F.col("_left")})
    decided += [spent.select(*found), _drawn(rest.filter("_left > 0"), refused=True).select(*found)]
    return reduce(DataFrame.unionByName, decided)


def _halve(rest: DataFrame, hot: HotGroups) -> tuple[DataFrame, DataFrame]:
    """Decide events up to the one that takes ``_left`` to half or less: (decided, rest).

    Until then events of at most half always pass, and a larger one passes if
    it fits beside the small ones before it; the first that does, or the small
    one that brings the sum over half, ends the part. A customer whose rows
    never get there is decided whole.
    """
    half = F.col("total_tokens") * 2 <= F.col("_left")
    summed = running(
        rest.withColumn("_small", F.when(half, F.col("total_tokens")).otherwise(0)),
        ["_owner"], PACKAGE_ORDER, {"_sum": Running("sum", "_small")}, hot,
    )
    ends = F.when(half, F.col("_sum") * 2 > F.col("_left")).otherwise(
        F.col("total_tokens") <= F.col("_left") - F.col("_sum")
    )
    at = F.struct(*PACKAGE_ORDER)
    after = F.col("_left") - F.col("_sum") - F.when(half, 0).otherwise(F.col("total_tokens"))
    end = summed.filter(ends).groupBy("_owner").agg(
        F.min(at).alias("_end"), F.min_by(after, at).alias("_after")
    )
    placed = summed.join(end, "_owner", "left")
    before = F.col("_end").isNull() | (at <= F.col("_end"))
    is_end = F.coalesce(at == F.col("_end"), F.lit(False))
    decided = placed.filter(before).withColumns(
        {
            "accepted": half | is_end,
            "remaining_tokens": F.when(is_end, F.col("_after")).otherwise(F.col("_left") - F.col("_sum")),
        }
    )
    return decided, placed.filter(~before).withColumn("_left", F.col("_after")).select(*rest.columns)


def _draw_walk(refused: bool):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, draws = None, None
        for batch in batches:
            starts = group_starts(batch, ["_owner"])
            lefts, sizes = batch.column("_left").to_numpy(), batch.column("total_tokens")
            known = sizes.is_valid().to_numpy(zero_copy_only=False)
            sizes = sizes.fill_null(0).to_numpy()
            found = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                who = batch.column("_owner")[start].as_py()
                if draws is None or who != owner:
                    owner, draws = who, Draws(int(lefts[start]), refused)
                found.append(draws.take(sizes[start:end], known[start:end]))
            accepted, unknown, left = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64))
            more = [pa.array(accepted, pa.bool_(), mask=unknown), pa.array(left, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "accepted", "remaining_tokens"])

    return walk


class Draws:
    """One package: what is left of it, and whether it has refused an event that a full one would have taken."""

    def __init__(self, tokens: int, refused: bool = False):
        self.full, self.left, self.refused = tokens, tokens, refused

    def take(self, sizes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(accepted, not known whether, tokens left) of the next events; an event of unknown size draws nothing."""
        accepted, left = np.zeros(len(sizes), bool), np.empty(len(sizes), np.int64)
        # All that fit the package pass until their sum exceeds it.
        fits = known & (sizes <= self.left)
        sums = np.cumsum(np.where(fits, sizes, 0))
        over = sums > self.left
        smooth = int(over.argmax()) if over.any() else len(sizes)
        if (sizes < 0).any():
            smooth = 0
        accepted[:smooth], left[:smooth] = fits[:smooth], self.left - sums[:smooth]
        if smooth:
            self.left = int(left[smooth - 1])
        # Then one after the other: what remains only falls, so events above it now never pass.
        at = smooth
        for i in (smooth + np.flatnonzero(known[smooth:] & ((sizes[smooth:] <= self.left) | (sizes < 0).any()))).tolist():
            if sizes[i] <= self.left:
                left[at:i], at = self.left, i
                accepted[i] = True
                self.left -= int(sizes[i])
        left[at:] = self.left
        refusals = np.flatnonzero(known & ~accepted & (sizes <= self.full))
        first = 0 if self.refused else int(refusals[0]) if len(refusals) else len(sizes)
        self.refused = first < len(sizes) or self.refused
        unknown = ~known
        unknown[first:] = False
        return accepted, unknown, left


HOLD_ORDER = ["ts_ms", "action_id"]
SLICE_ROWS = 200_000


def hold_ledger(
    actions: DataFrame, span_caps: DataFrame | None = None, hot_rows: Hot = HOT_ROWS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Replay reserve and reconcile actions.

    ``actions``: tenant, customer, ``ts_ms, action_id`` (unique), ``action``
    (reserve or reconcile), ``amount_micro, parent_span_id, balance_micro``
    (as of the action; null is 0), with span caps ``span_spent_micro``, and, if
    reconciles belong to reserves, ``reserve_id``: the reserve's action id. A reserve
    passes when the balance less what is held covers it, and when its span's
    cap covers spent, held and new. A reconcile with a ``reserve_id`` releases that hold, and nothing
    if it was refused; one without releases its amount, at most what is held.
    Output adds ``accepted, held_micro`` after the action and ``reason``.

    Actions move to their customer's task once, and not at all if they come dealt by customer. Customers with more
    than ``hot_rows`` actions (or those measured before) are replayed in slices of about ``slice_rows``.
    """
    hot = hot_rows if isinstance(hot_rows, HotGroups) else find_hot(actions, CUSTOMER, hot_rows)
    if hot.frame is None:
        return _held_in_groups(actions, span_caps)
    few, many = parted(written(actions), hot)
    return _held_in_groups(few, span_caps).unionByName(_held_in_slices(many, span_caps, hot, slice_rows))


def _prepared(actions: DataFrame) -> DataFrame:
    rows = actions.withColumn("balance_micro", F.coalesce("balance_micro", F.lit(0)))
    if "span_spent_micro" not in rows.columns:
        rows = rows.withColumn("span_spent_micro", F.lit(0).cast("bigint"))
    return rows


def _reserve() -> Column:
    return F.col("action") == "reserve"


def _hopeless() -> Column:
    """Denied whatever is held: the balance or the cap alone is too small."""
    return _reserve() & (
        (F.col("balance_micro") < F.col("amount_micro"))
        | F.coalesce(F.col("span_spent_micro") + F.col("amount_micro") > F.col("span_cap_micro"), F.lit(False))
    )


def _foreseen(rows: DataFrame, hot: HotGroups) -> DataFrame:
    """What would be held if every other reserve passed, the parts that follow from it, and where they may be wrong.

    ``rows`` have ``_hopeless`` and ``_void`` (reconciles of those).
    """
    reserve = _reserve()
    # As if every other reserve passed: held is the running sum, lifted by how
    # far releases would have taken it below zero.
    step = F.when(F.col("_hopeless") | F.col("_void"), 0).when(reserve, F.col("amount_micro")).otherwise(-F.col("amount_micro"))
    summed = running(rows.withColumn("_step", step), CUSTOMER, HOLD_ORDER, {"_sum": Running("sum", "_step")}, hot)
    floored = running(
        summed, CUSTOMER, HOLD_ORDER,
        {"_low": Running("min", "_sum"), "_low_before": Running("min", "_sum", inclusive=False)}, hot,
    )

    def depth(low):
        return F.greatest(F.lit(0), -F.coalesce(F.col(low), F.lit(0)))

    opted = floored.withColumns(
        {
            "_held": F.col("_sum") + depth("_low"),
            "_held_before": F.col("_sum") - F.col("_step") + depth("_low_before"),
        }
    )
    # Held is never more than that, so where it reaches zero nothing is held
    # whatever was refused before, and a new part begins.
    opted = running(
        opted.withColumn("_zero", F.when(F.col("_held") == 0, 1).otherwise(0)), CUSTOMER, HOLD_ORDER,
        {"_part": Running("sum", "_zero", inclusive=False)}, hot,
    ).withColumn("_part", F.coalesce("_part", F.lit(0)))
    # Holds of a capped span outlive a part; from its first one on a customer
    # is one part.
    capped = reserve & F.col("span_cap_micro").isNotNull() & ~F.col("_hopeless")
    opted = running(
        opted, CUSTOMER, HOLD_ORDER, {"_capped_part": Running("min", F.when(capped, F.col("_part")))}, hot
    ).withColumn("_part", F.coalesce("_capped_part", "_part"))
    doubtful = capped | (
        reserve & ~F.col("_hopeless") & (F.col("balance_micro") - F.col("_held_before") < F.col("amount_micro"))
    )
    return opted.withColumn("_doubt", F.when(doubtful, 1).otherwise(0))


def _foreseen_outcome() -> dict[str, Column]:
    """The decision on an action in a part without doubt."""
    reserve = _reserve()
    reason = (
        F.when(F.col("_void"), "not_reserved").when(~reserve, "released").when(~F.col("_hopeless"), "reserved")
        .when(F.col("balance_micro") - F.col("_held_before") < F.col("amount_micro"), "insufficient_balance")
        .otherwise("hierarchy_reserve")
    )
    return {"accepted": ~F.col("_hopeless") & ~F.col("_void"), "held_micro": F.col("_held"), "reason": reason}


def _held_in_groups(actions: DataFrame, span_caps: DataFrame | None) -> DataFrame:
    """Customers that each fit one task: caps and refused reserves are found where the actions lie, and doubtful parts walked there."""
    rows = _prepared(actions).repartition(*CUSTOMER)
    so_far = (Window.unboundedPreceding, 0)
    if span_caps is None:
        rows = rows.withColumn("span_cap_micro", F.lit(None).cast("bigint"))
    else:
        spans = actions.filter("parent_span_id IS NOT NULL").select(*CUSTOMER, "parent_span_id").distinct()
        caps = spans.join(span_caps.select("parent_span_id", F.col("span_cap_micro").alias("_cap")), "parent_span_id")
        unnamed = span_caps.filter("parent_span_id IS NULL").agg(F.max("span_cap_micro")).scalar()
        both = caps.withColumn("_side", F.lit(0)).repartition(*CUSTOMER).unionByName(rows.withColumn("_side", F.lit(1)), allowMissingColumns=True)
        of_span = Window.partitionBy(*CUSTOMER, "parent_span_id").orderBy("_side").rowsBetween(*so_far)
        cap = F.when(F.col("parent_span_id").isNull(), unnamed).otherwise(F.max("_cap").over(of_span))
        rows = both.withColumn("span_cap_micro", cap).filter("_side = 1").drop("_side", "_cap")
    rows = rows.withColumn("_hopeless", _hopeless())
    if "reserve_id" in rows.columns:
        # The reserve of an action comes before what reconciles it.
        rows = rows.withColumn("_of", F.when(_reserve(), F.col("action_id")).otherwise(F.col("reserve_id")))
        of_reserve = Window.partitionBy(*CUSTOMER, "_of").orderBy(F.when(_reserve(), 0).otherwise(1)).rowsBetween(*so_far)
        void = ~_reserve() & F.col("_of").isNotNull() & F.max("_hopeless").over(of_reserve)
        rows = rows.withColumn("_void", F.coalesce(void, F.lit(False))).drop("_of")
    else:
        rows = rows.withColumns({"reserve_id": F.lit(None).cast("string"), "_void": F.lit(False)})
    foreseen = _foreseen(rows, HotGroups(CUSTOMER, 0, HOT_ROWS, None))
    part = Window.partitionBy(*CUSTOMER, "_part").orderBy(*HOLD_ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = foreseen.withColumn("_walk", F.max("_doubt").over(part) == 1).withColumns(_foreseen_outcome())
    given = list(dict.fromkeys([*actions.columns, *WALKED, "_walk", "accepted", "held_micro", "reason"]))
    ordered = marked.select(*given).sortWithinPartitions(*CUSTOMER, "_part", *HOLD_ORDER)
    found = [*actions.columns, "accepted", "held_micro", "reason"]
    return ordered.mapInArrow(_hold_walk(found), ordered.select(*found).schema)


def _held_in_slices(actions: DataFrame, span_caps: DataFrame | None, hot: HotGroups, slice_rows: int) -> DataFrame:
    """Customers that no task holds whole."""
    columns = [*actions.columns, "accepted", "held_micro", "reason"]
    rows = _prepared(actions)
    if span_caps is not None:
        rows = null_safe_join(rows, span_caps.select("parent_span_id", "span_cap_micro"), ["parent_span_id"], "left")
    else:
        rows = rows.withColumn("span_cap_micro", F.lit(None).cast("bigint"))
    rows = rows.withColumn("_hopeless", _hopeless())
    if "reserve_id" in rows.columns:
        refused = rows.filter("_hopeless").select(*CUSTOMER, F.col("action_id").alias("reserve_id"), F.lit(True).alias("_void"))
        rows = null_safe_join(rows, refused, [*CUSTOMER, "reserve_id"], "left").withColumn("_void", F.coalesce(F.col("_void") & ~_reserve(), F.lit(False)))
    else:
        rows = rows.withColumns({"reserve_id": F.lit(None).cast("string"), "_void": F.lit(False)})
    # Read twice below, after several shuffles, and by few of its columns: a checkpoint would keep whole rows uncompressed.
    marked = written(_foreseen(rows, hot).select(*dict.fromkeys([*actions.columns, *WALKED]), "_hopeless", "_void", "_held", "_held_before", "_doubt"))
    # A part with a doubt is replayed from its beginning, so that the replay knows the open holds.
    doubted = marked.filter("_doubt = 1").select(*CUSTOMER, "_part").distinct()
    walk = null_safe_join(marked, doubted, [*CUSTOMER, "_part"], "left_semi").select(*WALKED, "_held_before")
    walked = _replayed(walk, slice_rows)
    seen = null_safe_join(marked, walked, [*CUSTOMER, *HOLD_ORDER], "left")
    return seen.withColumns({name: F.coalesce(name, c) for name, c in _foreseen_outcome().items()}).select(*columns)


WALKED = [
    *CUSTOMER, "_part", *HOLD_ORDER, "action", "amount_micro", "parent_span_id", "balance_micro",
    "span_cap_micro", "span_spent_micro", "reserve_id",
]
DECIDED = (
    "tenant_id string, customer_id string, ts_ms bigint, action_id string, "
    "accepted boolean, held_micro bigint, reason string"
)


def _missing(value) -> bool:
    return value is None or value != value


class Holds:
    """What is held: in all, by capped span, and by reserve that may still be reconciled.

    A guessed state knows only what may be held in all; of reserves made before it, it takes it that they passed.
    """

    def __init__(self, held: int = 0, spans: dict | None = None, opened: dict | None = None, guess: bool = False):
        self.held, self.spans, self.opened, self.guess = held, spans or {}, opened or {}, guess

    @classmethod
    def read(cls, text: str) -> Holds:
        return cls(*json.loads(text))

    def __str__(self) -> str:
        return json.dumps([self.held, self.spans, self.opened, self.guess], sort_keys=True)

    def _release(self, amount: int, span: str | None) -> None:
        self.held -= amount
        if span in self.spans:
            self.spans[span] -= min(amount, self.spans[span])
            if self.spans[span] == 0:
                del self.spans[span]

    def apply(self, row) -> tuple[bool, str]:
        """Whether an action is accepted, and why."""
        span = row.parent_span_id
        if row.action != "reserve":
            if _missing(row.reserve_id) or (self.guess and row.reserve_id not in self.opened):
                self._release(min(int(row.amount_micro), self.held), span)
                return True, "released"
            if row.reserve_id not in self.opened:
                return False, "not_reserved"
            self._release(self.opened.pop(row.reserve_id), span)
            return True, "released"
        amount, capped = int(row.amount_micro), not (_missing(span) or _missing(row.span_cap_micro))
        if row.balance_micro - self.held < amount:
            return False, "insufficient_balance"
        if capped and row.span_spent_micro + self.spans.get(span, 0) + amount > row.span_cap_micro:
            return False, "hierarchy_reserve"
        self.held += amount
        self.opened[row.action_id] = amount
        if capped:
            self.spans[span] = self.spans.get(span, 0) + amount
        return True, "reserved"

    def all(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Decisions on actions in order."""
        found = []
        for row in frame.itertuples(index=False):
            accepted, why = self.apply(row)
            found.append((accepted, self.held, why))
        decided = pd.DataFrame(found, columns=["accepted", "held_micro", "reason"], index=frame.index)
        return pd.concat([frame[[*CUSTOMER, *HOLD_ORDER]], decided], axis=1)


class Action(NamedTuple):
    """What a replay reads of an action, by the names of its columns."""

    action: str
    action_id: str
    amount_micro: int
    parent_span_id: str | None
    balance_micro: int
    span_cap_micro: int | None
    span_spent_micro: int
    reserve_id: str | None


def _hold_walk(found: list[str]):
    """Parts of bounded size with a doubt, replayed in order; other rows are passed on as they are decided."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, holds = None, Holds()
        for batch in batches:
            rows = batch.filter(batch.column("_walk"))
            starts = iter([*group_starts(rows, [*CUSTOMER, "_part"]).tolist(), -1])
            start, decided = next(starts), []
            for at, action in enumerate(map(Action._make, zip(*(rows.column(c).to_pylist() for c in Action._fields)))):
                if at == start:
                    me, start = tuple(rows.column(c)[at].as_py() for c in (*CUSTOMER, "_part")), next(starts)
                    if me != who:
                        who, holds = me, Holds()
                accepted, why = holds.apply(action)
                decided.append((accepted, holds.held, why))
            columns = {c: batch.column(c) for c in found}
            if decided:
                for name, values in zip(("accepted", "held_micro", "reason"), zip(*decided)):
                    columns[name] = pc.replace_with_mask(columns[name], batch.column("_walk"), pa.array(values, columns[name].type))
            yield pa.RecordBatch.from_arrays(list(columns.values()), found)

    return walk


def _replayed(walk: DataFrame, slice_rows: int) -> DataFrame:
    """Parts of any size, by speculation: slices are replayed at once, each from a guessed start.

    A slice's first guess is that all reserves before it passed. After each round a slice starts where the one before
    it has ended, and only slices whose start has changed are replayed again. The first slice of a part is
    right from the beginning and every round makes one more so at least; as soon as two starts lead to
    the same end, a change goes no further.
    """
    sliced = walk.repartitionByRange(max(2, -(-walk.count() // slice_rows)), *CUSTOMER, "_part", *HOLD_ORDER)
    sliced = durable(sliced.withColumn("_slice", F.spark_partition_id()))
    group = [*CUSTOMER, "_part", "_slice"]
    before = Window.partitionBy(*CUSTOMER, "_part").orderBy("_slice")  # one row per slice
    firsts = sliced.groupBy(*group).agg(F.min_by("_held_before", F.struct(*HOLD_ORDER)).alias("_held"))
    guessed = F.format_string("[%d, {}, {}, true]", "_held")
    starts = durable(firsts.withColumn("_nth", F.row_number().over(before)).select(
        *group, F.when(F.col("_nth") == 1, F.lit(str(Holds()))).otherwise(guessed).alias("_state")
    ))
    ends, changed = None, starts
    while True:
        again = _by_slice(sliced, changed, group, _end_of, [*(f"{f.name} {f.dataType.simpleString()}" for f in starts.select(*group).schema), "_end string"])
        ends = durable(again if ends is None else null_safe_join(ends, changed, group, "left_anti").unionByName(again))
        follow = ends.withColumn("_next", F.lag("_end").over(before))
        both = null_safe_join(starts, follow, group, "left").withColumn("_new", F.coalesce("_next", "_state"))
        both = durable(both.select(*group, "_state", "_new"))
        changed = both.filter("_state <> _new").select(*group, F.col("_new").alias("_state"))
        if changed.isEmpty():
            break
        starts = both.select(*group, F.col("_new").alias("_state"))
    return _by_slice(sliced, starts, group, _decisions_of, [DECIDED])


def _by_slice(sliced: DataFrame, starts: DataFrame, group: list[str], replay, schema: list[str]) -> DataFrame:
    starts = starts.toDF(*starts.columns)  # columns of its own, that are not those of the slices it comes from
    rows = null_safe_join(sliced.drop("_held_before"), starts.select(*group), group, "left_semi")
    return rows.groupBy(*group).cogroup(starts.groupBy(*group)).applyInPandas(replay, ", ".join(schema))


def _end_of(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
    holds = Holds.read(start["_state"].iloc[0])
    holds.all(rows.sort_values(HOLD_ORDER))
    holds.guess = False
    out = start[[*CUSTOMER, "_part", "_slice"]].copy()
    out["_end"] = str(holds)
    return out


def _decisions_of(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
    return Holds.read(start["_state"].iloc[0]).all(rows.sort_values(HOLD_ORDER))


def open_holds(ledger: DataFrame) -> DataFrame:
    """Amount held per customer after the last action."""
    return ledger.groupBy(*CUSTOMER).agg(
        F.max_by("held_micro", F.struct(*HOLD_ORDER)).alias("held_micro")
    )
