"""Stateful processors work on many keys in one call."""

import pandas as pd

from tallyhouse.streaming import expiring, state


class Kept:
    """A map state in memory."""

    def __init__(self):
        self.rows = {}

    def exists(self):
        return bool(self.rows)

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def keys(self):
        return iter(self.rows)

    def iterator(self):
        return iter(self.rows.items())


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, Kept())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def listTimers(self):
        return iter(sorted(self.timers))


class At:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now


def run(processor, rows, columns):
    frames = [pd.DataFrame(part, columns=columns) for part in rows]
    out = list(processor.handleInputRows((0,), iter(frames), None))
    return [row for frame in out for row in frame.itertuples(index=False, name=None)]


def test_volumes_of_many_keys_in_one_call():
    handle, columns = Handle(), ["tenant_id", "customer_id", "model_id", "month", "event_tokens", "arrival_seq"]
    volumes = state.MonthVolume(["customer_id", "arrival_seq", "volume_before"], ["arrival_seq"], 1000)
    volumes.init(handle)
    lot = [(None, "a", "m", "2024-01", 5, 2), (None, "b", "m", "2024-01", 7, 0), (None, "a", "m", "2024-01", 3, 1), (None, "a", "m", "2024-02", 1, 3), ("t", "a", "m", "2024-01", 9, 4)]
    assert run(volumes, [lot[:2], lot[2:]], columns) == [("b", 0, 0), ("a", 1, 0), ("a", 2, 3), ("a", 3, 0), ("a", 4, 0)]
    assert run(volumes, [[(None, "a", "m", "2024-01", 1, 5), (None, "b", "m", "2024-01", 1, 6)]], columns) == [("a", 5, 8), ("b", 6, 7)]
    assert len(handle.timers) == 2
    list(volumes.handleExpiredTimer((0,), None, At(min(handle.timers))))
    assert list(handle.states["months"].rows) == [(None, "a", "m", "2024-02")]


def test_budgets_of_many_customers_in_one_call():
    handle = Handle()
    budgets = state.BudgetDrawdown()
    budgets.init(handle)
    columns = ["tenant_id", "customer_id", "ts_ms", "seq", "ref", "kind", "amount_micro", "alert_threshold_micro"]
    booked = lambda rows: [(r[1], r[2], r[6], r[7], r[8]) for r in run(budgets, [rows], columns)]
    move = lambda who, at, kind, amount: (None, who, at, 0, None, kind, amount, None)
    assert booked([move("late", 5, "cost", 4), move("a", 2, "cost", 30), move("b", 1, "set", 10), move("a", 1, "set", 20), move("b", 3, "cost", 9)]) == [
        ("a", 1, 20, 0, None), ("a", 2, 0, 10, "BUDGET_EXHAUSTED"), ("b", 1, 10, 0, None), ("b", 3, 1, 0, "BUDGET_LOW"),
    ]
    assert booked([move("late", 6, "cost", 5)]) == []
    assert booked([move("a", 4, "topup", 3), move("late", 0, "set", 7), move("b", 5, "cost", 1)]) == [
        ("a", 4, 3, 10, None), ("late", 0, 7, 0, None), ("late", 5, 3, 0, None), ("late", 6, 0, 2, "BUDGET_EXHAUSTED"), ("b", 5, 0, 0, "BUDGET_EXHAUSTED"),
    ]
    assert not handle.states["waiting"].rows


def test_spans_in_one_call_and_their_end():
    handle, columns = Handle(), ["tenant_id", "parent_span_id", "customer_id", "ts_ms", "cost_micro", "event_tokens"]
    spans = expiring.SpanTotals(100)
    spans.init(handle)
    first = [(None, "s", "x", 10, 1, 5), (None, "r", "y", 50, 2, 6), (None, "s", None, 30, 3, 7)]
    assert run(spans, [first, [(None, "s", "w", 30, 1, 1)]], columns) == [(None, "s", "w", 13, 5, 3, 10, 30), (None, "r", "y", 6, 2, 1, 50, 50)]
    assert handle.timers == {130}
    handle.timers.clear()
    list(spans.handleExpiredTimer((0,), At(140), At(130)))
    assert list(handle.states["totals"].rows) == [(None, "r")] and handle.timers == {150}
    assert run(spans, [[(None, "s", "z", 200, 1, 1)]], columns) == [(None, "s", "z", 1, 1, 1, 200, 200)]
