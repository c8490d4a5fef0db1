import random

import pytest

from tallyhouse.operators import holds
from tallyhouse.operators.holds import hold_ledger, open_holds, package_drawdown

from .helpers import events


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_package_equals_the_walk(spark, hot_rows):
    rng = random.Random(4)
    rows = [
        {"event_id": f"e{i}", "customer_id": f"c{rng.randrange(5)}", "ts_ms": rng.randrange(200),
         "input_tokens": rng.choice([0, 1, 3, 9, 40, 90, 400])}
        for i in range(700)
    ]
    tokens = {"c0": 1_000, "c1": 250, "c2": 0, "c3": 100_000}
    packages = spark.createDataFrame(list(tokens.items()), "customer_id string, tokens bigint")
    want, left = {}, dict(tokens)
    for r in sorted(rows, key=lambda r: (r["ts_ms"], r["event_id"])):
        who = r["customer_id"]
        if who in left:
            ok = r["input_tokens"] <= left[who]
            left[who] -= r["input_tokens"] if ok else 0
            want[r["event_id"]] = (ok, left[who])
    got = package_drawdown(events(spark, rows), packages, hot_rows)
    assert {r.event_id: (r.accepted, r.remaining_tokens) for r in got.collect()} == want


def walk(actions, caps):
    """(accepted, held, reason) by action, as one customer after the other would see it."""
    held, spans, opened, out = {}, {}, {}, {}
    for a in sorted(actions, key=lambda a: (a[1], a[2], a[3])):
        _, who, ts, aid, action, amount, span, balance, spent, of = a
        h, balance = held.get(who, 0), balance or 0
        if action == "reserve":
            cap = caps.get(span)
            if balance - h < amount:
                out[aid] = (False, h, "insufficient_balance")
            elif cap is not None and spent + spans.get(span, 0) + amount > cap:
                out[aid] = (False, h, "hierarchy_reserve")
            else:
                held[who] = h + amount
                opened[aid] = amount
                if cap is not None:
                    spans[span] = spans.get(span, 0) + amount
                out[aid] = (True, held[who], "reserved")
        elif of is not None and of not in opened:
            out[aid] = (False, h, "not_reserved")
        else:
            released = min(amount, h) if of is None else opened.pop(of)
            held[who] = h - released
            if span in spans:
                spans[span] -= min(released, spans[span])
            out[aid] = (True, held[who], "released")
    return out, held


SCHEMA = (
    "tenant_id string, customer_id string, ts_ms bigint, action_id string, action string, amount_micro bigint, "
    "parent_span_id string, balance_micro bigint, span_spent_micro bigint, reserve_id string"
)


def loose(rng, n):
    """Reconciles that belong to no reserve."""
    for i in range(n):
        who = f"c{rng.randrange(4)}"
        span = rng.choice([None, f"{who}-s{rng.randrange(3)}"])
        yield (None, who, i, f"a{i:04}", rng.choices(["reserve", "reconcile"], [5, 6])[0], rng.randrange(1, 60),
               span, rng.choice([80, 150, 400, None]), rng.randrange(0, 50), None)


def paired(rng, n):
    """Each reserve with its reconcile some time later; one customer has most of them."""
    for i in range(n):
        who = rng.choice(["c0"] * 9 + ["c1"])
        span, amount, ts = rng.choice([None, f"{who}-s{rng.randrange(3)}"]), rng.randrange(1, 60), 3 * i
        yield (None, who, ts, f"a{i:04}", "reserve", amount, span, rng.choice([80, 150, 400, None]), rng.randrange(0, 50), None)
        yield (None, who, ts + rng.randrange(0, 40), f"b{i:04}", "reconcile", amount, span, None, 0, f"a{i:04}")


@pytest.mark.parametrize("hot_rows, make", [(10**6, loose), (60, loose), (10**6, paired), (60, paired)])
@pytest.mark.parametrize("capped", [False, True])
def test_holds_equal_the_walk(spark, capped, hot_rows, make):
    actions = list(make(random.Random(8), 400))
    caps = {f"c{c}-s{s}": 120 for c in range(2) for s in range(2)} if capped else {}
    frame = spark.createDataFrame(actions, SCHEMA)
    cap_frame = spark.createDataFrame(list(caps.items()), "parent_span_id string, span_cap_micro bigint") if capped else None
    ledger = hold_ledger(frame, cap_frame, hot_rows, slice_rows=90)
    want, held = walk(actions, caps)
    assert {r.action_id: (r.accepted, r.held_micro, r.reason) for r in ledger.collect()} == want
    assert {r.customer_id: r.held_micro for r in open_holds(ledger).collect()} == held


def test_a_second_reserve_over_the_span_cap(spark):
    make = lambda n, action, of=None: (None, "c", n, f"a{n}", action, 60, "parent", 1000, 0, of)
    caps = spark.createDataFrame([("parent", 100)], "parent_span_id string, span_cap_micro bigint")
    for second, third in ((make(2, "reserve"), "hierarchy_reserve"), (make(2, "reconcile", "a1"), "reserved")):
        got = {r.action_id: r.reason for r in hold_ledger(spark.createDataFrame([make(1, "reserve"), second, make(3, "reserve")], SCHEMA), caps).collect()}
        assert got["a3"] == third


def test_a_hot_customer_is_replayed_by_several_tasks(spark, monkeypatch):
    sizes = []
    by_slice = holds._by_slice

    def seen(sliced, starts, *rest):
        sizes.append([r["count"] for r in sliced.groupBy("customer_id", "_slice").count().collect()])
        return by_slice(sliced, starts, *rest)

    monkeypatch.setattr(holds, "_by_slice", seen)
    actions = list(paired(random.Random(3), 600))
    got = hold_ledger(spark.createDataFrame(actions, SCHEMA), None, 300, slice_rows=100)
    assert {r.action_id: (r.accepted, r.held_micro, r.reason) for r in got.collect()} == walk(actions, {})[0]
    assert len(sizes[0]) > 4 and max(sizes[0]) < 300
    assert len(sizes) <= len(sizes[0]) + 1


@pytest.mark.parametrize("hot_rows", [10**6, 2])
def test_packages_of_two_tenants(spark, hot_rows):
    rows = [
        {"event_id": f"{t}{i}", "tenant_id": t, "customer_id": "c", "model_id": "m", "ts_ms": i, "input_tokens": size}
        for t in ("a", "b", None) for i, size in enumerate([40, 50, 30, 10])
    ]
    packages = spark.createDataFrame([("a", "c", 100), (None, "c", 45), ("b", "other", 9)], "tenant_id string, customer_id string, tokens bigint")
    got = package_drawdown(events(spark, rows), packages, hot_rows).orderBy("tenant_id", "ts_ms").collect()
    assert [(r.tenant_id, r.customer_id, r.accepted, r.remaining_tokens) for r in got] == [
        (None, "c", True, 5), (None, "c", False, 5), (None, "c", False, 5), (None, "c", False, 5),
        ("a", "c", True, 60), ("a", "c", True, 10), ("a", "c", False, 10), ("a", "c", True, 0),
    ]


def test_actions_of_a_customer_move_once(spark):
    actions = list(paired(random.Random(3), 60))
    dealt = spark.createDataFrame(actions, SCHEMA).repartition("tenant_id", "customer_id")
    ledger = hold_ledger(dealt)
    assert ledger._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want, _ = walk(actions, {})
    assert {r.action_id: (r.accepted, r.held_micro, r.reason) for r in ledger.collect()} == want


@pytest.mark.parametrize("hot_rows", [10**6, 1])
def test_a_cap_without_a_span_is_of_actions_without_one(spark, hot_rows):
    caps = spark.createDataFrame([(None, 50), ("s", 70)], "parent_span_id string, span_cap_micro bigint")
    rows = [(None, "c", n, f"a{n}", "reserve", amount, span, 1000, 0, None) for n, (amount, span) in enumerate([(60, None), (40, None), (60, "s"), (60, "other")])]
    got = {r.action_id: r.reason for r in hold_ledger(spark.createDataFrame(rows, SCHEMA), caps, hot_rows).collect()}
    assert got == {"a0": "hierarchy_reserve", "a1": "reserved", "a2": "reserved", "a3": "reserved"}
