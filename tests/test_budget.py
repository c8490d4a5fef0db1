import random

import pytest

from tallyhouse.operators.budget import (
    MOVEMENT_COLUMNS, budget_alerts, budget_ledger, budget_status, latest_state, reconcile, warn_ladder,
)

SCHEMA = (
    "tenant_id string, customer_id string, ts_ms bigint, seq bigint, ref string, kind string, "
    "amount_micro bigint, alert_threshold_micro bigint, model_id string"
)


def move(customer, ts, kind, amount, threshold=None, ref=None):
    seq = {"set": 0, "topup": 1, "rerate": 2, "cost": 3}[kind]
    return (None, customer, ts, seq, ref or f"{ts}", kind, amount, threshold, None)


def frame(spark, moves):
    return spark.createDataFrame(moves, SCHEMA).select(*MOVEMENT_COLUMNS)


def random_moves(rng, customers=6, length=120):
    moves = []
    for c in range(customers):
        for i in range(length):
            kind = rng.choices(["cost", "topup", "set", "rerate"], [20, 3, 0.4, 1])[0]
            amount = rng.randrange(-40, 40) if kind == "rerate" else rng.randrange(0, 300 if kind != "cost" else 90)
            moves.append(move(f"c{c}", 1_000 * i, kind, amount, rng.choice([None, 50])))
    return moves


def recursion(moves):
    """(customer, ts) -> (balance, debt), one movement at a time."""
    state, out = {}, {}
    for m in sorted(moves, key=lambda m: (m[1], m[2], m[3], m[4])):
        _, who, ts, _, _, kind, amount, _, _ = m
        if kind == "set":
            state[who] = (amount, 0)
        elif who in state:
            balance, debt = state[who]
            balance += amount if kind == "topup" else -amount
            state[who] = (max(0, balance), debt + max(0, -balance))
        if who in state:
            out[who, ts] = state[who]
    return out


@pytest.mark.parametrize("hot_rows", [10**6, 50])
def test_ledger_equals_the_recursion(spark, hot_rows):
    moves = random_moves(random.Random(1))
    ledger = budget_ledger(frame(spark, moves), hot_rows)
    got = {(r.customer_id, r.ts_ms): (r.balance_micro, r.debt_micro) for r in ledger.collect()}
    assert got == recursion(moves)


def test_alerts_on_crossing_and_while_exhausted(spark):
    moves = [
        move("c", 0, "set", 1_000), move("c", 1, "cost", 850), move("c", 2, "cost", 60),
        move("c", 3, "cost", 10), move("c", 4, "cost", 500), move("c", 5, "cost", 1),
    ]
    ledger = budget_ledger(frame(spark, moves))
    found = sorted((r.ts_ms, r.alert) for r in budget_alerts(ledger).collect())
    assert found == [(2, "BUDGET_LOW"), (4, "BUDGET_EXHAUSTED"), (5, "BUDGET_EXHAUSTED")]
    assert sorted(r.ts_ms for r in budget_alerts(ledger, first_only=True).collect()) == [2, 4]
    state = latest_state(ledger).first()
    assert (state.balance_micro, state.debt_micro) == (0, 421)


def test_warn_ladder_golden(spark):
    moves = [
        move("a", 0, "set", 100), move("a", 1, "cost", 75),
        move("b", 0, "set", 100), move("b", 1, "cost", 95),
    ]
    found = sorted((r.customer_id, r.rung) for r in warn_ladder(budget_ledger(frame(spark, moves))).collect())
    assert found == [("a", 70), ("b", 70), ("b", 90)]


def ladder(moves, ttl, percents=(70, 90)):
    """Alerts one movement at a time, with a sent time per rung."""
    out, state = set(), {}
    for m in sorted(moves, key=lambda m: (m[1], m[2], m[3], m[4])):
        _, who, ts, _, _, kind, amount, threshold, _ = m
        if kind == "set":
            sent = state[who]["sent"] if who in state else {}
            state[who] = {"b": amount, "top": amount, "limit": threshold, "sent": sent}
            continue
        if who not in state:
            continue
        s = state[who]
        s["b"] = max(0, s["b"] + (amount if kind == "topup" else -amount))
        if kind == "topup":
            s["top"] += amount
        if kind != "cost":
            continue
        if s["b"] <= 0:
            out.add((who, ts, 0))
            s["sent"] = {}
            continue
        spent = max(0, s["top"] - s["b"]) / s["top"] * 100 if s["top"] > 0 else None
        tests = [(p, spent is not None and spent >= p) for p in percents]
        tests.append((100, s["limit"] is not None and s["b"] <= s["limit"]))
        for rung, hit in tests:
            if not hit:
                s["sent"].pop(rung, None)
            elif rung not in s["sent"] or ts - s["sent"][rung] >= ttl:
                out.add((who, ts, rung))
                s["sent"][rung] = ts
    return out


@pytest.mark.parametrize("hot", [10**6, 60])
def test_warn_ladder_equals_the_walk(spark, hot):
    moves = random_moves(random.Random(11), customers=8)
    got = {(r.customer_id, r.ts_ms, r.rung) for r in warn_ladder(budget_ledger(frame(spark, moves)), ttl_ms=5_000, hot=hot).collect()}
    assert got == ladder(moves, 5_000)


def test_reconcile_shows_debt_as_drift(spark):
    moves = [
        move("c", 0, "set", 100_000), move("c", 1, "cost", 150_000),
        move("d", 0, "set", 100_000), move("d", 1, "topup", 50_000), move("d", 2, "cost", 20_000),
    ]
    ledger = budget_ledger(frame(spark, moves))
    drifts, summary = reconcile(ledger)
    row = drifts.first()
    assert (drifts.count(), row.customer_id, row.drift_micro, row.drift_net_of_debt_micro) == (1, "c", 50_000, 0)
    assert tuple(summary.first()) == (2, 1)
    usage = spark.createDataFrame([(None, "c", 150_000)], "tenant_id string, customer_id string, cost_micro bigint")
    status = {r.customer_id: r for r in budget_status(ledger, usage).collect()}
    assert status["c"].exhausted and status["c"].spent_micro == 150_000
    assert status["d"].effective_micro == 130_000 and status["d"].spent_micro == 0
