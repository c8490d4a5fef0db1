import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.admission import asof_state, check_decisions, rate_limited, spent_before
from tallyhouse.operators.budget import budget_ledger

from .test_budget import frame, move

REQUESTS = (
    "tenant_id string, customer_id string, request_id string, ts_ms bigint, estimate_micro bigint, "
    "parent_span_id string, session_id string, key_id string"
)
CHARGES = (
    "tenant_id string, customer_id string, ts_ms bigint, cost_micro bigint, parent_span_id string, "
    "session_id string, key_id string"
)


def test_asof_takes_the_state_at_or_before(spark):
    requests = spark.createDataFrame([("a", 5, "r1"), ("a", 10, "r2"), ("b", 10, "r3"), ("a", 1, "r0")], "k string, ts_ms bigint, id string")
    states = spark.createDataFrame([("a", 5, "1", 100), ("a", 5, "2", 90), ("a", 9, "1", 80)], "k string, ts_ms bigint, state_seq string, v bigint")
    for hot in (10**6, 2):
        got = asof_state(requests, states, ["k"], ["v"], ["id"], hot)
        assert {r.id: r.v for r in got.collect()} == {"r0": None, "r1": 90, "r2": 80, "r3": None}


def test_spend_counts_only_earlier_charges_and_null_keys_none(spark):
    requests = spark.createDataFrame([("s", 10, "r1"), ("s", 11, "r2"), (None, 20, "r3")], "k string, ts_ms bigint, request_id string")
    charges = spark.createDataFrame([("s", 5, 7), ("s", 10, 9), (None, 1, 100)], "k string, ts_ms bigint, cost_micro bigint")
    got = {r.request_id: r.spent for r in spent_before(requests, charges, ["k"], {"spent": []}).collect()}
    assert got == {"r1": 7, "r2": 16, "r3": 0}


def test_rate_limit_counts_passing_requests_only(spark):
    rows = [(None, "c", f"r{i}", i * 1_000, "ok" if i % 2 else "budget_exhausted") for i in range(10)]
    rows += [(None, "c", "next", 61_000, "ok"), (None, "free", "f", 0, "ok")]
    requests = spark.createDataFrame(rows, "tenant_id string, customer_id string, request_id string, ts_ms bigint, reason string")
    limits = spark.createDataFrame([(None, "c", 2)], "tenant_id string, customer_id string, max_rpm int")
    got = {r.request_id: r.reason for r in rate_limited(requests, limits, F.col("reason") == "ok").collect()}
    assert [got[f"r{i}"] for i in range(10)] == ["budget_exhausted", "ok", "budget_exhausted", "ok"] + ["rate_limited"] * 6
    assert got["next"] == got["f"] == "ok"


def decide(requests, moves, charges, limits, caps):
    """The gates, one request at a time."""
    out, used = {}, {}
    for r in sorted(requests, key=lambda r: (r[3], r[2])):
        _, who, rid, ts, est, span, session, key = r
        balance = None
        for m in sorted(moves, key=lambda m: (m[2], m[3], m[4])):
            if m[1] == who and m[2] <= ts:
                if m[5] == "set":
                    balance = m[6]
                elif balance is not None:
                    balance = max(0, balance + (m[6] if m[5] == "topup" else -m[6]))

        def spent(i, value, bucket=lambda t: 0):
            return sum(c[3] for c in charges if c[i] == value and c[2] < ts and bucket(c[2]) == bucket(ts))

        def over(kind, i, value, bucket=lambda t: 0):
            cap = caps[kind].get(value)
            return cap is not None and spent(i, value, bucket) + est > cap

        minute = (who, ts // 60_000)
        if who in limits and used.get(minute, 0) >= limits[who]:
            reason = "rate_limited"
        elif balance is None:
            reason = "no_budget_configured"
        elif balance <= 0:
            reason = "budget_exhausted"
        elif est > 0 and balance < est:
            reason = "insufficient_balance"
        elif over("span", 4, span) or over("session", 5, session):
            reason = "hierarchy_cap"
        elif over("day", 6, key, lambda t: t // 86_400_000):
            reason = "api_key_daily_budget"
        elif over("month", 6, key):
            reason = "api_key_monthly_budget"
        else:
            reason = "ok"
        if reason in ("ok", "no_budget_configured"):
            used[minute] = used.get(minute, 0) + 1
        out[rid] = reason
    return out


@pytest.mark.parametrize("hot_rows", [10**6, 40])
def test_decisions_equal_the_gates_in_order(spark, hot_rows):
    rng = random.Random(21)
    base = 1_704_067_200_000
    at = lambda: base + rng.randrange(0, 4 * 86_400_000, 20_000)
    pick = lambda kind, n: rng.choice([None, *[f"{kind}{i}" for i in range(n)]])
    requests = [(None, f"c{rng.randrange(4)}", f"r{i:03}", at(), rng.randrange(0, 40), pick("sp", 3), pick("se", 3), pick("k", 3)) for i in range(150)]
    charges = [(None, f"c{rng.randrange(4)}", at(), rng.randrange(0, 30), pick("sp", 3), pick("se", 3), pick("k", 3)) for _ in range(150)]
    moves = [move(f"c{c}", base + 1, "set", rng.randrange(50, 900)) for c in range(3)]
    moves += [move(c[1], c[2], "cost", c[3], ref=str(i)) for i, c in enumerate(charges)]
    caps = {"span": {"sp0": 200, "sp1": 500}, "session": {"se0": 300}, "day": {"k0": 90}, "month": {"k0": 250}}
    limits = {"c0": 1, "c1": 2}
    got = check_decisions(
        spark.createDataFrame(requests, REQUESTS), budget_ledger(frame(spark, moves)), spark.createDataFrame(charges, CHARGES),
        spark.createDataFrame([(None, c, n) for c, n in limits.items()], "tenant_id string, customer_id string, max_rpm int"),
        spark.createDataFrame(list(caps["span"].items()), "parent_span_id string, span_cap_micro bigint"),
        spark.createDataFrame(list(caps["session"].items()), "session_id string, session_cap_micro bigint"),
        spark.createDataFrame([("k0", 90, 250)], "key_id string, daily_cap_micro bigint, monthly_cap_micro bigint"),
        hot_rows,
    )
    want = decide(requests, moves, charges, limits, caps)
    assert {r.request_id: r.reason for r in got.collect()} == want
    assert len(set(want.values())) >= 6


@pytest.mark.parametrize("hot_rows", [10**6, 40])
def test_requests_that_are_their_own_charges(spark, hot_rows):
    rng = random.Random(17)
    base = 1_704_067_200_000
    pick = lambda kind, n: rng.choice([None, *[f"{kind}{i}" for i in range(n)]])
    rows = [
        (None, f"c{rng.randrange(4)}", f"r{i:03}", base + rng.randrange(0, 4 * 86_400_000, 40_000_000), rng.randrange(0, 40), pick("sp", 3), pick("se", 3), pick("k", 3))
        for i in range(200)
    ]
    requests = spark.createDataFrame(rows, REQUESTS)
    charges = requests.withColumn("cost_micro", F.col("estimate_micro")).select(*[c.split()[0] for c in CHARGES.split(", ")])
    ledger = budget_ledger(frame(spark, [move(f"c{c}", base - 1, "set", 5_000) for c in range(3)]))
    caps = (
        spark.createDataFrame([("sp0", 300)], "parent_span_id string, span_cap_micro bigint"),
        spark.createDataFrame([("se0", 400), ("se1", None)], "session_id string, session_cap_micro bigint"),
        spark.createDataFrame([("k0", 60, 500)], "key_id string, daily_cap_micro bigint, monthly_cap_micro bigint"),
    )
    apart = check_decisions(requests, ledger, charges, None, *caps, hot_rows)
    own = check_decisions(requests, ledger, "estimate_micro", None, *caps, hot_rows)
    assert sorted(map(str, own.collect())) == sorted(map(str, apart.select(*own.columns).collect()))
    assert {r.reason for r in own.collect()} >= {"ok", "hierarchy_cap", "api_key_daily_budget"}


def test_requests_without_a_time_have_spent_nothing_before(spark):
    rows = [("s", None, "r0", 4), ("s", 10, "r1", 7), ("s", 10, "r2", 1), ("s", 11, "r3", None), (None, 12, "r4", 5), ("s", 13, "r5", 1)]
    requests = spark.createDataFrame(rows, "k string, ts_ms bigint, request_id string, cost bigint")
    for hot in (10**6, 2):
        got = {r.request_id: r.spent for r in spent_before(requests, "cost", ["k"], {"spent": []}, hot).collect()}
        assert got == {"r0": 0, "r1": 4, "r2": 4, "r3": 12, "r4": 0, "r5": 12}
