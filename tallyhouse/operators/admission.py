"""Replay of request admission against budgets, caps and rate limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..functions.periods import billing_day, billing_month
from ..functions.running import BROADCAST_ROWS, HOT_ROWS, Hot, HotGroups, Running, find_hot, find_hot_of_many, running
from ..schema import CUSTOMER


def asof_state(
    requests: DataFrame,
    states: DataFrame,
    keys: list[str],
    values: list[str],
    request_order: list[str],
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Give each request the latest state at or before its time.

    Both frames have ``ts_ms``. At the same millisecond the state comes first.
    States are ordered by their own ``state_seq``. One pass over the union of
    both, ordered by time, carries the last state forward.
    """
    of_states = states.select(
        *keys, "ts_ms", F.lit(0).alias("_side"), F.col("state_seq").cast("string").alias("_seq"), F.struct(*values).alias("_state"),
    )
    # Columns of requests are null in states; each travels once, and only if it is read later.
    both = of_states.unionByName(requests.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return (
        running(both, keys, ["ts_ms", "_side", "_seq", *request_order], {"_asof": Running("last", "_state")}, hot)
        .filter("_side = 1")
        .select(*requests.columns, "_asof.*")
    )


def spent_before(
    requests: DataFrame,
    charges: DataFrame | str,
    keys: list[str],
    outs: dict[str, list[str]],
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Add charges of the same key strictly before each request's time.

    ``outs`` maps an output to the further columns it is kept apart by, such
    as a billing period; both frames have those. ``charges`` has the keys,
    ``ts_ms`` and ``cost_micro``; ``request_id`` is unique. A request whose key
    is null gets 0, and is placed on its own so that such requests do not meet
    in one task. If ``charges`` is a column of the requests, each request is itself charged that at its time: one row
    then stands for both.
    """
    none = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    alone = F.when(none, F.col("request_id")).otherwise("")
    apart = list(dict.fromkeys(c for columns in outs.values() for c in columns))
    if isinstance(charges, str):
        hot = hot if isinstance(hot, HotGroups) else find_hot(requests, keys, hot)
        if hot.frame is None:
            rows, nothing = requests.withColumn("_alone", alone), none | F.col("ts_ms").isNull()
            for out, columns in outs.items():
                earlier = Window.partitionBy(*keys, "_alone", *columns).orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -1)
                spent = F.coalesce(F.sum(charges).over(earlier), F.lit(0))
                rows = rows.withColumn(out, F.when(nothing, 0).otherwise(spent))
            return rows.select(*[c for c in requests.columns if c not in apart], *outs)
        charges = requests.select(*keys, *apart, "ts_ms", F.col(charges).alias("cost_micro"))
    of_requests = requests.withColumns(
        {"_alone": alone, "_side": F.lit(0), "_charge": F.lit(0).cast("bigint")}
    )
    # At one time requests come first, and all charges of that time after them: charges need not be summed before.
    summed = charges.dropna(subset=keys).select(
        *keys, *apart, F.lit("").alias("_alone"), "ts_ms", F.lit(1).alias("_side"), F.col("cost_micro").alias("_charge"),
    ).unionByName(of_requests, allowMissingColumns=True)
    hot = hot if isinstance(hot, HotGroups) else find_hot(summed, keys, hot)
    for out, columns in outs.items():
        summed = running(
            summed, [*keys, "_alone", *columns], ["ts_ms", "_side", "request_id"], {out: Running("sum", "_charge")}, hot
        )
    return summed.filter("_side = 0").select(*[c for c in requests.columns if c not in apart], *outs)


def _capped(requests, charges, caps, keys, cap_columns, outs, hot, periods=None, around=False):
    """Join caps to requests and add what was spent on capped keys only; null without a key.

    Few caps are broadcast after the running sum, so that requests are shuffled once and without them. ``around``
    lets requests without a key bypass the shuffle, for which they are made twice.
    """
    found = [*cap_columns, "_has_cap"]

    def with_caps(df, known):
        return df.join(known.select(*keys, *found), keys, "left").select(*df.columns, *found)

    few = caps.count() <= BROADCAST_ROWS
    caps = caps.withColumn("_has_cap", F.lit(True))
    caps = F.broadcast(caps) if few else caps
    around = around or not few
    if not isinstance(charges, str):
        charges = null_safe_join(
            charges.dropna(subset=keys).select(*keys, "ts_ms", "cost_micro"), caps.select(*keys), keys, "left_semi"
        ).withColumns(periods or {})
    named = requests.dropna(subset=keys) if around else requests
    named = named if few else with_caps(named, caps)
    spent = spent_before(named.withColumns(periods or {}), charges, keys, outs, hot)
    spent = with_caps(spent, caps) if few else spent
    # What is spent on a key without a cap is not asked for.
    spent = spent.withColumns({out: F.when(F.col("_has_cap"), F.col(out)).otherwise(0) for out in outs}).drop("_has_cap")
    if around:
        unnamed = requests.filter(" OR ".join(f"{k} IS NULL" for k in keys))
        return spent.unionByName(unnamed, allowMissingColumns=True)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return spent.withColumns({out: F.when(known, F.col(out)) for out in outs})


def ledger_order() -> Column:
    """Text that sorts like the ledger does inside one instant: by number, then reference."""
    return F.format_string("%020d|%s", F.col("seq").cast("bigint"), F.coalesce("ref", F.lit("")))


def check_decisions(
    requests: DataFrame,
    ledger: DataFrame,
    charges: DataFrame | str,
    rate_limits: DataFrame | None = None,
    span_caps: DataFrame | None = None,
    session_caps: DataFrame | None = None,
    key_caps: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Decide each request in the order of the gates.

    ``requests``: tenant, customer, ``request_id`` (unique), ``ts_ms``,
    ``estimate_micro``, ``parent_span_id``, ``session_id``, ``key_id`` and
    optionally ``held_micro``. ``ledger`` is the budget ledger and
    ``charges`` the priced events, or the requests' column that each is charged at its time. Caps are micro-dollar limits per span,
    session and key. Output adds ``allowed, reason`` and what each gate saw.
    """
    columns = requests.columns

    def measured(keys):
        """Rows per key over requests and charges; a ledger row stands for charges."""
        charged = requests if isinstance(charges, str) else charges
        both = requests.select(*keys).unionByName(charged.select(*keys)).dropna(subset=keys[-1:])
        return find_hot_of_many(both, keys, hot_rows) if keys != CUSTOMER else find_hot(both, keys, hot_rows)

    # Caps come first, each test kept as a flag; balances and rate limits then share the deal of requests to customers.
    estimate = F.greatest(F.col("estimate_micro"), F.lit(0))
    seen, no_cap = requests, F.lit(False)
    flags = {"_span_over": no_cap, "_session_over": no_cap, "_day_over": no_cap, "_month_over": no_cap}
    if span_caps is not None:
        seen = _capped(
            seen, charges, span_caps, ["parent_span_id"], ["span_cap_micro"], {"span_spent_micro": []},
            measured(["parent_span_id"]), around=True,  # most have no span
        )
        seen = seen.withColumn("_span_over", F.coalesce(F.col("span_spent_micro") + estimate > F.col("span_cap_micro"), no_cap))
    if session_caps is not None:
        seen = _capped(
            seen, charges, session_caps, ["session_id"], ["session_cap_micro"], {"session_spent_micro": []},
            measured(["session_id"]),
        )
        seen = seen.withColumn("_session_over", F.coalesce(F.col("session_spent_micro") + estimate > F.col("session_cap_micro"), no_cap))
    if key_caps is not None:
        ts = F.col("ts_ms")
        # Days lie inside months, so one shuffle by key and month serves both.
        seen = _capped(
            seen, charges, key_caps, ["key_id"], ["daily_cap_micro", "monthly_cap_micro"],
            {"key_month_micro": ["_month"], "key_day_micro": ["_month", "_day"]}, measured(["key_id"]),
            {"_month": billing_month(ts), "_day": billing_day(ts)},
        )
        seen = seen.withColumns(
            {
                "_day_over": F.coalesce(F.col("key_day_micro") + estimate > F.col("daily_cap_micro"), no_cap),
                "_month_over": F.coalesce(F.col("key_month_micro") + estimate > F.col("monthly_cap_micro"), no_cap),
            }
        )
    seen = seen.withColumns({flag: none for flag, none in flags.items() if flag not in seen.columns})
    state = ledger.select(
        *CUSTOMER, "ts_ms", ledger_order().alias("state_seq"), "balance_micro"
    )
    of_customers = measured(CUSTOMER)
    # A ledger lies dealt by customer already; the requests come to it.
    seen = seen.repartition(*CUSTOMER) if of_customers.frame is None else seen
    seen = asof_state(seen, state, CUSTOMER, ["balance_micro"], ["request_id"], of_customers)
    held = F.coalesce("held_micro", F.lit(0)) if "held_micro" in columns else F.lit(0)
    seen = seen.withColumn("effective_micro", F.col("balance_micro") - held)

    reason = (
        F.when(F.col("balance_micro").isNull(), "no_budget_configured")
        .when(F.col("effective_micro") <= 0, "budget_exhausted")
        .when((F.col("estimate_micro") > 0) & (F.col("effective_micro") < F.col("estimate_micro")), "insufficient_balance")
        .when(F.col("_span_over") | F.col("_session_over"), "hierarchy_cap")
        .when(F.col("_day_over"), "api_key_daily_budget")
        .when(F.col("_month_over"), "api_key_monthly_budget")
        .otherwise("ok")
    )
    decided = seen.withColumn("reason", reason).drop(*flags)
    passing = F.col("reason").isin("ok", "no_budget_configured")
    if rate_limits is not None:
        decided = rate_limited(decided, rate_limits, passing, of_customers)
    return decided.withColumn("allowed", F.col("reason").isin("ok", "no_budget_configured"))


def rate_limited(
    requests: DataFrame,
    limits: DataFrame,
    passing: Column,
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Apply ``max_rpm`` per calendar minute; only passing requests use a slot.

    The slots used so far are the earlier passing requests of the minute up to
    the limit, so counting those decides every request.
    """
    known = limits.select(*CUSTOMER, "max_rpm")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    limited = null_safe_join(requests, known, CUSTOMER, "left").withColumns(
        {"_minute": F.floor(F.col("ts_ms") / 60_000), "_slot": F.when(passing, 1).otherwise(0)}
    )
    counted = running(
        limited, [*CUSTOMER, "_minute"], ["ts_ms", "request_id"],
        {"_used": Running("sum", "_slot", inclusive=False)}, hot,
    )
    over = (F.coalesce("max_rpm", F.lit(0)) > 0) & (F.coalesce("_used", F.lit(0)) >= F.col("max_rpm"))
    return counted.withColumn("reason", F.when(over, "rate_limited").otherwise(F.col("reason"))).drop(
        "_minute", "_slot", "_used"
    )
