"""Prepaid budgets: ledger, balances and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..functions.running import HOT_ROWS, Hot, HotGroups, Running, find_hot, running
from ..schema import CUSTOMER
from .dedup import keep_every

# Share of the initial balance at which a low-balance alert
# fires when no threshold is set, the warning rungs in percent spent, and the
# time to live of a sent alert.
DEFAULT_THRESHOLD_SHARE = 0.10
WARN_PERCENTS = (70, 90)
ALERT_TTL_MS = 3_600_000

MOVEMENT_COLUMNS = [
    "tenant_id", "customer_id", "ts_ms", "seq", "ref", "kind", "amount_micro",
    "alert_threshold_micro", "model_id",
]

# Same-time order of movements.
KIND_ORDER = {"set": 0, "topup": 1, "rerate": 2, "cost": 3}


def movements(df: DataFrame, kind: str) -> DataFrame:
    """Shape rows with tenant, customer, time, ``ref`` and amount as ledger movements."""
    return df.withColumns(
        {
            "kind": F.lit(kind),
            "seq": F.lit(KIND_ORDER[kind]).cast("bigint"),
            "alert_threshold_micro": F.col("alert_threshold_micro")
            if "alert_threshold_micro" in df.columns else F.lit(None).cast("bigint"),
            "model_id": F.col("model_id") if "model_id" in df.columns else F.lit(None).cast("string"),
        }
    ).select(*MOVEMENT_COLUMNS)


def cost_movements(windows: DataFrame) -> DataFrame:
    """Charges of usage windows, booked at the window's end."""
    return movements(
        windows.select(
            *CUSTOMER, F.col("window_end_ms").alias("ts_ms"),
            F.concat_ws("|", "model_id", F.col("window_start_ms").cast("string")).alias("ref"),
            F.col("cost_micro").alias("amount_micro"), "model_id",
        ),
        "cost",
    )


def signed_amount() -> Column:
    """Effect of a movement on the balance; a re-rate adjustment is a charge."""
    return F.when(F.col("kind").isin("set", "topup"), F.col("amount_micro")).when(
        F.col("kind").isin("cost", "rerate"), -F.col("amount_micro")
    ).otherwise(0)


LEDGER_ORDER = ["ts_ms", "seq", "ref"]


def budget_ledger(moves: DataFrame, hot: Hot = HOT_ROWS) -> DataFrame:
    """Balance, debt and threshold after each movement.

    The balance never falls below zero; what a charge takes beyond it becomes
    debt, which top-ups do not repay. ``set`` starts anew. With S the running
    sum of movements since the last ``set``, debt is the depth S has reached
    below zero, and the balance is S plus debt. Movements before the first
    ``set`` have no budget to draw on and are left out.
    """
    hot = hot if isinstance(hot, HotGroups) else find_hot(moves, CUSTOMER, hot)
    is_set = F.col("kind") == "set"
    epochs = running(
        moves, CUSTOMER, LEDGER_ORDER,
        {"epoch": Running("sum", F.when(is_set, 1).otherwise(0))},
        hot,
    ).filter("epoch > 0")
    keys = [*CUSTOMER, "epoch"]
    initial = F.when(is_set, F.col("amount_micro"))
    threshold = F.when(
        is_set,
        F.coalesce(
            F.col("alert_threshold_micro").cast("double"),
            F.col("amount_micro") * F.lit(DEFAULT_THRESHOLD_SHARE),
        ),
    )
    summed = running(
        epochs.withColumn("_signed", signed_amount()), keys, LEDGER_ORDER,
        {
            "_s": Running("sum", "_signed"),
            "initial_micro": Running("last", initial),
            "threshold_micro": Running("last", threshold),
            "explicit_threshold_micro": Running("last", F.when(is_set, F.col("alert_threshold_micro"))),
            "topup_micro": Running("sum", F.when(F.col("kind") == "topup", F.col("amount_micro")).otherwise(0)),
            "deducted_micro": Running("sum", F.when(F.col("kind") == "cost", F.col("amount_micro")).otherwise(0)),
        },
        hot,
    )
    deep = running(
        summed, keys, LEDGER_ORDER,
        {"_low": Running("min", "_s"), "_low_before": Running("min", "_s", inclusive=False)},
        hot,
    )

    def debt(low):
        return F.greatest(F.lit(0), -F.coalesce(F.col(low), F.lit(0)))

    return deep.withColumns(
        {
            "debt_micro": debt("_low"),
            "balance_micro": F.col("_s") + debt("_low"),
            "balance_before_micro": F.when(
                ~is_set, F.col("_s") - F.col("_signed") + debt("_low_before")
            ),
        }
    ).drop("_signed", "_s", "_low", "_low_before")


def budget_alerts(ledger: DataFrame, first_only: bool = False) -> DataFrame:
    """Alerts of charges: exhausted at zero, low on crossing the threshold downward.

    While exhausted every charge alerts; ``first_only`` keeps the first after
    a positive balance.
    """
    after, before = F.col("balance_micro"), F.col("balance_before_micro")
    exhausted = after <= 0
    if first_only:
        exhausted = exhausted & (before > 0)
    kind = F.when(exhausted, "BUDGET_EXHAUSTED").when(
        (after > 0) & (after <= F.col("threshold_micro")) & (before > F.col("threshold_micro")), "BUDGET_LOW"
    )
    return (
        ledger.filter(F.col("kind") == "cost")
        .withColumn("alert", kind)
        .filter("alert IS NOT NULL")
        .select(
            *CUSTOMER, "ts_ms", "ref", "model_id", "alert",
            F.col("amount_micro").alias("window_cost_micro"), "balance_micro",
        )
    )


# What the ladder reads of a ledger.
WARN_COLUMNS = [
    *CUSTOMER, "ts_ms", "seq", "ref", "kind", "balance_micro", "initial_micro", "topup_micro", "explicit_threshold_micro",
]


def warn_ladder(
    ledger: DataFrame,
    percents: tuple[int, ...] = WARN_PERCENTS,
    ttl_ms: int = ALERT_TTL_MS,
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Spent-share warnings, one per rung, repeated at most every ``ttl_ms``.

    Each charge compares the spent share of (initial + top-ups) with the
    rungs, and the balance with an explicit threshold (rung 100, alert
    ``BUDGET_LOW``). A rung is silent for ``ttl_ms`` after an alert; recovery
    or exhaustion clears it. Exhaustion itself always alerts (rung 0).
    """
    ceiling = F.col("initial_micro") + F.col("topup_micro")
    spent = F.when(
        ceiling > 0,
        F.least(F.lit(100.0), F.greatest(F.lit(0), ceiling - F.col("balance_micro")) / ceiling * 100.0),
    )
    charges = ledger.filter(F.col("kind") == "cost").withColumn("spent_pct", spent)
    exhausted = F.col("balance_micro") <= 0
    hits = [(p, F.coalesce(F.col("spent_pct") >= p, F.lit(False)) & ~exhausted) for p in sorted(percents)]
    hits.append((100, F.coalesce(F.col("balance_micro") <= F.col("explicit_threshold_micro"), F.lit(False)) & ~exhausted))
    facts = [*CUSTOMER, "ts_ms", "seq", "ref", "balance_micro", "spent_pct", "initial_micro"]
    tested = charges.select(*facts, *[hit.alias(f"_hit{i}") for i, (_, hit) in enumerate(hits)])
    hot = hot if isinstance(hot, HotGroups) else find_hot(ledger, CUSTOMER, hot)
    keys = [*CUSTOMER, "rung"]
    # A run of hits without a clear in between shares one debounce clock. All rungs are counted in one pass; only
    # hits become rows of their rung.
    counted = running(
        tested, CUSTOMER, LEDGER_ORDER,
        {f"_run{i}": Running("sum", F.when(F.col(f"_hit{i}"), 0).otherwise(1)) for i in range(len(hits))}, hot,
    )
    found = F.array_compact(F.array(*[
        F.when(F.col(f"_hit{i}"), F.struct(F.lit(rung).alias("rung"), F.col(f"_run{i}").alias("_run")))
        for i, (rung, _) in enumerate(hits)
    ]))
    runs = counted.select(*facts, F.explode(found).alias("_r")).select(*facts, "_r.rung", "_r._run")
    # Several charges at one time: the first of them carries the alert.
    first = (
        runs.groupBy(*keys, "_run", "ts_ms")
        .agg(F.min_by(F.struct("ref", "balance_micro", "spent_pct", "initial_micro"), F.struct("seq", "ref")).alias("_f"))
    )
    warned = keep_every(
        first.withColumnRenamed("_run", "_clear"), [*keys, "_clear"], "ts_ms", ttl_ms, hot
    ).select(
        *CUSTOMER, "ts_ms", "_f.ref", "rung",
        F.when(F.col("rung") == 100, "BUDGET_LOW").otherwise("BUDGET_WARN").alias("alert"),
        "_f.balance_micro", "_f.spent_pct",
    )
    spent_out = charges.filter(exhausted).select(
        *CUSTOMER, "ts_ms", "ref", F.lit(0).alias("rung"),
        F.lit("BUDGET_EXHAUSTED").alias("alert"), "balance_micro", "spent_pct",
    )
    return warned.unionByName(spent_out)


def latest_state(ledger: DataFrame) -> DataFrame:
    """Ledger state of each customer after its last movement."""
    state = F.struct(
        "balance_micro", "debt_micro", "initial_micro", "topup_micro", "deducted_micro", "threshold_micro",
    )
    return (
        ledger.groupBy(*CUSTOMER)
        .agg(F.max_by(state, F.struct("ts_ms", "seq", "ref")).alias("_s"))
        .select(*CUSTOMER, "_s.*")
    )


def budget_status(ledger: DataFrame, usage: DataFrame, holds: DataFrame | None = None) -> DataFrame:
    """Balance, holds, debt and lifetime spend of each customer with a budget."""
    state = null_safe_join(
        latest_state(ledger), usage.select(*CUSTOMER, F.col("cost_micro").alias("spent_micro")), CUSTOMER, "left"
    )
    if holds is None:
        state = state.withColumn("held_micro", F.lit(0).cast("bigint"))
    else:
        state = null_safe_join(state, holds.select(*CUSTOMER, "held_micro"), CUSTOMER, "left")
    return state.select(
        *CUSTOMER, "balance_micro",
        F.coalesce("held_micro", F.lit(0)).alias("held_micro"),
        (F.col("balance_micro") - F.coalesce("held_micro", F.lit(0))).alias("effective_micro"),
        "debt_micro", F.coalesce("spent_micro", F.lit(0)).alias("spent_micro"),
        (F.col("balance_micro") <= 0).alias("exhausted"),
    )


def reconcile(ledger: DataFrame, threshold_micro: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Compare balances with initial + top-ups − deducted: (drifts, summary).

    Debt and re-rates are not in that formula and show as drift;
    ``drift_net_of_debt_micro`` takes the debt out.
    """
    expected = F.col("initial_micro") + F.col("topup_micro") - F.col("deducted_micro")
    checked = latest_state(ledger).select(
        *CUSTOMER, "balance_micro", expected.alias("expected_micro"), "debt_micro",
        (F.col("balance_micro") - expected).alias("drift_micro"),
        (F.col("balance_micro") - expected - F.col("debt_micro")).alias("drift_net_of_debt_micro"),
    )
    drifted = F.abs("drift_micro") > threshold_micro
    summary = checked.agg(
        F.count("*").alias("customers_scanned"), F.count(F.when(drifted, 1)).alias("drift_count")
    )
    return checked.filter(drifted), summary


def listed_drifts(drifts: DataFrame, n: int = 100) -> DataFrame:
    """The drift report: the first ``n`` customers."""
    return drifts.orderBy(*CUSTOMER).limit(n)
