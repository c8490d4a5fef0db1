"""From raw events to priced usage, counters and cost tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import billing_day
from ..functions.running import HOT_ROWS, HotGroups, find_hot
from ..operators import usage
from ..operators.budget import budget_alerts, budget_ledger, cost_movements, latest_state
from ..operators.cleaning import filter_billable, normalize_models, scope_tenant
from ..operators.dedup import dedup_in_window, survivor_columns
from ..operators.pricing import price_events
from ..operators.volume import stamp_volume
from ..schema import CUSTOMER, CUSTOMER_MODEL, TOKEN_COLUMNS
from ..sources.catalog import Catalog


def billable_usage(events: DataFrame, catalog: Catalog) -> DataFrame:
    """Billable events with normalised names, duplicates still in."""
    return normalize_models(scope_tenant(filter_billable(events)), catalog)


# What every counter needs; other columns travel through the shuffle on request.
CORE_COLUMNS = [
    "event_id", *CUSTOMER_MODEL, *TOKEN_COLUMNS, "ts_ms", "latency_ms", "parent_span_id", "session_id", "key_id",
]


def core_usage(
    events: DataFrame, catalog: Catalog, carry: tuple[str, ...] = (), only: tuple[str, ...] | None = None
) -> DataFrame:
    """Billable usage without columns that no step asks for: a dedup moves whatever it is given.

    ``only`` names the core columns that are read later, beyond keys, time and tokens.
    """
    billable = billable_usage(events, catalog)
    core = CORE_COLUMNS if only is None else survivor_columns([*TOKEN_COLUMNS, *only, *carry])
    return billable.select(*[c for c in dict.fromkeys((*core, *carry)) if c in billable.columns])


def clean_usage(
    events: DataFrame, catalog: Catalog, carry: tuple[str, ...] = (), only: tuple[str, ...] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    return dedup_in_window(core_usage(events, catalog, carry, only), tasks=tasks)


def priced_usage(
    events: DataFrame, catalog: Catalog, carry: tuple[str, ...] = (), hot_rows: int = HOT_ROWS,
    only: tuple[str, ...] | None = None, tasks: int | None = None,
) -> DataFrame:
    """Clean, stamp and price events; ``carry`` names columns to keep beyond the core ones, ``only`` which of those are read.

    The volume stamp is only made for catalogs with tiers; a flat catalog
    prices each event on its own, without ordering anything. With ``tasks`` the rows come in no more than so many tasks (events
    without an id in as many others), for writers that open files in each.
    """
    clean = clean_usage(events, catalog, carry, only, None if catalog.needs_volume else tasks)
    if not catalog.needs_volume:
        return price_events(clean, catalog)
    stamped = stamp_volume(clean, hot_rows, sizes_from=billable_usage(events, catalog))
    stamped = stamped if tasks is None else stamped.coalesce(tasks)
    return price_events(stamped, catalog, "volume_before").drop("month")


def cost_tables(priced: DataFrame) -> dict[str, DataFrame]:
    """The monthly and daily cost tables that all cost intelligence reads (``CostStore`` keeps them)."""
    by_model = usage.usage_by_customer_model_month(priced)
    daily = priced.groupBy(*CUSTOMER, billing_day(F.col("ts_ms")).alias("day")).agg(
        F.sum("cost_micro").alias("cost_micro")
    )
    return {
        "model_costs": by_model,
        "customer_costs": by_model.groupBy(*CUSTOMER, "period").agg(F.sum("cost_micro").alias("cost_micro")),
        "dim_costs": usage.usage_by_dim(priced).filter("period IS NOT NULL"),
        "daily": daily,
    }


def customer_sizes(events: DataFrame, movements: DataFrame, hot_rows: int = HOT_ROWS):
    """Rows per customer in a ledger of these events, at most: a charge is one event or more."""
    rows = scope_tenant(events).select(*CUSTOMER).unionByName(movements.select(*CUSTOMER))
    return find_hot(rows, CUSTOMER, hot_rows)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table that several steps read, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rebuild(
    events: DataFrame, movements: DataFrame, catalog: Catalog, tenant: str | None = None,
    hot_rows: int = HOT_ROWS, path: str | None = None,
) -> dict[str, DataFrame]:
    """Every counter and budget again from the stored events.

    ``movements`` seeds budgets (set and top-up rows). ``tenant`` rebuilds one
    tenant only. The steps are those of the normal path. With a ``path`` what several tables are made of
    is written there once, else each table prices the events anew.
    """
    if tenant is not None:
        events = events.filter(F.col("tenant_id") == tenant)
        movements = movements.filter(F.col("tenant_id") == tenant)
    priced = priced_usage(events, catalog, ("metadata",), hot_rows)
    if path is not None:
        priced = stored(priced, f"{path}/priced")
    return counters(priced, movements, customer_sizes(events, movements, hot_rows), path)


def counters(priced: DataFrame, movements: DataFrame, hot: HotGroups, path: str | None = None) -> dict[str, DataFrame]:
    """All tables that follow from priced events and budget movements; ``hot`` are ``customer_sizes``."""
    def kept(df: DataFrame, name: str) -> DataFrame:
        return df if path is None else stored(df, f"{path}/{name}")

    windows = kept(usage.usage_windows(priced), "windows")
    ledger = kept(budget_ledger(movements.unionByName(cost_movements(windows)), hot), "ledger")
    return {
        "usage_windows": windows,
        "usage_global": usage.usage_global(windows),
        "usage_by_customer": usage.usage_by_customer(priced),
        "usage_by_customer_model": usage.usage_by_customer_model(priced),
        "usage_by_customer_model_month": usage.usage_by_customer_model_month(priced),
        "usage_rollup": usage.usage_rollup(priced),
        "usage_by_session": usage.usage_by_session(priced),
        "span_usage": usage.usage_by_span(priced),
        "usage_by_dim": usage.usage_by_dim(priced),
        "spend_by_key": usage.spend_by_key(priced),
        "budget_ledger": ledger,
        "budget_state": latest_state(ledger),
        "budget_alerts": budget_alerts(ledger),
    }


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Write rebuilt tables as parquet; the rollup is partitioned by grain."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if name == "usage_rollup":
            writer = writer.partitionBy("grain")
        writer.parquet(f"{path}/{name}")
