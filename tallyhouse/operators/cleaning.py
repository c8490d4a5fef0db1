"""Cleaning and validation of usage events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import known_table
from ..schema import DIMENSIONS, ENVIRONMENTS, MAX_METADATA_KEYS, TOKEN_COLUMNS
from ..sources.catalog import Catalog


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit("")) == ""


def filter_billable(df: DataFrame) -> DataFrame:
    """Drop events without customer or model, and streaming heartbeats."""
    heartbeat = F.coalesce(F.col("metadata")["_heartbeat"] == "true", F.lit(False))
    named = (F.coalesce("customer_id", F.lit("")) != "") & (F.coalesce("model_id", F.lit("")) != "")
    return df.filter(named & ~heartbeat)


def event_errors() -> Column:
    """The names of an event's columns that break the event schema, as an array."""
    def error(condition, name):
        return F.when(condition, F.lit(name))

    return F.array_compact(
        F.array(
            error(_blank("customer_id"), "customer_id"),
            error(_blank("model_id"), "model_id"),
            error(F.col("ts_ms").isNull(), "ts_ms"),
            *[error(F.col(c) < 0, c) for c in [*TOKEN_COLUMNS, "latency_ms"]],
            error(F.col("environment").isNotNull() & ~F.col("environment").isin(*ENVIRONMENTS), "environment"),
        )
    )


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check the event schema: (valid events, quarantine with ``errors``)."""
    checked = df.withColumn("errors", event_errors())
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def validate_metadata(
    df: DataFrame, allowed: list[str] = DIMENSIONS, max_keys: int = MAX_METADATA_KEYS
) -> tuple[DataFrame, DataFrame]:
    """Check metadata keys and values: (valid events, rejected with ``reason``)."""
    keys = F.map_keys("metadata")
    empty = F.exists(F.map_values("metadata"), lambda v: v.isNull() | (v == ""))
    reason = (
        F.when(F.col("metadata").isNull(), None)
        .when(F.size("metadata") > max_keys, "too_many_keys")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0, "key_not_allowed")
        .when(empty, "empty_value")
    )
    checked = df.withColumn("reason", reason)
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL")


def fill_defaults(df: DataFrame, now_ms: int, new_ids: bool = False) -> DataFrame:
    """Missing event time becomes ``now_ms``; optionally missing ids a UUID."""
    filled = df.withColumn("ts_ms", F.coalesce("ts_ms", F.lit(now_ms)))
    return filled.withColumn("event_id", F.coalesce("event_id", F.uuid())) if new_ids else filled


def total_tokens() -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in TOKEN_COLUMNS])


def with_total_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("total_tokens", total_tokens())


def normalized_model(model: Column, catalog: Catalog) -> Column:
    """Catalog name of a raw model id.

    A listed model is itself; otherwise the first prefix in list order that
    matches; otherwise the id stays. The prefix list is part of the catalog,
    so this compiles to string tests in the projection and needs no join.
    """
    name = F.when(model.isNull() | (model == ""), F.lit("unknown"))
    if catalog.models:
        name = name.when(model.isin(*catalog.models), model)
    for prefix in catalog.prefixes:
        name = name.when(model.startswith(prefix), F.lit(prefix))
    return name.otherwise(model)


# Above so many models and prefixes, names are looked up by joins.
COMPILED_NAMES = 1_000


def normalize_models(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Keep the given name as ``raw_model_id`` and put the catalog's into ``model_id``.

    A small catalog is compiled into the projection. For a large one a name is looked up in a
    table of models, and its beginnings in a table of prefixes: one join for each
    prefix length that occurs in the catalog, of which the prefix that is listed first wins. Rows
    are neither multiplied nor grouped, so streams are joined in the same way.
    """
    named = df.withColumn("raw_model_id", F.col("model_id"))
    if len(catalog.models) + len(catalog.prefixes) <= COMPILED_NAMES:
        return named.withColumn("model_id", normalized_model(F.col("model_id"), catalog))
    spark = df.sparkSession
    listed = known_table(spark, [(m, True) for m in catalog.models], "_model string, _listed boolean")
    first: dict[str, int] = {}
    for i, p in enumerate(catalog.prefixes):
        first.setdefault(p, i)
    joined = named.join(listed, F.col("model_id") == F.col("_model"), "left").drop("_model")
    matches = []
    for n in sorted({len(p) for p in first}):
        if not n:
            matches.append(F.struct(F.lit(first[""]).alias("at"), F.lit("").alias("prefix")))
            continue
        head, at = f"_head{n}", f"_at{n}"
        heads = known_table(spark, [(p, i) for p, i in first.items() if len(p) == n], f"{head} string, {at} int")
        joined = joined.join(heads, F.substring("model_id", 1, n) == F.col(head), "left")
        matches.append(F.when(F.col(at).isNotNull(), F.struct(F.col(at).alias("at"), F.col(head).alias("prefix"))))
    best = F.array_min(F.array_compact(F.array(*matches)))["prefix"] if matches else F.lit(None).cast("string")
    name = F.when(F.col("model_id").isNull() | (F.col("model_id") == ""), F.lit("unknown")).when(F.col("_listed"), F.col("model_id"))
    return joined.withColumn("model_id", name.otherwise(F.coalesce(best, "model_id"))).drop("_listed", *[c for c in joined.columns if c.startswith(("_head", "_at"))])


def scope_tenant(df: DataFrame) -> DataFrame:
    """A blank tenant means no tenant."""
    return df.withColumn("tenant_id", F.when(~_blank("tenant_id"), F.trim("tenant_id")))


def split_aggregation_key(df: DataFrame, column: str) -> DataFrame:
    """Split an imported ``tenant|customer|model`` or ``customer|model`` key.

    A key of one part is a customer with model ``unknown``.
    """
    parts = F.split(column, "\\|", -1)
    n = F.size(parts)
    return df.withColumns(
        {
            "tenant_id": F.when(n >= 3, F.get(parts, F.lit(0))),
            "customer_id": F.when(n >= 3, F.get(parts, F.lit(1)))
            .when(n == 2, F.get(parts, F.lit(0))).otherwise(F.col(column)),
            "model_id": F.when(n >= 3, F.get(parts, F.lit(2)))
            .when(n == 2, F.get(parts, F.lit(1))).otherwise(F.lit("unknown")),
        }
    )
