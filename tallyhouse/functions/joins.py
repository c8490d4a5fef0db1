"""Joins on keys that may be null (an event without a tenant is valid)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where null matches null, keeping one copy of each key."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    on = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    )
    joined = left.join(renamed, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full_outer", "full", "outer"):
        for k in keys:
            joined = joined.withColumn(k, F.coalesce(k, f"_r_{k}"))
    return joined.drop(*[f"_r_{k}" for k in keys])
