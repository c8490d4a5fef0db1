"""Money as whole microdollars: exact sums, one rounding rule."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def half_up(value: Column) -> Column:
    """Nearest whole number, halves upward, as BIGINT."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def usd(micro: Column) -> Column:
    """Microdollars as a dollar amount; only for the last projection."""
    return micro.cast("double") / F.lit(1e6)


def to_micro(dollars: Column) -> Column:
    return half_up(dollars * F.lit(1e6))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null when the bottom is zero or null."""
    return top / F.when(bottom != 0, bottom)
