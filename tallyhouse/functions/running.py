"""Running aggregates over ordered groups of any size.

``running`` gives each row an aggregate of the rows before it in its group. An
ordinary window needs the whole group in one task, so groups with more than
``hot_rows`` rows take another way: they are range-partitioned on group and
order together, which cuts one group into consecutive slices; each slice is
summarised to one row, the summaries are accumulated, and the slice's own
window adds the accumulated value. Sum, count, min, max and last are all
associative, so both ways give the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable
from .joins import null_safe_join
from .tables import known_table

BROADCAST_ROWS = 100_000
HOT_ROWS = 5_000_000
BUCKETS = 65_536


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` is sum, count, min, max or last (non-null)."""

    how: str
    value: Column | str
    inclusive: bool = True

    def column(self) -> Column:
        return F.col(self.value) if isinstance(self.value, str) else self.value

    def over(self, frame) -> Column:
        value = self.column()
        if self.how == "last":
            return F.last(value, ignorenulls=True).over(frame)
        return getattr(F, self.how)(value).over(frame)

    def summary(self, order: list[str]) -> Column:
        value = self.column()
        if self.how == "last":
            return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
        return getattr(F, self.how)(value)

    def carried(self, name: str, frame) -> Column:
        """The summary of all earlier slices, from one summary per slice."""
        if self.how == "last":
            return F.last(name, ignorenulls=True).over(frame)
        if self.how in ("sum", "count"):
            return F.sum(name).over(frame)
        return getattr(F, self.how)(name).over(frame)

    def combine(self, carried: Column, local: Column) -> Column:
        if self.how == "sum":
            return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
        if self.how == "count":
            return F.coalesce(carried, F.lit(0)) + local
        if self.how == "min":
            return F.least(carried, local)
        if self.how == "max":
            return F.greatest(carried, local)
        return F.coalesce(local, carried)


@dataclass(frozen=True)
class HotGroups:
    """Groups too large for one task; ``frame`` holds their keys, None when there are none."""

    keys: list[str]
    total_rows: int
    hot_rows: int
    frame: DataFrame | None


Hot = HotGroups | int


def find_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> HotGroups:
    """Measure group sizes: one pass over the keys, summed before the shuffle.

    At most ``total_rows / hot_rows`` groups are hot, so the bound of a broadcast is known.
    """
    return hot_among(df.groupBy(*keys).agg(F.count("*").alias("_rows")), keys, hot_rows)


def find_hot_of_many(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> HotGroups:
    """``find_hot`` for keys with about as many values as rows, such as ids: only those of crowded buckets are counted.

    Rows are counted per hash bucket first, which each task sums to at most ``BUCKETS`` rows. A bucket that
    is not hot holds no hot group, and rarely is one hot.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    counted = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_rows"))
    crowded = [r[0] for r in counted.filter(F.col("_rows") > hot_rows).collect()]
    if not crowded:
        return HotGroups(keys, 0, hot_rows, None)
    some = known_table(df.sparkSession, [(b,) for b in crowded], "_bucket bigint")
    found = df.select(*keys, bucket.alias("_bucket")).join(F.broadcast(some), "_bucket", "left_semi")
    return find_hot(found, keys, hot_rows)


def hot_among(sizes: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> HotGroups:
    """Hot groups of a frame whose group sizes are known: one row per group with ``_rows``."""
    hot = sizes.filter(F.col("_rows") > hot_rows)
    total = hot.agg(F.sum("_rows")).first()[0]
    frame = None if total is None else durable(hot.select(*keys))
    return HotGroups(keys, total or 0, hot_rows, frame)


def _small(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast a frame of at most ``most_rows`` rows if that is few; else Spark chooses."""
    return F.broadcast(df) if most_rows <= BROADCAST_ROWS else df


def parted(df: DataFrame, hot: HotGroups) -> tuple[DataFrame, DataFrame]:
    """(rows of groups that are not hot, rows of hot ones); there must be hot ones."""
    hot_keys = _small(hot.frame, hot.total_rows // hot.hot_rows)
    return null_safe_join(df, hot_keys, hot.keys, "left_anti"), null_safe_join(df, hot_keys, hot.keys, "left_semi")


def running(
    df: DataFrame, keys: list[str], order: list[str], outs: dict[str, Running], hot: Hot = HOT_ROWS
) -> DataFrame:
    """Add the running columns ``outs`` to ``df``; ``order`` must be total.

    ``hot`` is the number of rows above which a group is hot, measured on
    ``df``, or a measurement made before on coarser keys or on a frame with at
    least as many rows per group, to measure once for several passes.
    """
    if not isinstance(hot, HotGroups):
        hot = find_hot(df, keys, hot)
    if hot.frame is None:
        return _in_groups(df, keys, order, outs)
    cold_part, hot_part = parted(df, hot)
    slices = max(2, -(-2 * hot.total_rows // hot.hot_rows))
    return _in_groups(cold_part, keys, order, outs).unionByName(
        _in_slices(hot_part, keys, order, outs, slices)
    )


def _frame(keys, order, inclusive):
    return (
        Window.partitionBy(*keys).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )


def _in_groups(df, keys, order, outs):
    return df.withColumns(
        {name: r.over(_frame(keys, order, r.inclusive)) for name, r in outs.items()}
    )


def _in_slices(df, keys, order, outs, slices):
    # The slice number must not change between its two uses below, so the
    # sliced rows are written out once.
    sliced = durable(
        df.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    summaries = sliced.groupBy(*keys, "_slice").agg(
        *[r.summary(order).alias(f"_{name}") for name, r in outs.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    # At most one group of a slice goes on from the slice before it.
    carried = summaries.select(
        *keys, "_slice", F.count("*").over(earlier).alias("_earlier"),
        *[r.carried(f"_{name}", earlier).alias(f"_{name}") for name, r in outs.items()],
    ).filter("_earlier > 0").drop("_earlier")
    local = _in_groups(sliced, [*keys, "_slice"], order, outs)
    joined = null_safe_join(local, _small(carried, slices), [*keys, "_slice"], "left")
    return joined.withColumns(
        {name: r.combine(F.col(f"_{name}"), F.col(name)) for name, r in outs.items()}
    ).drop("_slice", *[f"_{name}" for name in outs])
