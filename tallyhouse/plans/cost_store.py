"""Cost tables kept by month, of which only the months with new events are made again.

Volume tiers start anew each month and dedup windows never reach over one, so a month's prices and
costs depend on that month's events alone. Events land in a folder per month and batch; a batch that
is landed again replaces its own folders. ``refresh`` reads all events of the months it is given,
late ones among them, prices them and replaces these months' partitions of each table by dynamic
partition overwrite; the files of all other months stay as they are. A refresh that is cut off is mended
by the same refresh. Readers filter by ``period`` and open the folders of their months only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import billing_month
from ..schema import CUSTOMER
from ..sources.catalog import Catalog
from .metering import cost_tables, priced_usage

PERIOD = "period"
# Months of which a task that lands events keeps a file open; if it meets more, Spark sorts the rest.
OPEN_MONTHS = 200
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
# Tasks per core that land events or price them: each writes a file per month, so more tasks would only write smaller files.
WRITE_TASKS_PER_CORE = 2
# Bytes that an open file gathers in memory before it writes them.
OPEN_FILE_BYTES = 4 << 20


def _in(periods: list[str | None]) -> Column:
    named = [p for p in periods if p is not None]
    chosen = F.col(PERIOD).isin(*named) if named else F.lit(False)
    return chosen | F.col(PERIOD).isNull() if None in periods else chosen


@dataclass(frozen=True)
class CostStore:
    """Landed events, priced events and cost tables under one folder, each partitioned by month."""

    spark: SparkSession
    path: str

    def _replace(self, df: DataFrame, name: str, *by: str, deal: bool = True) -> None:
        # Rebalancing deals a month to tasks as a whole, but a large one to several. Without it each task writes its own
        # file per month, without a shuffle or a sort; ``df`` then has to come in few tasks (``_tasks``).
        rows = df.hint("rebalance", *[F.col(c) for c in by]) if deal else df
        before = self.spark.conf.get(_OPEN_FILES)
        if not deal:
            self.spark.conf.set(_OPEN_FILES, OPEN_MONTHS)
        try:
            writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer = writer if deal else writer.option("parquet.block.size", OPEN_FILE_BYTES)
            writer.partitionBy(*by).parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.set(_OPEN_FILES, before)

    def _tasks(self) -> int:
        return WRITE_TASKS_PER_CORE * self.spark.sparkContext.defaultParallelism

    def read(self, name: str) -> DataFrame:
        """A table; its months are text, whatever Spark would take their names for."""
        place = f"{self.path}/{name}"
        found = self.spark.read.parquet(place).schema
        text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in (PERIOD, "batch") else f for f in found])
        return self.spark.read.schema(text).parquet(place)

    def land(self, events: DataFrame, batch: str) -> list[str | None]:
        """Keep a batch of events; the months it touches (None: events without a time)."""
        named = events.withColumns({PERIOD: billing_month(F.col("ts_ms")), "batch": F.lit(batch)})
        # All events at full width: no shuffle for the files.
        self._replace(named.coalesce(self._tasks()), "events", PERIOD, "batch", deal=False)
        landed = self.spark.read.schema(named.schema).parquet(f"{self.path}/events")  # there may be no file yet
        touched = landed.filter(F.col("batch") == batch).select(PERIOD).distinct()
        return [r[0] for r in touched.collect()]  # one row per month

    def refresh(self, catalog: Catalog, periods: list[str | None], carry: tuple[str, ...] = ("metadata",)) -> None:
        """Make the named months of every table again from their landed events."""
        if not periods:
            return
        events = self.read("events").filter(_in(periods)).drop(PERIOD, "batch")
        priced = priced_usage(events, catalog, carry, tasks=self._tasks())
        # As many rows as events: the shuffle of the dedup is the last.
        self._replace(priced.withColumn(PERIOD, billing_month(F.col("ts_ms"))), "priced", PERIOD, deal=False)
        kept = self.read("priced").filter(_in(periods)).drop(PERIOD)
        for name, table in cost_tables(kept).items():
            if name != "customer_costs":  # sums of model_costs
                self._replace(table if PERIOD in table.columns else table.withColumn(PERIOD, F.substring("day", 1, 7)), name, PERIOD)

    def add(self, events: DataFrame, batch: str, catalog: Catalog) -> list[str | None]:
        """Land a batch and bring the months it touches up to date."""
        touched = self.land(events, batch)
        self.refresh(catalog, touched)
        return touched

    def tables(self) -> dict[str, DataFrame]:
        """The cost tables as intelligence reads them; there has to have been a refresh."""
        by_model = self.read("model_costs")
        return {
            "model_costs": by_model,
            "customer_costs": by_model.groupBy(*CUSTOMER, PERIOD).agg(F.sum("cost_micro").alias("cost_micro")),
            "dim_costs": self.read("dim_costs").filter("period IS NOT NULL"),
            "daily": self.read("daily"),
        }
