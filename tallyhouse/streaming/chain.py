"""The metering job from events to budgets as a chain of streams over files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.budget import cost_movements
from ..operators.cleaning import filter_billable, normalize_models, scope_tenant
from ..operators.pricing import price_events
from ..sources.catalog import Catalog
from .sinks import write_windows
from .state import budget_stream, stamp_volume_batches
from .windows import dedup_within_stream, usage_windows_stream, with_event_time


def run_metering(events: DataFrame, budgets: DataFrame, catalog: Catalog, path: str, order: list[str]) -> None:
    """Take up what is new in ``events`` and carry it through to budgets and alerts.

    Three streams, each with its own checkpoint and each reading what the one before has written:

    * billable events with normalised names, duplicates dropped, stamped with their month's volume
      per micro-batch, in ``order`` (``path/volume/events``);
    * tiered prices and closed 10 s windows (``path/windows``);
    * balances, debts and alerts of ``budgets`` (a stream of movements) charged with the windows (``path/ledger``).

    Returns when all of it is done; run it again when more has come. After a failure the same call goes on where
    each stream had got to. A stream starts only when the one before has ended, so it never
    sees a folder that a repeated batch is still to overwrite.
    """
    spark = events.sparkSession
    clean = normalize_models(scope_tenant(filter_billable(events)), catalog)
    kept = dedup_within_stream(with_event_time(clean))
    stamp_volume_batches(kept, order, f"{path}/volume", f"{path}/checkpoints/volume").awaitTermination()

    def written(name: str) -> DataFrame:
        """A folder of batches as a stream."""
        schema = spark.read.parquet(f"{path}/{name}").drop("batch_id").schema
        return spark.readStream.schema(schema).parquet(f"{path}/{name}/batch_id=*")

    priced = price_events(with_event_time(written("volume/events")), catalog, "volume_before")
    write_windows(usage_windows_stream(priced), f"{path}/windows", f"{path}/checkpoints/windows").awaitTermination()
    moves = cost_movements(written("windows")).unionByName(budgets)
    write_windows(budget_stream(moves), f"{path}/ledger", f"{path}/checkpoints/ledger").awaitTermination()
