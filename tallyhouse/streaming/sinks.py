"""Idempotent stream sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import ROLLUP_MEASURES, usage_rollup
from ..schema import CUSTOMER
from .merged import MERGE_EVERY, MergedSums


def write_windows(
    windows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "append"
) -> StreamingQuery:
    """Write closed windows exactly once: a repeated batch overwrites its folder. Counters that change need ``mode="update"``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        windows.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _rollup(spark: SparkSession, path: str, every: int = MERGE_EVERY) -> MergedSums:
    return MergedSums(spark, path, [*CUSTOMER, "grain", "bucket"], list(ROLLUP_MEASURES), every)


def rollup_stream(
    priced: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, merge_every: int = MERGE_EVERY
) -> StreamingQuery:
    """Add each micro-batch to the minute, day and month rollup, every 60 seconds by default.

    A batch stores its own sums, and every ``merge_every`` batches they are merged; ``read_rollup`` adds them up.
    """
    kept = _rollup(priced.sparkSession, path, merge_every)
    return (
        priced.writeStream.foreachBatch(lambda batch, n: kept.add(usage_rollup(batch), n))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The rollup so far; there has to have been a batch."""
    return _rollup(spark, path).read()
