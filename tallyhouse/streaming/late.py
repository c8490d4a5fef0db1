"""Late events: the split, and replay of what was set aside."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.running import HOT_ROWS, Running, running
from .windows import DELAY_MS, window_end


def split_late(
    df: DataFrame,
    width_ms: int = 10_000,
    delay_ms: int = DELAY_MS,
    high_water: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(on time, late) by arrival order within each source partition.

    ``df`` has ``source_partition`` and ``arrival_seq``. An event is late when
    its window had ended by the watermark of the events before it: the newest
    event time so far less ``delay_ms``. ``high_water`` carries the newest
    time of earlier batches: ``source_partition, newest_ms``.
    """
    marked = running(
        df, ["source_partition"], ["arrival_seq"],
        {"_newest": Running("max", "ts_ms", inclusive=False)}, hot_rows,
    )
    if high_water is not None:
        marked = marked.join(high_water, "source_partition", "left").withColumn(
            "_newest", F.greatest("_newest", "newest_ms")
        ).drop("newest_ms")
    marked = marked.withColumn(
        "_late", F.coalesce(window_end(width_ms) <= F.col("_newest") - delay_ms, F.lit(False))
    ).drop("_newest")
    return marked.filter(~F.col("_late")).drop("_late"), marked.filter("_late").drop("_late")


def split_late_stream(
    stream: DataFrame, path: str, checkpoint: str, width_ms: int = 10_000,
    delay_ms: int = DELAY_MS, trigger: dict | None = None,
) -> StreamingQuery:
    """Write a stream to ``path/on_time`` and ``path/late``.

    Each micro-batch overwrites its own folders, so a repeated batch leaves
    the same rows. The newest time per source partition is stored per batch.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        before = None
        if batch_id > 0:
            before = spark.read.parquet(f"{path}/high_water/batch_id={batch_id - 1}")
        on_time, late = split_late(batch, width_ms, delay_ms, before)
        on_time.write.mode("overwrite").parquet(f"{path}/on_time/batch_id={batch_id}")
        late.write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        newest = batch.groupBy("source_partition").agg(F.max("ts_ms").alias("newest_ms"))
        if before is not None:
            newest = newest.unionByName(before).groupBy("source_partition").agg(
                F.max("newest_ms").alias("newest_ms")
            )
        newest.write.mode("overwrite").parquet(f"{path}/high_water/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def replayable(dlq: DataFrame, applied: DataFrame, max_rows: int = 0) -> DataFrame:
    """Set-aside events that are not applied yet, oldest first up to ``max_rows``.

    Of the copies of one id the first to arrive is replayed. Events without an id
    cannot be recognised and are always replayed.
    """
    nth = F.row_number().over(Window.partitionBy("event_id").orderBy("arrival_seq"))
    named = dlq.filter("event_id IS NOT NULL").withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
    waiting = named.join(applied.select("event_id").distinct(), "event_id", "left_anti").select(*dlq.columns)
    waiting = waiting.unionByName(dlq.filter("event_id IS NULL"))
    return waiting.orderBy("arrival_seq").limit(max_rows) if max_rows else waiting


def replay_dlq(
    spark: SparkSession, dlq_path: str, target_path: str, max_rows: int = 0, dry_run: bool = False
) -> int:
    """Add set-aside events to the target table, each replay in a folder of its own; returns how many."""
    dlq = spark.read.parquet(dlq_path).drop("batch_id")
    target = spark.read.parquet(target_path)
    chosen = replayable(dlq, target, max_rows)
    if dry_run:
        return chosen.count()
    folder = f"{target_path}/batch_id=-{time.time_ns()}"
    chosen.write.parquet(folder)
    return spark.read.schema(chosen.schema).parquet(folder).count()
