"""Raw events taken in from a stream: good ones and rejected ones from one read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import event_errors
from ..schema import USAGE_EVENTS
from ..sources.events import parse_events

ACCEPTED, REJECTED = "accepted", "rejected"


def intake_stream(raw: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Decode and check the ``value`` text of each row and keep both outcomes.

    A micro-batch is parsed once and written by one job, with a folder for each outcome
    (``path/batch_id=N/outcome=...``), so one output is never there without the other, and a repeated
    batch overwrites both. Text that is no JSON event has the error ``json``; an event that breaks the
    schema's rules has theirs. Rejected rows keep their text, accepted ones their fields; other columns
    of the source (topic, partition, offset) stay with both.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_events(batch)
        errors = F.when(F.col("_broken"), F.array(F.lit("json"))).otherwise(event_errors())
        bad = F.size("errors") > 0
        fields = [f.name for f in USAGE_EVENTS if f.name in parsed.columns]
        marked = parsed.withColumn("errors", errors).withColumns(
            {
                "outcome": F.when(bad, REJECTED).otherwise(ACCEPTED),
                "value": F.when(bad, F.col("value")),
                **{c: F.when(~bad, F.col(c)) for c in fields},
            }
        )
        marked.drop("_broken").write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/batch_id={batch_id}")

    return (
        raw.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_intake(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted events, rejected rows with ``errors``) so far; readers open the folders of their outcome only."""
    rows = spark.read.parquet(path)
    fields = [f.name for f in USAGE_EVENTS if f.name in rows.columns]
    accepted = rows.filter(F.col("outcome") == ACCEPTED).drop("outcome", "batch_id", "errors", "value")
    return accepted, rows.filter(F.col("outcome") == REJECTED).drop("outcome", "batch_id", *fields)
