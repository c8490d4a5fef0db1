"""Small helpers the corpus operators share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

ROW = "_row"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: compressed, and of a size that Spark knows."""
    place = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def release(spark: SparkSession) -> None:
    """Let shuffle files go that no plan needs any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Rows and bytes of an Arrow batch between Spark and Python: batches of whole texts by Spark's own 10,000 rows take
# hundreds of megabytes outside the heap, and an executor keeps them from one stage to the next.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, where they are as Spark sets them."""
    for name, default, most in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def boxed(df: DataFrame) -> DataFrame:
    """The whole row as one struct column, so that no working column can clash with its own."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(ROW))


def unboxed(df: DataFrame, columns: list[str], new: dict) -> DataFrame:
    """The boxed row's columns, then the new ones; a new one replaces an old one of its name."""
    old = [F.col(f"{ROW}.`{c}`").alias(c) for c in columns if c not in new]
    return df.select(*old, *[expr.alias(name) for name, expr in new.items()])


def field(name: str):
    """A column of the boxed row."""
    return F.col(f"{ROW}.`{name}`")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(df: DataFrame, column) -> int:
    """UTF-8 bytes of a text column, all rows together."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def blocks_for(total_bytes: int, block_bytes: int) -> int:
    return max(1, -(-total_bytes // block_bytes))
