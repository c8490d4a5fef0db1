"""From raw documents to packed training sequences.

Each stage takes (spark, docs, folder of tables) and works on all rows it is given; all
but the last return the columns of ``documents``. Nulls, empty texts, repeated rows, empty
tables and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.frames import small_batches
from tallyhouse.llm.language import fit, identify
from tallyhouse.llm.leaks import without_leaks
from tallyhouse.llm.nearcopies import one_of_each
from tallyhouse.llm.packing import pack
from tallyhouse.llm.repeats import cut_repeats
from tallyhouse.session import shared_folder


def _unused(docs: DataFrame, n: int) -> tuple[str, ...]:
    """Names that no column of the documents has."""
    free = (name for name in (f"_{i}" for i in range(len(docs.columns) + n)) if name not in docs.columns)
    return tuple(next(free) for _ in range(n))


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a language that the model knows; ``lang`` stays as declared."""
    small_batches(spark)
    names = _unused(docs, 3)
    judged = identify(docs, fit(docs), names=names)
    return judged.filter(F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without passages that repeat; a text that loses nothing stays as it is.

    A document of which no word is left goes; one that had none stays.
    """
    small_batches(spark)
    n_words, n_removed, kept = names = _unused(docs, 3)
    cut = cut_repeats(docs, names=names).filter((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_words)))
    changed = F.col(n_removed) > 0
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text")), "n_chars": F.when(changed, F.length(kept)).otherwise(F.col("n_chars"))}
    return cut.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return without_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Place of each piece of each document in a sequence of 2048 tokens."""
    small_batches(spark)
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Language models, edit distances and the packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each stage written to the shared folder and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    place = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if n + 1 < len(STAGES):
            docs.write.parquet(f"{place}/{name}")
            docs = spark.read.parquet(f"{place}/{name}")
    return docs
