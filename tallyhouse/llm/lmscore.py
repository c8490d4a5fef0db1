"""Cross-entropy difference of documents under two matched n-gram models.

Tokens are bytes of the lower-cased text, so target and background share one vocabulary
of 256 symbols and a start symbol. Both models are built from the same table of n-grams that
all documents hold, with counts of either side, by interpolated Witten-Bell smoothing
from order 0 up. The loss difference of a token, target loss minus background loss, is
then a number per n-gram, and a document's score is the mean over its tokens: the lower, the
nearer to the target.

The n-gram table grows with the corpus. Its most frequent part, at most FREQUENT rows by
count, is sent to the tasks; n-grams outside it are joined by a shuffle, once per
document and n-gram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import durable
from .words import in_slices

ORDER = 4  # bytes in an n-gram; kept in 32 bits of a long
FREQUENT = 1 << 20
START = 0xFF  # never in UTF-8


def grams(text: str | None) -> np.ndarray:
    """The n-gram that ends at each byte, as numbers; start symbols stand before the text."""
    raw = (text or "").lower().encode("utf-8")
    if not raw:
        return np.zeros(0, np.int64)
    b = np.frombuffer(bytes([START] * (ORDER - 1)) + raw, np.uint8).astype(np.int64)
    out = np.zeros(len(raw), np.int64)
    for i in range(ORDER):
        out = (out << 8) | b[i : i + len(raw)]
    return out


def _counts(batches):
    total: dict = {0: [], 1: []}
    held = 0

    def out():
        for target in (0, 1):
            if total[target]:
                g, where = np.unique(np.concatenate([x for x, _ in total[target]]), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([y for _, y in total[target]])).astype(np.int64)
                for lo in range(0, len(g), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    k = len(g[part])
                    zero = np.zeros(k, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(g[part]), pa.array(n[part] if target else zero), pa.array(n[part])], ["gram", "target", "background"])
                total[target].clear()

    for batch in in_slices(batches, ["text"], 2 << 20):
        side = np.asarray(batch.column("target").to_pylist(), bool)
        texts = batch.column("text").to_pylist()
        for target in (0, 1):
            some = [grams(t) for t, s in zip(texts, side) if s == bool(target)]
            if some:
                g, n = np.unique(np.concatenate(some), return_counts=True)
                total[target].append((g, n))
                held += len(g)
        if held > 1_000_000:
            yield from out()
            held = 0
    yield from out()


def losses(counts: DataFrame) -> DataFrame:
    """(gram, difference) from (gram, target, background) counts: target loss minus background loss, in nats."""
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):  # the n-gram without its first bytes
        short = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        levels.append(levels[-1].groupBy(short.alias("gram")).agg(F.sum("target").alias("target"), F.sum("background").alias("background")))
    below = None
    for k, level in enumerate(reversed(levels), 1):
        context = Window.partitionBy(F.shiftright("gram", 8))
        known = level.withColumn("lower", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)))
        for side in ("target", "background"):
            known = known.withColumns({f"{side}_n": F.sum(side).over(context), f"{side}_types": F.count(F.when(F.col(side) > 0, 1)).over(context)})
        if below is None:
            known = known.withColumns({f"{side}_p0": F.lit(1 / 256) for side in ("target", "background")})
        else:
            known = known.join(below, "lower")
        p = {
            f"{side}_p": F.when(F.col(f"{side}_n") > 0, (F.col(side) + F.col(f"{side}_types") * F.col(f"{side}_p0")) / (F.col(f"{side}_n") + F.col(f"{side}_types"))).otherwise(F.col(f"{side}_p0"))
            for side in ("target", "background")
        }
        known = known.withColumns(p)
        below = known.select(F.col("gram").alias("lower"), F.col("target_p").alias("target_p0"), F.col("background_p").alias("background_p0"))
    return known.select("gram", (F.log("background_p") - F.log("target_p")).alias("difference"), F.col("background").alias("n"))


def _frequent(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The n-grams that occur at least ``least`` times, in order, their differences, and ``least``: the smallest power of 2**(1/4) that leaves at most ``most`` of them."""
    step = F.floor(F.log2("n") * 4).cast("int")
    sizes = {r["step"]: r["grams"] for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("grams")).collect()}  # at most 256 rows
    held, lowest = 0, max(sizes, default=0) + 1
    for s in sorted(sizes, reverse=True):
        if held + sizes[s] > most:
            break
        held, lowest = held + sizes[s], s
    top = table.filter(step >= lowest).select("gram", F.col("difference").cast("float").alias("difference")).toPandas().sort_values("gram")
    return top["gram"].to_numpy(np.int64), top["difference"].to_numpy(np.float32), held


def _scores(known, values):
    def run(batches):
        for batch in in_slices(batches, ["text"], 2 << 20):
            sums, sizes, rare, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                g = grams(text)
                at = np.minimum(np.searchsorted(known.value, g), max(len(known.value) - 1, 0))
                found = known.value[at] == g if len(known.value) else np.zeros(len(g), bool)
                sums.append(float(values.value[at[found]].sum(dtype=np.float64)) if len(known.value) else 0.0)
                sizes.append(len(g))
                rest, n = np.unique(g[~found], return_counts=True)
                rare.append(rest)
                times.append(n)
            ends = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rare]))).astype(np.int32))
            lists = lambda parts: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(sums), pa.array(sizes, pa.int64()), lists(rare), lists(times)],
                ["id", "text_key", "known", "tokens", "rare", "times"],
            )

    return run


def cross_entropy_difference(
    docs: DataFrame, targets: DataFrame, text: str = "text", key: str = "doc_id", frequent: int = FREQUENT
) -> DataFrame:
    """One row per document: key, ``n_tokens``, ``score`` (nats per token; null without tokens).

    ``targets`` has the keys of target documents, in a column named like ``key``; the background
    is all documents. Without targets both models know nothing of each other's text and
    scores compare the background with even odds. A null or empty text has no tokens. Null
    keys are never targets. Rows that agree in key and text are reported each, with equal scores.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    chosen = targets.select(F.col(f"`{key}`").cast("long").alias("id")).filter("id is not null").distinct().withColumn("target", F.lit(True))
    # Target keys grow with the corpus: always a shuffle, so that no size changes the plan.
    marked = rows.join(chosen.hint("merge"), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counted = marked.mapInArrow(_counts, "gram long, target long, background long")
    counted = counted.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    table = durable(losses(durable(counted)))
    grams_, differences, _ = _frequent(table, frequent)
    known, values = spark.sparkContext.broadcast(grams_), spark.sparkContext.broadcast(differences)
    keyed = rows.withColumn("text_key", F.xxhash64("text", F.octet_length("text")))
    scored = keyed.mapInArrow(_scores(known, values), "id long, text_key long, known double, tokens long, rare array<long>, times array<long>")
    scored = durable(scored.withColumn("row", F.monotonically_increasing_id()))
    rest = scored.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    rest = rest.select("row", F.col("x.rare").alias("gram"), F.col("x.times").alias("times"))
    added = rest.join(table.select("gram", "difference"), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("difference")).alias("added"))
    total = scored.join(added, "row", "left").select(
        F.col("id").alias(key), F.col("tokens").alias("n_tokens"), ((F.col("known") + F.coalesce("added", F.lit(0.0))) / F.col("tokens")).alias("score")
    )
    return total.withColumn("score", F.when(F.col("n_tokens") > 0, F.col("score")))
