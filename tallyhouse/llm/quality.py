"""Document quality by hierarchical empirical Bayes.

A text classifier (naive Bayes over byte trigrams, calibrated by logistic regression on
labels it has not seen) gives each document a probability of being good. Grouped
aggregation sums them by host and by path; how much hosts, and paths within a host, differ
beyond chance (method of moments) sets how strongly a sparse one is shrunk towards the level
above. A document's odds are its text's odds, moved from the global rate to the posterior rate of
its path, its own probability left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .frames import ROW, boxed, field, unboxed
from .grams import FEATURES, features, log_shares
from .words import in_slices

FIT_LABELS = 20_000
LIMIT = 0.5


@dataclass(frozen=True)
class Classifier:
    """Evidence per trigram feature, and the calibration of a text's mean."""

    weights: np.ndarray
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        f = features(text, letters_only=False)
        return float(self.weights[f].mean()) if len(f) else 0.0

    def probability(self, texts) -> np.ndarray:
        x = self.slope * np.array([self.score(t) for t in texts]) + self.shift
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _counts(batches):
    for batch in in_slices(batches, ["text"]):
        sums = np.zeros((2, FEATURES), np.int64)
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            f = features(text, letters_only=False)
            if len(f):
                sums[label] += np.bincount(f, minlength=FEATURES)
        for label in (0, 1):
            on = np.flatnonzero(sums[label])
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), label, np.int32)), pa.array(on, pa.int32()), pa.array(sums[label][on])], ["label", "feature", "n"])


def calibrated(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one variable, by Newton steps with a weak ridge."""
    x = np.stack([scores, np.ones(len(scores))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(h, x.T @ (labels - p) - 1e-3 * w)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", bound: int = FIT_LABELS) -> Classifier:
    """Fit on about ``bound`` labelled documents (chosen by a hash of the key): four fifths for the weights, one for the calibration.

    Labels other than 0 and 1 and null keys are left out. Without labels of both kinds, every text has probability one half.
    """
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).filter("label in (0, 1) and id is not null").distinct()
    every = max(1, -(-known.count() // bound))
    part = known.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)))
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(part), "id")  # about ``bound`` rows
    counted = chosen.filter("fold > 0").select("label", "text").mapInArrow(_counts, "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    table = np.zeros((2, FEATURES))
    for r in counted.toPandas().itertuples():  # at most 2 * FEATURES rows
        table[r.label, r.feature] = r.n
    if not table.any(axis=1).all():
        return Classifier(np.zeros(FEATURES, np.float32), 0.0, 0.0)
    logs = log_shares(table)
    first = Classifier(logs[1] - logs[0], 1.0, 0.0)
    score = F.pandas_udf(lambda t: pd.Series([first.score(x) for x in t]), "double")
    held = chosen.filter("fold = 0").select("label", score("text").alias("score")).toPandas()  # about bound / 5 rows
    if held["label"].nunique() < 2:
        return first
    return Classifier(first.weights, *calibrated(held["score"].to_numpy(), held["label"].to_numpy(float)))


def _sums(model: Classifier):
    def run(batches):
        for batch in in_slices(batches, ["text"]):
            p = model.probability(batch.column("text").to_pylist())
            sums: dict[tuple, list] = {}
            for h, q, x in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), p.tolist()):
                s = sums.setdefault((h, q), [0.0, 0.0, 0])
                s[0] += x
                s[1] += x * x
                s[2] += 1
            if sums:
                (h, q), (a, b, n) = zip(*sums), zip(*sums.values())
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(q), pa.array(a), pa.array(b), pa.array(n)], ["host", "path", "s", "ss", "n"])

    return run


def strength(groups: DataFrame, sums: str, squares: str, counts: str, parent: str) -> float:
    """Documents that the level above counts for: spread within groups over the spread between them.

    One aggregated row; between 1 and 10,000, and 10,000 if groups differ no more than chance would have them.
    """
    n, mean = F.col(counts), F.col(sums) / F.col(counts)
    r = groups.agg(
        F.sum(F.col(squares) - n * mean * mean).alias("within"), F.sum(n - 1).alias("free"),
        F.sum(n * (mean - F.col(parent)) ** 2).alias("between"), F.count("*").alias("groups"), F.sum(n).alias("n"),
    ).first()
    if not r["n"]:
        return 1.0
    inside = r["within"] / max(1, r["free"])
    apart = (r["between"] - r["groups"] * inside) / r["n"]
    return float(min(1e4, max(1.0, inside / apart))) if apart > 0 else 1e4


def rate(
    docs: DataFrame,
    model: Classifier,
    text: str = "text",
    host: str = "source",
    path: str | None = "lang",
) -> DataFrame:
    """Documents with ``text_quality``, ``site_quality`` (posterior rate of the path), ``quality`` and ``good``.

    A null or empty text is no evidence: its quality is that of its path. Null hosts share one
    host, null paths one path of their host. Repeated rows get equal results; columns named
    like the new ones are replaced.
    """
    spark, rows = docs.sparkSession, boxed(docs)
    name = lambda c: F.coalesce(field(c).cast("string"), F.lit("")) if c else F.lit("")
    work = rows.withColumns({"text": field(text).cast("string"), "host": name(host), "path": name(path)})
    place = f"{shared_folder(spark).rstrip('/')}/quality-{uuid.uuid4().hex}"
    sums = work.select("text", "host", "path").mapInArrow(_sums(model), "host string, path string, s double, ss double, n long")
    sums.groupBy("host", "path").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n")).write.parquet(f"{place}/paths")
    paths = spark.read.parquet(f"{place}/paths")
    whole = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    world = (whole["s"] + 0.5) / (whole["n"] + 1.0) if whole["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("ss").alias("hss"), F.sum("n").alias("hn"))
    above_host = strength(hosts.withColumn("world", F.lit(world)), "hs", "hss", "hn", "world")
    hosts = hosts.withColumn("host_rate", (F.col("hs") + above_host * world) / (F.col("hn") + above_host))
    joined = paths.join(hosts, "host")
    above_path = strength(joined, "s", "ss", "n", "host_rate")
    joined.select("host", "path", "s", "n", "host_rate").write.parquet(f"{place}/rates")
    rates = spark.read.parquet(f"{place}/rates")  # its size is known: broadcast only if small
    chance = F.pandas_udf(lambda t: pd.Series(model.probability(t.tolist())), "double")
    odds = lambda p: F.log(p / (1 - p))
    seen = work.join(rates, ["host", "path"]).withColumn("own", chance("text"))
    blank = F.coalesce(F.length("text"), F.lit(0)) == 0
    site = (F.greatest(F.col("s") - F.col("own"), F.lit(0.0)) + above_path * F.col("host_rate")) / (F.col("n") - 1 + above_path)
    seen = seen.withColumn("site", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), site)))
    sum_of = odds(F.col("own")) - odds(F.lit(world)) + odds(F.col("site"))
    quality = F.when(blank, F.col("site")).otherwise(1 / (1 + F.exp(-sum_of)))
    seen = seen.withColumn("quality", quality)
    return unboxed(
        seen.select(ROW, "own", "site", "quality"), docs.columns,
        {"text_quality": F.col("own"), "site_quality": F.col("site"), "quality": F.col("quality"), "good": F.col("quality") >= LIMIT},
    )
