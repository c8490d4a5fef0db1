"""Language identification by Bayesian evidence fusion.

Four kinds of evidence: the likelihood of the text's byte trigrams under each language; the
language the document declares, through P(declared | language); and, as the prior, its host,
shrunk towards its address suffix, which is shrunk towards all documents. The prior and
the declaration table are sums of text posteriors over the whole corpus, by grouped
aggregation; a document's own share is taken out of its host's. "None of these" is a
hypothesis of its own, under which every trigram is equally likely.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .frames import ROW, boxed, field, unboxed
from .grams import FEATURES, features, log_shares
from .words import in_slices

FIT_DOCUMENTS = 20_000  # per declared language
LEAST_SHARE = 1e-16  # a text's posterior below it is lost in the rounding of any sum
NONE, NONE_PRIOR = "und", 0.01
OVERLAP = 3.0  # a byte is in three trigrams: their evidence is divided by that
STRENGTH = 5.0  # documents that a prior one level up counts for
SURE = 0.5


@dataclass(frozen=True)
class Model:
    """Log shares of trigrams per language."""

    languages: tuple[str, ...]
    logs: np.ndarray

    def evidence(self, texts) -> np.ndarray:
        """Log likelihood of each text per language, and last under "none of these"; zeros if there is no letter."""
        out = np.zeros((len(texts), len(self.languages) + 1))
        for i, text in enumerate(texts):
            f = features(text, letters_only=True)
            if len(f):
                seen = np.bincount(f, minlength=FEATURES)
                on = np.flatnonzero(seen)
                out[i, :-1] = self.logs[:, on] @ seen[on]
                out[i, -1] = -len(f) * np.log(FEATURES)
        return out / OVERLAP


def code(column: Column) -> Column:
    """A declared language's primary subtag, lower-cased; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(column.cast("string"))), "^([a-z]{2,8})(?:[-_].*)?$", 1), F.lit(""))


def _counts(batches):
    for batch in in_slices(batches, ["text"]):
        parts: dict[int, list[np.ndarray]] = {}
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            f = features(text, letters_only=True)
            if len(f):
                parts.setdefault(label, []).append(f)
        for label, part in parts.items():
            on, n = np.unique(np.concatenate(part), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), label, np.int32)), pa.array(on, pa.int32()), pa.array(n, pa.int64())], ["label", "feature", "n"])


def fit(docs: DataFrame, text: str = "text", label: str = "lang", bound: int = FIT_DOCUMENTS) -> Model:
    """Trigram shares of every declared language, however rare.

    The labels of all documents are counted. Of a label with more than ``bound`` different texts
    about ``bound`` are read, chosen by a hash of the text and always with the least hash;
    of every other label all. Labels without a letter in any of their texts have no model.
    """
    rows = docs.select(code(F.col(f"`{label}`")).alias("label"), F.col(f"`{text}`").cast("string").alias("text")).filter("label != '' and text is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    labels = rows.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("texts"), F.min("hash").alias("least")).orderBy("label").collect()
    steps = 1 << 30
    # approx_count_distinct errs by several percent, so a label with at most ``bound`` rows is told by their number.
    shares = [(i, r["label"], r["least"], steps if r["n"] <= bound else -(-steps * bound // max(bound, r["texts"]))) for i, r in enumerate(labels)]
    rates = docs.sparkSession.createDataFrame(shares, "number int, label string, least long, share long")
    part = rows.join(F.broadcast(rates), "label").filter((F.pmod("hash", F.lit(steps)) < F.col("share")) | (F.col("hash") == F.col("least")))
    counted = part.select(F.col("number").alias("label"), "text").mapInArrow(_counts, "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most FEATURES rows per language, 16 bytes each
    numbers, at = np.unique(got.column("label").to_numpy(), return_inverse=True)
    table = np.zeros((len(numbers), FEATURES))
    table[at, got.column("feature").to_numpy()] = got.column("n").to_numpy()
    return Model(tuple(labels[i]["label"] for i in numbers), log_shares(table) if len(numbers) else np.zeros((0, FEATURES), np.float32))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _start(n: int) -> np.ndarray:
    return np.append(np.full(n, (1 - NONE_PRIOR) / max(n, 1)), NONE_PRIOR)


def _shares(model: Model):
    """Sums of text posteriors by host, suffix and declared language, added up within each batch."""

    def run(batches):
        prior = np.log(_start(len(model.languages)))
        for batch in in_slices(batches, ["text"]):
            posterior = _softmax(model.evidence(batch.column("text").to_pylist()) + prior)
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("host", "suffix", "declared"))))
            sums: dict[tuple, np.ndarray] = {}
            for k, p in zip(keys, posterior):
                sums[k] = sums[k] + p if k in sums else p.copy()
            rows = [(*k, i, p[i]) for k, p in sums.items() for i in np.flatnonzero(p > LEAST_SHARE).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["host", "suffix", "declared", "language", "n"])

    return run


def suffix_of(host: Column) -> Column:
    """The last label of a host's name; empty if it has no dot."""
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def host_of(address: Column) -> Column:
    """The host of an address with ``://``, else the whole, lower-cased; empty for null."""
    whole = F.lower(F.coalesce(address.cast("string"), F.lit("")))
    return F.when(F.instr(whole, "://") > 0, F.regexp_extract(whole, r"^.*?://([^/?#]*)", 1)).otherwise(whole)


def priors(shares: DataFrame, n: int) -> DataFrame:
    """(host, counts, prior): text posteriors summed per host, and the shrunk share of each language on the host's suffix."""
    def level(*keys):
        sums = shares.groupBy(*keys, "language").agg(F.sum("n").alias("n"))
        return sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("n"))

    vector = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("n")[i.cast("long")], F.lit(0.0)))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    total = level().select(vector.alias("all"))
    uniform = F.array(*[F.lit(float(x)) for x in _start(n - 1)])
    world = total.select(F.zip_with("all", uniform, lambda x, u: (x + STRENGTH * u) / (add(F.col("all")) + STRENGTH)).alias("world"))
    world = world.first()
    world = F.array(*[F.lit(float(x)) for x in (world[0] if world else _start(n - 1))])
    by_suffix = level("suffix").withColumn("v", vector)
    by_suffix = by_suffix.select("suffix", F.zip_with("v", world, lambda x, w: (x + STRENGTH * w) / (add(F.col("v")) + STRENGTH)).alias("prior"))
    by_host = level("host", "suffix").select("host", "suffix", vector.alias("counts"))
    return by_host.join(by_suffix, "suffix").select("host", "counts", "prior")


def _declared_logs(shares: DataFrame, model: Model) -> dict[str, list[float]]:
    """log P(declared | language) for the model's languages, "other" under ``*``; a bounded table."""
    known = F.when(F.col("declared").isin(*model.languages), F.col("declared")).otherwise("*")
    rows = shares.filter("declared != ''").groupBy(known.alias("declared"), "language").agg(F.sum("n").alias("n")).collect()
    names = [*model.languages, "*"]
    table = np.full((len(names), len(model.languages) + 1), 1.0)
    for i in range(len(model.languages)):
        table[i, i] += 1.0
    for r in rows:
        table[names.index(r["declared"]), r["language"]] += r["n"]
    logs = np.log(table / table.sum(axis=0))
    return {name: logs[i].tolist() for i, name in enumerate(names)}


def identify(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    declared: str | None = "lang",
    address: str | None = "source",
    names: tuple[str, str, str] = ("language", "confidence", "accepted"),
) -> DataFrame:
    """Documents with ``language``, ``confidence`` (its posterior) and ``accepted``, or so named.

    Rejected are documents whose best hypothesis is ``und`` or less likely than one half, and
    those without a letter (null and empty texts too): they are ``und`` with confidence 0.
    A null or unreadable declaration and a null address are no evidence; null addresses
    share one host. Repeated rows get equal results; columns named like the new ones are
    replaced. ``declared`` and ``address`` may be None.
    """
    rows = boxed(docs)
    host = host_of(field(address)) if address else F.lit("")
    said = code(field(declared)) if declared else F.lit("")
    work = rows.withColumns({"host": host, "declared": said}).withColumn("suffix", suffix_of(F.col("host")))
    whole = field(text).cast("string")
    n = len(model.languages) + 1
    parts = "host string, suffix string, declared string, language long, n double"
    place = f"{shared_folder(docs.sparkSession).rstrip('/')}/language-{uuid.uuid4().hex}"
    seen = work.select(whole.alias("text"), "host", "suffix", "declared").mapInArrow(_shares(model), parts)
    seen.groupBy("host", "suffix", "declared", "language").agg(F.sum("n").alias("n")).write.parquet(f"{place}/shares")
    shares = docs.sparkSession.read.parquet(f"{place}/shares")
    logs = _declared_logs(shares, model)
    # Written and read again, so that Spark knows the size and broadcasts the table only if it is small.
    priors(shares, n).write.parquet(f"{place}/priors")
    known = docs.sparkSession.read.parquet(f"{place}/priors")

    @F.pandas_udf("language string, confidence double")
    def judge(texts: pd.Series, said: pd.Series, counts: pd.Series, prior: pd.Series) -> pd.DataFrame:
        evidence = model.evidence(texts.tolist())
        own = _softmax(evidence + np.log(_start(n - 1)))
        others = np.maximum(np.stack(counts.tolist()) - own, 0)
        up = np.stack(prior.tolist())
        host_prior = (others + STRENGTH * up) / (others.sum(axis=1, keepdims=True) + STRENGTH)
        none = [0.0] * n
        spoken = np.array([logs.get(d, logs["*"]) if d else none for d in said])
        posterior = _softmax(evidence + np.log(host_prior) + spoken)
        best = posterior.argmax(axis=1)
        blank = ~evidence.any(axis=1)
        names = [*model.languages, NONE]
        return pd.DataFrame({"language": [NONE if x else names[b] for b, x in zip(best, blank)], "confidence": np.where(blank, 0.0, posterior[np.arange(len(best)), best])})

    judged = work.join(known, "host").withColumn("_judged", judge(whole, "declared", "counts", "prior"))
    accepted = (F.col("_judged.language") != NONE) & (F.col("_judged.confidence") >= SURE)
    return unboxed(judged.select(ROW, "_judged"), docs.columns, dict(zip(names, (F.col("_judged.language"), F.col("_judged.confidence"), accepted))))
