"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the bag of its byte n-grams (with marks for its ends) and itself, hashed to a fixed
number of embeddings; its vector is their mean, a text's vector the mean of its words', and a
linear softmax over it gives the two classes. Embeddings and softmax are trained jointly by
Adam steps in numpy on a bounded sample of labelled texts; at a few passes the embeddings that add
least to the odds are given up and the rest are trained on, which keeps a few hundred out of 2**18 and
the noise of common words out of long texts. A misspelling that no text had in training has
most of its vector in common with the word it comes from. A fifth of the sample calibrates the odds.
With two classes the score depends on the difference of the softmax columns only, so tasks get one
number per embedding: what its vector adds to the log odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .frames import ROW, boxed, field, unboxed
from .quality import calibrated
from .words import Words, in_slices, mix

FIT_LABELS, FIT_BYTES = 1_500, 1 << 17  # texts of each label in the sample, and bytes of a text there
BUCKETS, DIM, NGRAMS = 1 << 18, 4, (3, 4, 5, 6)
LEAST, LEAST_SHARE = 5, 0.01  # occurrences in texts that an embedding needs, and the same as a share of the texts
PASSES, BATCH, RATE, SOFTMAX = 16, 32, 0.1, 30.0
CUTOFFS = {4: 1 << 13, 6: 1 << 11, 8: 1 << 9}  # by pass: how many embeddings go on
LIMIT = 0.7
SLICE_BYTES, WORD_BYTES = 2 << 20, 1 << 18

# Upper case as lower case, other ASCII signs as blanks; bytes of other letters as they are.
_PLAIN = np.array([ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_PLAIN[128:] = np.arange(128, 256)


def plain(column) -> pa.LargeStringArray:
    """The texts in lower case and without ASCII signs, byte by byte."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    raw = _PLAIN[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(column), offsets, pa.py_buffer(raw.tobytes()), None, 0, column.offset)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all subwords of the words that lie in ``data`` at these places."""
    size = ends - starts + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(word)) - first[word]
    text = np.full(len(word), ord("<"), np.uint64)
    inner = (nth > 0) & (nth < size[word] - 1)
    text[inner] = data[starts[word[inner]] + nth[inner] - 1]
    text[nth == size[word] - 1] = ord(">")
    left = size[word] - nth  # bytes up to the word's end
    words, keys = [], []
    hashed = np.zeros(len(text), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        m = len(text) - n + 1
        if m <= 0:
            break
        hashed[:m] = hashed[:m] * np.uint64(0x100000001B3) + text[n - 1 :] + np.uint64(1)
        if n in NGRAMS:
            at = np.flatnonzero(left[:m] >= n)
            words.append(word[at])
            keys.append(mix(hashed[at] + np.uint64(n << 56)))
    power = np.cumprod(np.full(len(text) + 1, 0x9E3779B97F4A7C15, np.uint64)) if len(text) else np.zeros(1, np.uint64)
    whole = np.add.reduceat((text + np.uint64(7)) * power[nth], first) if len(first) else np.zeros(0, np.uint64)
    words.append(np.arange(len(size)))
    keys.append(mix(whole))
    return np.concatenate(words), (np.concatenate(keys) % np.uint64(BUCKETS)).astype(np.int64)


class Bags:
    """The distinct words of a column with their subwords, and how often each text has each word."""

    def __init__(self, column):
        words = Words(plain(column))
        self.n_texts = len(words.first) - 1
        self.n_words = np.diff(words.first)
        _, at, self.word = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.text = np.repeat(np.arange(self.n_texts), self.n_words)
        self.n_distinct = len(at)
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
        edges = np.searchsorted(np.cumsum(words.ends[at] - words.starts[at]), np.arange(0, len(words.data) + WORD_BYTES, WORD_BYTES), "right")
        for lo, hi in zip(edges, np.append(edges[1:], len(at))):  # a bounded number of bytes at once
            if hi > lo:
                word, bucket = subwords(words.data, words.starts[at[lo:hi]], words.ends[at[lo:hi]])
                parts.append(((word + lo).astype(np.int32), bucket.astype(np.int32)))
        self.sub_word, self.bucket = (np.concatenate([p[k] for p in parts]) for k in range(2))


@dataclass(frozen=True)
class Model:
    """What each embedding adds to the log odds of a word, and the odds without words."""

    weights: np.ndarray
    bias: float

    def odds(self, column) -> np.ndarray:
        """Log odds of label 1 for each text."""
        b = Bags(column)
        per = np.bincount(b.sub_word, minlength=b.n_distinct)
        word = np.bincount(b.sub_word, self.weights[b.bucket], b.n_distinct) / np.maximum(per, 1)
        mean = np.bincount(b.text, word[b.word], b.n_texts) / np.maximum(b.n_words, 1)
        return mean + self.bias

    def scores(self, column) -> np.ndarray:
        """Probability of label 1 for each text."""
        return 1 / (1 + np.exp(-np.clip(self.odds(column), -30, 30)))


class _Rows:
    """Numbers and weights of the members of each group; groups are taken by number."""

    def __init__(self, group, member, weight, n_groups):
        order = np.argsort(group, kind="stable")
        self.member, self.weight = member[order].astype(np.int32), weight[order].astype(np.float32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=n_groups))))

    def only(self, place: np.ndarray) -> _Rows:
        """With members renumbered, and left out where their new number is negative."""
        new = place[self.member]
        on = new >= 0
        group = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[on]
        return _Rows(group, new[on], self.weight[on], len(self.first) - 1)

    def take(self, groups):
        """(position in ``groups``, member, weight)."""
        count = self.first[groups + 1] - self.first[groups]
        of = np.repeat(np.arange(len(groups)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + self.first[groups][of]
        return of, self.member[at], self.weight[at]


def _sums(of, n, rows):
    """Sums of rows by group."""
    return np.stack([np.bincount(of, x, n) for x in rows.T], axis=1)


def train(column, labels: np.ndarray, share: np.ndarray, passes: int = PASSES, seed: int = 1) -> Model:
    """Embeddings and softmax from texts and their labels; ``share`` is each text's weight. Without both labels, no text says anything."""
    if len(set(labels.tolist())) < 2:
        odds = {0: -1.0, 1: 1.0}.get(int(labels[0]), 0.0) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), odds)
    b = Bags(column)
    key, times = np.unique(b.text * np.int64(b.n_distinct) + b.word, return_counts=True)
    text, word = key // b.n_distinct, key % b.n_distinct
    held = np.bincount(b.bucket, np.bincount(word, minlength=b.n_distinct)[b.sub_word], BUCKETS)
    per = np.bincount(b.sub_word, minlength=b.n_distinct)
    enough = held >= max(LEAST, LEAST_SHARE * b.n_texts)
    used, row = np.flatnonzero(enough), (np.cumsum(enough) - 1).astype(np.int32)
    on = enough[b.bucket]
    of_words = _Rows(b.sub_word[on], row[b.bucket[on]], (1 / per[b.sub_word[on]]).astype(np.float32), b.n_distinct)
    of_texts = _Rows(text, word, times / b.n_words[text], b.n_texts)
    draw = np.random.default_rng(seed)
    table, softmax, bias = (draw.random((len(used), DIM)) - 0.5) / DIM, (draw.random((DIM, 2)) - 0.5) * SOFTMAX, np.zeros(2)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, softmax, bias)]
    target = np.stack([labels == 0, labels == 1], axis=1).astype(float)
    weight = share / share.mean()
    step, steps = 0, passes * -(-b.n_texts // BATCH)
    for n in range(passes):
        if n in CUTOFFS and CUTOFFS[n] < len(table):
            live = np.argsort(-np.abs(table @ (softmax[:, 1] - softmax[:, 0])), kind="stable")[: CUTOFFS[n]]
            place = np.full(len(table), -1)
            place[live] = np.arange(len(live))
            of_words = of_words.only(place)
            used, table = used[live], table[live]
            moments[0] = tuple(x[live] for x in moments[0])
        for batch in np.array_split(draw.permutation(b.n_texts), -(-b.n_texts // BATCH)):
            step += 1
            at, words, of_text = of_texts.take(batch)
            words, place = np.unique(words, return_inverse=True)
            group, rows, of_word = of_words.take(words)
            vectors = _sums(group, len(words), table[rows] * of_word[:, None])
            mean = _sums(at, len(batch), vectors[place] * of_text[:, None])
            z = mean @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - target[batch]) * weight[batch, None] / len(batch)
            down = _sums(place, len(words), (d @ softmax.T)[at] * of_text[:, None])
            slopes = (_sums(rows, len(table), down[group] * of_word[:, None]), mean.T @ d, d.sum(axis=0))
            for x, (m, v), g in zip((table, softmax, bias), moments, slopes):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= RATE * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = table @ (softmax[:, 1] - softmax[:, 0])
    return Model(weights, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", bound: int = FIT_LABELS, most_bytes: int = FIT_BYTES) -> Model:
    """Fit on about ``bound`` texts of each label (chosen by a hash of the key), of at most ``most_bytes`` bytes each.

    Labels other than 0 and 1 and null keys are left out; of several texts of a key the least is taken. Four fifths
    train the embeddings and one calibrates them; both labels count by their share among all labels. Without texts of
    both labels every text's score is that share (one half without any).
    """
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).filter("label in (0, 1) and id is not null").distinct()
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    every = F.when(F.col("label") == 1, -(-total.get(1, 0) // bound)).otherwise(-(-total.get(0, 0) // bound))
    part = known.filter(F.pmod(F.xxhash64("id"), every) == 0)
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).filter(F.octet_length("text") <= most_bytes)
    chosen = texts.join(F.broadcast(part), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # about 2 * bound rows
    fold = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5))
    sample = chosen.select("label", "text", fold.alias("fold")).orderBy("fold", "id", "label").toArrow()
    y, held = np.asarray(sample.column("label")), np.asarray(sample.column("fold")) == 0
    share = np.array([total.get(v, 0) for v in (0, 1)]) / np.maximum(np.bincount(y, minlength=2), 1)
    column = sample.column("text").combine_chunks()
    if len(set(y[~held].tolist())) < 2:
        prior = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    model = train(column.filter(pa.array(~held)), y[~held], share[y[~held]])
    if len(set(y[held].tolist())) < 2:
        return model
    slope, shift = calibrated(model.odds(column.filter(pa.array(held))), y[held].astype(float))
    if slope <= 0:
        return model
    shift += np.log(share[1] / share[0])  # the fold holds the labels in other shares than the corpus
    return Model((model.weights * slope).astype(np.float32), model.bias * slope + shift)


def _scored(model: Model, schema: pa.Schema):
    def run(batches):
        for batch in in_slices(batches, ["text"], SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(model.scores(batch.column("text")))], schema=schema)

    return run


def score(docs: DataFrame, model: Model, text: str = "text", limit: float = LIMIT, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Documents with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``limit`` on), or so named.

    A null or empty text, or one without letters and digits, has the score of the model's bias alone. Equal texts
    have equal scores whatever else their rows hold. All columns stay, and one named like a new one is
    replaced; an empty table gives no rows. A long text is scored whole, in memory proportional to it.
    """
    rows = boxed(docs)
    made = T.StructType([rows.schema[0], T.StructField("score", T.DoubleType())])
    work = rows.select(ROW, field(text).cast("string").alias("text"))
    out = work.mapInArrow(_scored(model, to_arrow_schema(made)), made)
    return unboxed(out, docs.columns, {names[0]: F.col("score"), names[1]: (F.col("score") >= limit).cast("int")})
