"""Best-fit packing of tokenised documents into sequences of a fixed length.

The histogram of piece lengths (at most one count per length up to the limit, so it fits the
driver whatever the corpus) is packed by a configuration linear program: a
configuration is a multiset of lengths that fits one sequence, and its variable counts how
often it is used. The covering program is solved by multiplicative weights: each
length's price falls exponentially with the share of its pieces covered so far, a knapsack
dynamic program over the capacity prices the best configurations, and all those near
the best are stepped at once. Rounding takes the whole parts, then fills what is left with
further knapsack configurations, at first only those that leave no gap, and at the end by best
fit decreasing. Pieces get their place from their rank within their length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import durable

CAPACITY = 2048
END_ID = 0
CACHE_WORDS, KEPT_WORDS = 500_000, 100_000
ROUNDS, STEP, NEAR, FEW = 30, 0.15, 0.01, 100  # with few lengths, more and smaller steps
BATCH_CHARS = 1 << 20

# The tokenizer's own split into words, for letters and digits below U+0180.
_LETTER, _DIGIT, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_BLANK}{_LETTER}{_DIGIT}]+")
# Beyond that, or where Python's blanks or cases are not the tokenizer's, or with special tokens, it reads the text itself.
_OTHER = re.compile(r"[^\x00-\x1b\x20-\u012f\u0131-\u017f]|<\|")


class Encoder:
    """Ids of texts by a word BPE file that lower-cases, splits into words and marks word ends.

    Merges stay within words, so each distinct word is encoded once, by the file's own
    model, and remembered. Past CACHE_WORDS, and at the end of a task, the memory goes back
    to the KEPT_WORDS first met, among which are the frequent ones.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = dict(zip(plain, map(chr, plain))) | {b: chr(256 + n) for n, b in enumerate(rest)} | {32: " "}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _read(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        split = [_WORD.findall(c) for c in chunks]
        new = list(set().union(*split).difference(self.words))
        for lo in range(0, len(new), 1024):
            part = new[lo : lo + 1024]
            text = " ".join(part)
            if not (text.isascii() and text.isprintable()):
                text = text.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            data = ids.tobytes()
            if len(stops) == len(part):
                starts = [0, *stops[:-1].tolist()]
                self.words.update((w, data[a:b]) for w, a, b in zip(part, starts, stops.tolist()))
            else:
                self.words.update((w, self._read(w)) for w in part)
        self.chunks.update((c, b"".join(map(self.words.__getitem__, words))) for c, words in zip(chunks, split))

    def trim(self) -> None:
        self.words, self.chunks = (dict(islice(d.items(), KEPT_WORDS)) for d in (self.words, self.chunks))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split = [None if _OTHER.search(t) else t.lower().split() for t in texts]
        asked = set().union(*[s for s in split if s])
        if len(self.chunks) > CACHE_WORDS:
            self.trim()
        new = list(asked.difference(self.chunks))
        if new:
            self._learn(new)
        return [self._read(t) if s is None else b"".join(map(self.chunks.__getitem__, s)) for t, s in zip(texts, split)]


_encoders: dict[str, Encoder] = {}


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path](texts)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        columns: list[list] = [[] for _ in range(8)]

        def out():
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "piece", "start", "length", "crc", "part", "nth", "ids"])
            for c in columns:
                c.clear()
            return batch

        for batch in batches:
            keys, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars < BATCH_CHARS):
                    chars += len(texts[hi] or "")
                    hi += 1
                for key, data in zip(keys[lo:hi], token_bytes([t or "" for t in texts[lo:hi]], path)):
                    data += end
                    for k in range(0, len(data), 4 * capacity):
                        cut = data[k : k + 4 * capacity]
                        n = len(cut) // 4
                        for c, x in zip(columns, (key, k // (4 * capacity), k // 4, n, zlib.crc32(cut), part, seen[n], cut if with_ids else None)):
                            c.append(x)
                        seen[n] += 1
                lo = hi
                if len(columns[0]) > 4096:
                    yield out()
        if columns[0]:
            yield out()
        if path in _encoders:
            _encoders[path].trim()

    return run


def _knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity with any number of each length, and the length to take last (0: none)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    order = np.argsort(lengths)
    lengths, values = lengths[order], values[order]
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        n = upto[c]
        if n:
            got = values[:n] + best[c - lengths[:n]]
            k = int(got.argmax())
            best[c], last[c] = got[k], lengths[k]
    return best, last


def _trace(last: np.ndarray, c: int, *first: int) -> Counter:
    items = Counter(first)
    while last[c]:
        items[int(last[c])] += 1
        c -= int(last[c])
    return items


def linear_program(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict, float]:
    """Fractional uses of configurations that cover all counts, and a lower bound for the number of sequences."""
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(x)] for x in lengths], float)
    at = {int(x): i for i, x in enumerate(lengths)}
    covered = np.zeros(len(lengths))
    uses: dict[tuple, float] = defaultdict(float)
    bound = 0.0
    few = len(lengths) <= FEW
    step_share = STEP / 5 if few else STEP
    for _ in range(ROUNDS * 20 if few else ROUNDS):
        price = lengths * np.exp(-(covered - covered.min()))
        best, last = _knapsack(lengths, price, capacity)
        bound = max(bound, float(n @ price) / best[capacity])
        gain = price + best[capacity - lengths]
        for i in np.flatnonzero(gain >= (1 - NEAR) * best[capacity]):
            items = _trace(last, capacity - int(lengths[i]), int(lengths[i]))
            step = step_share * min(n[at[x]] / a for x, a in items.items())
            uses[tuple(sorted(items.items()))] += step
            for x, a in items.items():
                covered[at[x]] += a * step / n[at[x]]
    scale = 1 / max(1e-9, float(np.median(covered)))
    return {c: u * scale for c, u in uses.items()}, bound


def _best_fit(left: Counter, capacity: int) -> list[tuple[Counter, int]]:
    """Best fit decreasing over counts; bins that are alike stay together."""
    open_: dict[int, list[tuple[Counter, int]]] = defaultdict(list)
    for x in sorted(left, reverse=True):
        todo = left[x]
        while todo:
            room = min((f for f in open_ if f >= x and open_[f]), default=None)
            if room is None:
                each = min(capacity // x, todo)
                open_[capacity - each * x].append((Counter({x: each}), todo // each))
                todo %= each
                continue
            items, times = open_[room].pop()
            used = min(times, todo)
            if times > used:
                open_[room].append((items, times - used))
            open_[room - x].append((items + Counter({x: 1}), used))
            todo -= used
    return [b for bins in open_.values() for b in bins]


def _rounded(counts: Counter, fractional: dict, capacity: int, full: bool, fill: bool) -> list[tuple[Counter, int]]:
    """Whole uses: the whole parts (with ``full`` of gapless configurations only), then (with ``fill``) more of the knapsack's, then best fit."""
    left, done = Counter(counts), []

    def use(items, times):
        times = min([times, *(left[x] // a for x, a in items.items())])
        if times > 0:
            done.append((Counter(items), times))
            for x, a in items.items():
                left[x] -= a * times
                if not left[x]:
                    del left[x]
        return times > 0

    for items, amount in sorted(fractional.items(), key=lambda x: (-x[1], x[0])):
        if not full or sum(x * a for x, a in items) == capacity:
            use(dict(items), int(amount))
    gap, draw = 0, np.random.default_rng(0)
    while fill and left and gap <= capacity // 8:
        lengths = np.array(sorted(left), np.int64)
        _, last = _knapsack(lengths, lengths * (1 + 1e-6 * draw.random(len(lengths))), capacity)
        used = False
        for x in lengths[::-1].tolist():
            if left[x]:
                items = _trace(last, capacity - x, x)
                if sum(y * a for y, a in items.items()) >= capacity - gap:
                    used |= use(items, left[x])
        if not used:
            gap = max(1, 2 * gap)
    return done + _best_fit(left, capacity)


def configurations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Whole uses of configurations that hold every counted piece exactly once: the best of a few roundings."""
    left = Counter({int(x): int(c) for x, c in counts.items() if c and x < capacity})
    whole = [(Counter({capacity: 1}), int(counts[capacity]))] if counts.get(capacity) else []
    if not left:
        return whole
    fractional, bound = linear_program(left, capacity)
    best = None
    for uses, full, fill in ((fractional, True, True), (fractional, False, True), (fractional, False, False), ({}, True, False)):
        plan = _rounded(left, uses, capacity, full, fill)
        size = sum(t for _, t in plan)
        if best is None or size < best[0]:
            best = (size, plan)
        if size <= np.ceil(bound - 1e-6) + 1:
            break
    return whole + best[1]


class Places:
    """Sequence and offset by length and rank within the length."""

    def __init__(self, configs: list[tuple[Counter, int]]):
        rank: dict[int, int] = defaultdict(int)
        rows, first = [], 0
        for items, times in configs:
            offset = 0
            for x, a in sorted(items.items(), reverse=True):
                rows.append((x, rank[x], a, first, offset))
                rank[x] += a * times
                offset += a * x
            first += times
        self.sequences = first
        rows.sort()
        self.length, self.rank, self.each, self.first, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self.key = (self.length << 48) + self.rank

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 48) + rank, "right") - 1
        nth = rank - self.rank[i]
        return self.first[i] + nth // self.each[i], self.offset[i] + nth % self.each[i] * length


def _placed(places: Places):
    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = places.of(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    text: str = "text",
    key: str = "doc_id",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: key, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``).

    A document is the ids of its text (null: none) and ``end_id``; one longer than
    ``capacity`` is cut into pieces of that length. Sequences are gapless from offset 0.
    Rows with a null or repeated key are documents like any other; an empty table gives no
    rows; other columns are left out. ``with_ids`` adds the ids themselves.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = "id long, piece int, start long, length long, crc long, part int, nth long, ids binary"
    pieces = durable(rows.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), schema))
    per = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(configurations(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = per.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.select("id", "piece", "start", "length", F.col("crc").alias("ids_crc32"), "ids", "rank")
    out = ranked.mapInArrow(
        _placed(places), "id long, piece int, start long, length long, ids_crc32 long, ids binary, rank long, sequence_id long, offset long"
    ).drop("rank")
    out = out.withColumnRenamed("id", key)
    return out if with_ids else out.drop("ids")


def ids_of(packed: bytes) -> list[int]:
    """The ids that ``pack(with_ids=True)`` stores."""
    return np.frombuffer(packed, "<u4").tolist()
