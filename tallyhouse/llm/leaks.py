"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased, punctuation becomes blanks, and blanks are merged. An item
of m characters may occur with up to e edits: m * ERROR_RATE, but at least LEAST_EDITS (two
replaced words) unless that is more than one in LEAST_OF characters. Cut into e + s pieces, at
least s pieces of any such occurrence are unchanged, and the starts they give the item differ by e
at most: an Aho-Corasick automaton over all pieces finds every exact hit in one pass over the
text, and the windows around s hits of different pieces with such starts are candidates. e edits leave
all but GRAM * e of an item's runs of GRAM characters as they are, so a window that holds fewer of them is none;
the others are verified with Myers' bit-parallel edit distance. Texts are searched many at a time, joined by
characters that no item holds and more of them than an item may reach over.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .frames import ROW, blocks_for, boxed, field, text_bytes, unboxed
from .words import in_slices

ERROR_RATE = 0.07
LEAST_EDITS, LEAST_OF = 16, 5
SEEDS = 4  # pieces that have to agree, where an item is long enough to be cut so often
ITEM_BYTES, TEXT_BYTES = 4 << 20, 1 << 20
GRAM = 3

_PLAIN = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def plain(text: str) -> str:
    """The text as it is compared."""
    return b" ".join(text.lower().encode().translate(_PLAIN).split()).decode()


def edits_allowed(length: int, error_rate: float = ERROR_RATE, least_edits: int = LEAST_EDITS) -> int:
    """The edits that an item of so many characters may have."""
    return max(int(length * error_rate), min(least_edits, length // LEAST_OF))


def least_distance(item: str, text: str) -> int:
    """Least edit distance of the item to any substring of the text, by Myers' bit vectors."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        equal = masks.get(c, 0)
        x = equal | down
        h = (((equal & up) + up) ^ up) | equal
        plus, minus = (down | ~(h | up)) & full, up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = (minus | ~(x | plus)) & full, plus & x
    return best


class Matcher:
    """Items within their error budget in a text."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE, least_edits: int = 0):
        import ahocorasick

        self.items = [(key, p) for key, p in ((key, plain(t)) for key, t in items) if p]
        self.budgets = np.array([edits_allowed(len(p), error_rate, least_edits) for _, p in self.items], np.int64)
        self.seeds = np.ones(len(self.items), np.int64)
        pieces: dict[str, list] = defaultdict(list)
        for n, ((_, p), budget) in enumerate(zip(self.items, self.budgets.tolist())):
            if budget:
                self.seeds[n] = min(SEEDS, len(p) - budget)
            k = budget + int(self.seeds[n])
            cuts = [len(p) * i // k for i in range(k + 1)]
            for a, b in pairwise(cuts):
                pieces[p[a:b]].append((n, b))
        self.grams = [[p[i : i + GRAM] for i in range(len(p) - GRAM + 1)] for _, p in self.items]
        self.gap = "\n" * (2 * max((len(p) for _, p in self.items), default=0) + 4 * int(self.budgets.max(initial=0)) + 1)
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(pieces):
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()
        # Places of piece i: rows first[i] to first[i + 1] of item and end.
        self.first = np.cumsum([0, *map(len, pieces.values())])
        self.item, self.end = np.array([x for places in pieces.values() for x in places], np.int64).reshape(-1, 2).T

    def _candidates(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(item, start of the item), in order, of hits that enough other pieces agree with."""
        hits = np.fromiter(self.automaton.iter(text), np.dtype((np.int64, 2)))
        times = np.diff(self.first)[hits[:, 1]]
        place = np.repeat(self.first[hits[:, 1]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        item, end = self.item[place], self.end[place]
        start = np.repeat(hits[:, 0] + 1, times) - end
        low = int(start.min(initial=0))
        order = np.argsort(item * (len(text) + 1 - low) + (start - low), kind="stable")
        item, start, end = item[order], start[order], end[order]
        good = np.zeros(len(item), bool)
        seeds = self.seeds[item]
        for n in range(1, SEEDS + 1):
            size = len(item) - n + 1
            if size > 0:
                ahead = slice(n - 1, None)
                at = np.flatnonzero((seeds[:size] == n) & (item[:size] == item[ahead]) & (start[ahead] - start[:size] <= self.budgets[item[:size]]))
                for i in range(n):
                    good[at + i] = True
        # Several hits of one piece say no more than one.
        item, start, end = item[good], start[good], end[good]
        if not len(item):
            return item, start
        edge = np.flatnonzero((item[1:] != item[:-1]) | (start[1:] - start[:-1] > self.budgets[item[1:]])) + 1
        group = np.zeros(len(item), np.int64)
        group[edge] = 1
        group = np.cumsum(group)
        pieces = np.unique(group * (int(end.max()) + 1) + end) // (int(end.max()) + 1)
        enough = np.bincount(pieces, minlength=group[-1] + 1) >= self.seeds[item[np.concatenate(([0], edge))]]
        return item[enough[group]], start[enough[group]]

    def _distance(self, n: int, window: str) -> int:
        """Least distance of an item to a substring of the window; one more than its budget if it is beyond that."""
        item, budget = self.items[n][1], int(self.budgets[n])
        if item in window:
            return 0
        grams = self.grams[n]
        need = len(grams) - GRAM * budget
        if need > 0:
            held = {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}
            if sum(map(held.__contains__, grams)) < need:
                return budget + 1
        return min(least_distance(item, window), budget + 1)

    def many(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(number of the text, item key, distance) of each item found, by text."""
        if not len(self.automaton):
            return []
        found: dict[tuple[int, int], int] = {}
        lo, clean = 0, [plain(t) if t else "" for t in texts]
        while lo < len(clean):
            hi, size = lo, 0
            while hi < len(clean) and (hi == lo or size < TEXT_BYTES):
                size += len(clean[hi])
                hi += 1
            begin = np.cumsum([0, *(len(t) + len(self.gap) for t in clean[lo:hi])]) - len(self.gap) // 2
            text = self.gap.join(clean[lo:hi])
            items, starts = self._candidates(text)
            budgets = self.budgets[items]
            new = np.ones(len(items), bool)  # windows that overlap are one
            length = np.array([len(p) for _, p in self.items], np.int64)[items]
            new[1:] = (items[1:] != items[:-1]) | (starts[1:] - budgets[1:] > starts[:-1] + length[:-1] + budgets[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(items)) - 1 if len(at) else at
            for n, a, b, middle in zip(items[at].tolist(), (starts - budgets)[at].tolist(), (starts + length + budgets)[last].tolist(), (starts + length // 2)[at].tolist()):
                distance = self._distance(n, text[max(a, 0) : b])
                if distance <= self.budgets[n]:
                    doc = lo + int(np.searchsorted(begin, middle, "right")) - 1
                    found[doc, n] = min(distance, found.get((doc, n), distance))
            lo = hi
        return [(doc, self.items[n][0], d) for (doc, n), d in sorted(found.items())]

    def __call__(self, text: str | None) -> list[tuple[int, int]]:
        """(item key, distance) of each item found."""
        return [(key, d) for _, key, d in self.many([text])]


def _item_blocks(items: DataFrame, text: str, key: str):
    """Lists of (key, text), each of at most about ITEM_BYTES, one at a time."""
    rows = items.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.filter("text is not null").distinct()
    n = blocks_for(text_bytes(rows, "text"), ITEM_BYTES)
    for block in range(n):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == block)
        yield [(r["id"], r["text"]) for r in part.collect()]


def _search(items, error_rate, least_edits):
    def run(batches):
        match = Matcher(items, error_rate, least_edits)
        for batch in in_slices(batches, ["text"]):
            rows = match.many(batch.column("text").to_pylist())
            if rows:
                at, key, distance = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(key, pa.int64()), pa.array(distance, pa.int32())], ["id", "item_id", "distance"])

    return run


def leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    error_rate: float = ERROR_RATE,
    least_edits: int = LEAST_EDITS,
) -> DataFrame:
    """One row per document and test item found in it: key, ``item_id``, ``distance`` (edits).

    Items are held by the driver and sent to tasks in blocks of ITEM_BYTES, however many there are. A
    null or empty text (or one of punctuation only) holds no item, and such an item is in
    no text. Repeated documents are reported each; repeated items once. Null keys stay null.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = None
    for block in _item_blocks(items, item_text, item_key):
        found = rows.mapInArrow(_search(block, error_rate, least_edits), "id long, item_id long, distance int")
        out = found if out is None else out.unionAll(found)
    return out.withColumnRenamed("id", key)


def _clean(items, error_rate, least_edits, schema):
    def run(batches):
        match = Matcher(items, error_rate, least_edits)
        for batch in in_slices(batches, ["text"]):
            good = np.ones(batch.num_rows, bool)
            good[[i for i, _, _ in match.many(batch.column("text").to_pylist())]] = False
            yield pa.RecordBatch.from_arrays([batch.column(ROW).filter(pa.array(good))], schema=schema)

    return run


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", error_rate: float = ERROR_RATE, least_edits: int = LEAST_EDITS) -> DataFrame:
    """The documents that hold no test item; all columns as they are."""
    rows = boxed(docs)
    schema = T.StructType([rows.schema[0]])
    for block in _item_blocks(items, item_text, item_key):
        rows = rows.select(ROW, field(text).cast("string").alias("text")).mapInArrow(_clean(block, error_rate, least_edits, to_arrow_schema(schema)), schema)
    return unboxed(rows, docs.columns, {})
