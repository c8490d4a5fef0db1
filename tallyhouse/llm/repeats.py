"""Substring dedup by recompression: remove words of long passages that occur more than once.

Every text is parsed into symbols in a few rounds: a round names maximal runs of one
symbol, or adjacent pairs whose first symbol is a left and second a right one. A name is
a hash of what it stands for, and sides are bits of names, so tasks name alike without
talking, and equal substrings get equal interior symbols. Each symbol carries the span of
words that its name and limits depend on. A window of words chooses, among the symbols
whose span it holds, that of the least name: equal windows choose equal symbols. Windows
in a row with the same choice form a stretch. Spark counts chosen names, and hashes of
all words of a stretch, over the whole corpus. A window whose symbol occurs once cannot
repeat; a stretch that occurs twice repeats in all its windows. Only the windows of names
with a stretch that shares its symbol but not all its words (or windows that hold no
symbol at all, as within a long run) are verified one by one, by the hash of their words.

Texts are dealt to blocks of bounded bytes; a name or hash travels once per block, so a
passage that a third of all documents share costs each block one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .frames import ROW, blocks_for, boxed, field, release, stored, text_bytes, unboxed
from .words import CHUNK, POWERS, Words, in_slices, mix, powers

WINDOW = 35
ROUNDS = ("run", "pair", "pair", "pair", "pair")
BLOCK_BYTES = 3 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
FAR = 1 << 40
SCALE = np.uint64(0x9E3779B97F4A7C15)


def parse(names: np.ndarray, text: np.ndarray, rounds=ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after all rounds, and the span of words [low, high) each depends on.

    ``text`` numbers the text of each word. A symbol that depends on where its text
    begins or ends has a span that no window holds.
    """
    low = np.arange(len(names), dtype=np.int64)
    high = low + 1
    for level, kind in enumerate(rounds):
        n = len(names)
        if n < 2:
            break
        same_text = text[1:] == text[:-1]
        before = np.concatenate(([-FAR], np.where(same_text, low[:-1], -FAR)))  # what is known if the left neighbour is
        after = np.concatenate((np.where(same_text, high[1:], FAR), [FAR]))
        if kind == "run":
            first = np.flatnonzero(np.concatenate(([True], ~same_text | (names[1:] != names[:-1]))))
            count = np.diff(np.append(first, n))
            last = first + count - 1
            low, high = np.minimum(low[first], before[first]), np.maximum(high[last], after[last])
            names = np.where(count > 1, mix(names[first] * SCALE + count.astype(np.uint64) * np.uint64(2 * level + 3)), names[first])
            text = text[first]
        else:
            right = ((names >> np.uint64(7 * level + 1)) & np.uint64(1)).astype(bool)
            joins = np.concatenate((same_text & ~right[:-1] & right[1:], [False]))
            joined = np.concatenate(([False], joins[:-1]))
            own_low = np.where(right & ~joined, np.minimum(low, before), low)
            own_high = np.where(~right & ~joins, np.maximum(high, after), high)
            keep = np.flatnonzero(~joined)
            pair = joins[keep]
            mate = np.minimum(keep + 1, n - 1)
            low = np.where(pair, np.minimum(low[keep], low[mate]), own_low[keep])
            high = np.where(pair, np.maximum(high[keep], high[mate]), own_high[keep])
            names = np.where(pair, mix(names[keep] * SCALE + names[mate] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(level)), names[keep])
            text = text[keep]
    return names, low, high


class Parsed:
    """Windows of a block of texts, each with the name it has chosen (NONE: no symbol fits)."""

    def __init__(self, column, size: int, rounds=ROUNDS):
        self.words, self.text, self.whole = windowed(column, size)
        n = len(self.text)
        names, low, high = parse(self.words.hashes, self.text, rounds)
        fits = high - low <= size
        self.names, low, high = names[fits], low[fits], high[fits]
        self.chosen = np.full(n, NONE)
        begin = np.maximum(high - size, 0)
        shift = 0
        at = self.names
        while len(at):
            np.minimum.at(self.chosen, begin + shift, at)
            shift += 1
            more = begin + shift <= low
            at, begin, low = at[more], begin[more], low[more]

    def stretches(self, size: int) -> tuple[np.ndarray, ...]:
        """First and last window, name and hash of all words of each stretch, and whether its name may occur twice."""
        at = np.flatnonzero(self.whole & (self.chosen != NONE))
        name = self.chosen[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (name[1:] != name[:-1]) | (self.text[at][1:] != self.text[at][:-1])
        begin = np.flatnonzero(new)
        first, last, name = at[begin], at[np.append(begin[1:], len(at)) - 1] if len(at) else at, name[begin]
        power, inverse, total = _sums(self.words.hashes)
        length = (last + size - first).astype(np.uint64)
        whole = mix((total[last + size] - total[first]) * inverse[first] + length * np.uint64(0xA0761D6478BD642F))
        all_names, n = np.unique(self.names, return_counts=True)
        twice = n[np.searchsorted(all_names, name)] > 1
        return first, last, name, whole, twice


def _sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers, their inverses, and running sums of hash times power."""
    power, inverse = POWERS if len(h) < CHUNK else powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return power, inverse, total


def windowed(column, size: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, the number of each word's text, and whether a window begins at it."""
    words = Words(column)
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)
    left = words.first[1:][text] - np.arange(len(text)) if len(text) else np.zeros(0, np.int64)
    return words, text, left >= size


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of all words of the window at each word (of no use where none begins)."""
    out = np.zeros(len(h), np.uint64)
    m = len(h) - size + 1
    if m > 0:
        _, inverse, total = _sums(h)
        out[:m] = mix((total[size:] - total[:m]) * inverse[:m])
    return out


def _named(size, rounds):
    def run(batches):
        for batch in in_slices(batches, ["text"], BLOCK_BYTES):
            p = Parsed(batch.column("text"), size, rounds)
            first, _, name, whole, twice = p.stretches(size)
            of = np.asarray(batch.column("block"))[p.text[first]]
            order = np.lexsort((whole, name, of))
            of, name, whole, twice = of[order], name[order], whole[order], twice[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (name[1:] != name[:-1]) | (whole[1:] != whole[:-1])
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(of)))
            columns = [of[begin], name[begin].view(np.int64), whole[begin].view(np.int64), np.where(twice[begin], 2, times), times]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["block", "name", "whole", "n", "times"])

    return run


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def _flags(table) -> np.ndarray:
    return np.unique(np.asarray(table.column(1).combine_chunks()).view(np.uint64)) if table.num_rows else np.zeros(0, np.uint64)


def _candidates(size, rounds):
    def run(texts, shared):
        if not texts.num_rows:
            return OUT_HASHES.empty_table()
        p = Parsed(texts.column("text"), size, rounds)
        at = p.whole & ((p.chosen == NONE) | _member(p.chosen, _flags(shared)))
        value, n = np.unique(window_hashes(p.words.hashes, size)[at], return_counts=True)
        block = texts.column("block")[0].as_py()
        return pa.table([pa.array(np.full(len(value), block, np.int64)), pa.array(value.view(np.int64)), pa.array(np.minimum(n, 2))], schema=OUT_HASHES)

    return run


OUT_HASHES = pa.schema([("block", pa.int64()), ("name", pa.int64()), ("n", pa.int64())])


def _cut(text, size, rounds, schema):
    def run(texts, repeated):
        if not texts.num_rows:
            return schema.empty_table()
        rows = texts.column(ROW).combine_chunks()
        p, flags = Parsed(rows.field(text), size, rounds), _flags(repeated)
        w, n = p.words, len(p.text)
        edge = np.zeros(n + size + 1, np.int64)
        begin = np.flatnonzero(p.whole & _member(window_hashes(w.hashes, size), flags))
        first, last, _, whole, _ = p.stretches(size)
        same = _member(whole, flags)
        np.add.at(edge, np.concatenate((begin, first[same])), 1)
        np.add.at(edge, np.concatenate((begin, last[same])) + size, -1)
        keep = np.cumsum(edge)[:n] == 0
        data = w.data.tobytes()
        removed = np.diff(np.concatenate(([0], np.cumsum(~keep)))[w.first])
        kept = []
        for i in range(texts.num_rows):
            a, b = w.first[i], w.first[i + 1]
            on = np.flatnonzero(keep[a:b]) + a
            kept.append(b" ".join([data[s:e] for s, e in zip(w.starts[on].tolist(), w.ends[on].tolist())]).decode())
        return pa.table([rows, pa.array(np.diff(w.first)), pa.array(removed), pa.array(kept, pa.string())], names=[ROW, "n_words", "n_removed", "kept"])

    return run


def cut_repeats(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    window: int = WINDOW,
    rounds: tuple[str, ...] = ROUNDS,
    block_bytes: int = BLOCK_BYTES,
    names: tuple[str, str, str] = ("n_words", "n_removed", "kept"),
) -> DataFrame:
    """Documents with ``n_words``, ``n_removed`` and ``kept`` (kept words joined by one space), or so named.

    A word is removed if a window of ``window`` words that covers it also starts
    anywhere else, the same document included; windows are judged on the input. A null or
    empty text has no words and an empty ``kept``. Rows repeated as a whole are documents
    of their own, so they repeat each other. All input columns stay; a column named like
    one of the three new ones is replaced. ``key`` may be null or repeated: with the text
    it only deals rows to blocks.
    """
    rows = boxed(docs)
    n_blocks = blocks_for(text_bytes(rows, field(text)), block_bytes)
    block = F.pmod(F.xxhash64(field(key), field(text)), F.lit(n_blocks)).alias("block")
    texts = rows.select(block, field(text).cast("string").alias("text"))
    parts = "block long, name long, n long"
    # A name, stretch or window has at most one row per block below, so no group exceeds the blocks.
    found = texts.mapInArrow(_named(window, rounds), "block long, name long, whole long, n long, times long")
    found = found.groupBy("block", "name", "whole").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
    by = Window.partitionBy("name")
    counted = found.withColumn("total", F.sum("n").over(by)).filter("total > 1")
    counted = counted.withColumn("wholes", F.sum("times").over(Window.partitionBy("name", "whole")))
    counted = stored(counted.withColumn("least", F.min("wholes").over(by)).select("block", "name", "whole", "wholes", "least"))
    release(docs.sparkSession)
    by_block = lambda df: df.groupBy("block")
    unlike = counted.filter("least = 1").select("block", "name").distinct()
    hashes = by_block(texts).cogroup(by_block(unlike)).applyInArrow(_candidates(window, rounds), parts)
    again = stored(hashes.withColumn("total", F.sum("n").over(by)).filter("total > 1").select("block", "name"))
    release(docs.sparkSession)
    repeated = again.unionAll(counted.filter("wholes > 1").select("block", F.col("whole").alias("name")).distinct())
    whole = rows.select(block, ROW)
    made = T.StructType([rows.schema[0], *T.StructType.fromDDL("n_words long, n_removed long, kept string").fields])
    out = by_block(whole).cogroup(by_block(repeated)).applyInArrow(_cut(text, window, rounds, to_arrow_schema(made)), made)
    return unboxed(out, docs.columns, {name: F.col(c) for name, c in zip(names, ("n_words", "n_removed", "kept"))})
