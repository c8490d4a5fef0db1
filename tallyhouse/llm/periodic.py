"""Periodic runs of words, found on a grammar of each text.

Re-Pair: in each round every pair of neighbouring symbols that occurs twice or more in its
text is counted, occurrences that overlap a more frequent pair's give way, and the others become
symbols of their own; a text's most frequent pair always gets all its places. Each symbol spells
two parts, so a run either lies within one of them or crosses the boundary between them: runs that
cross are looked for once per symbol, at its first place, and carried to all places that the
grammar derives for it. What no pair repeats in is left as a row of symbols, which a balanced tree
joins in the same way. A run that is cut off by its symbol's ends lies within the whole one, which the least
symbol around it has found; so the maximal intervals of each period are the runs.

A period q is looked for at a boundary by comparing q words after (before) it with the q words next to
them, by hashes of all words between; longest equal stretches then come from a binary search.
Words and stretches count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .frames import ROW, boxed, field, unboxed
from .words import CHUNK, POWERS, SPACE, Words, in_slices, mix, powers

LEAST, EXPONENT = 6, 4
SLICE_BYTES = 2 << 20
AT_ONCE = 1 << 20  # candidates looked at together


class Grammar:
    """Rules of all texts of a slice: symbol ``base + i`` spells ``left[i]`` and ``right[i]``; ``symbols`` at ``places`` is what is left of the texts."""

    def __init__(self, symbols: np.ndarray, text: np.ndarray):
        """``symbols`` number the words so that no two texts share one."""
        self.base = int(symbols.max(initial=-1)) + 1
        self.size = np.ones(self.base, np.int64)
        self.first = np.zeros(self.base, np.int64)
        self.left, self.right = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.rounds = []  # the first symbol of each round
        places = np.arange(len(symbols))
        while True:
            chosen, pair, pairs = self._choose(symbols, text)
            if not len(chosen):
                break
            new = len(self.size) + np.arange(len(pairs))
            self.rounds.append(len(self.size))
            begin = np.empty(len(pairs), np.int64)
            begin[pair[::-1]] = chosen[::-1]  # each pair's first place
            self.left, self.right = np.concatenate((self.left, symbols[begin])), np.concatenate((self.right, symbols[begin + 1]))
            self.first = np.concatenate((self.first, places[begin]))
            self.size = np.concatenate((self.size, self.size[symbols[begin]] + self.size[symbols[begin + 1]]))
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols = symbols.copy()
            symbols[chosen] = new[pair]
            symbols, text, places = symbols[keep], text[keep], places[keep]
        self.symbols, self.text, self.places = symbols, text, places

    @staticmethod
    def _choose(symbols, text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (of the first of two) to replace, the number of the pair at each, and the pairs."""
        nothing = np.zeros(0, np.int64)
        if len(symbols) < 2:
            return nothing, nothing, nothing
        often = np.bincount(symbols)[symbols] > 1
        at = np.flatnonzero(often[:-1] & often[1:] & (text[:-1] == text[1:]))
        key = symbols[at] * np.int64(len(symbols) + int(symbols.max())) + symbols[at + 1]
        # Of places in a row with the same pair (a a a a), every second one.
        follows = np.zeros(len(at), bool)
        follows[1:] = (at[1:] == at[:-1] + 1) & (key[1:] == key[:-1])
        start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
        even = (np.arange(len(at)) - start) % 2 == 0
        at, key = at[even], key[even]
        pairs, pair, n = np.unique(key, return_inverse=True, return_counts=True)
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((mix(pairs.astype(np.uint64)), n))] = np.arange(1, len(pairs) + 1)
        rank[n < 2] = 0
        strength = np.zeros(len(symbols) + 1, np.int64)
        strength[at] = rank[pair]
        own = strength[at]
        wins = (own > 0) & (own > strength[at - 1] * (at > 0)) & (own > strength[at + 1])
        at, pair = at[wins], pair[wins]
        twice = np.bincount(pair, minlength=len(pairs)) > 1
        at, pair = at[twice[pair]], pair[twice[pair]]
        used, number = np.unique(pair, return_inverse=True)
        return at, number, pairs[used]

    def everywhere(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``symbol``, place) for all places that the grammar derives for these symbols."""
        wanted = np.zeros(len(self.size), bool)
        wanted[symbol] = True
        need = wanted.copy()
        for lo, hi in zip(self.rounds, [*self.rounds[1:], len(self.size)]):
            need[lo:hi] |= need[self.left[lo - self.base : hi - self.base]] | need[self.right[lo - self.base : hi - self.base]]
        number = np.zeros(len(self.size), np.int64)
        number[symbol] = np.arange(len(symbol))
        on = need[self.symbols]
        now, place = self.symbols[on], self.places[on]
        found = []
        for lo in self.rounds[::-1]:
            here = now >= lo
            x, p = now[here], place[here]
            found.append((number[x[wanted[x]]], p[wanted[x]]))
            left, right = self.left[x - self.base], self.right[x - self.base]
            now = np.concatenate((now[~here], left, right))
            place = np.concatenate((place[~here], p, p + self.size[left]))
            on = need[now]
            now, place = now[on], place[on]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))


class Stretches:
    """Equal stretches of a row of words, by the hash of all words between two places."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, n = hashes, len(hashes)
        power, self.inverse = POWERS if n < CHUNK else powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:n], out=self.total[1:])

    def equal(self, i, j, n) -> np.ndarray:
        """Whether the n words from i and those from j are the same."""
        return (self.total[i + n] - self.total[i]) * self.inverse[i] == (self.total[j + n] - self.total[j]) * self.inverse[j]

    def _longest(self, most, same) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            yes = same(mid)
            low, high = np.where(yes, mid, low), np.where(yes, high, mid - 1)
        return low

    def ahead(self, i, j, most) -> np.ndarray:
        """How many words from i on, at most ``most``, are those from j on."""
        return self._longest(most, lambda n: self.equal(i, j, n))

    def behind(self, i, j, most) -> np.ndarray:
        """How many words before i, at most ``most``, are those before j."""
        return self._longest(most, lambda n: self.equal(i - n, j - n, n))


def crossing(words: Stretches, low, mid, high, least: int, exponent: int) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of stretches within [low, high) around ``mid`` that are long enough, one per node and period."""
    h, found = words.hashes, []
    for after in (True, False):
        # One side of the boundary holds half of the run, or more.
        most = np.minimum((high - low) // exponent, (high - mid if after else mid - low) // (exponent // 2))
        total = np.cumsum(most)
        lo = 0
        while lo < len(most):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + AT_ONCE, "right")))
            node = np.repeat(np.arange(lo, hi), most[lo:hi])
            q = np.arange(len(node)) - np.repeat(total[lo:hi] - most[lo:hi] - (total[lo - 1] if lo else 0), most[lo:hi]) + 1
            m = mid[node]
            shift = q if after else -q
            good = np.flatnonzero((h[m] == h[m + shift]) & (h[m - 1] == h[m - 1 + shift]))
            node, q, m = node[good], q[good], m[good]
            good = words.equal(m, m + q, q) if after else words.equal(m - 2 * q, m - q, q)
            node, q, m = node[good], q[good], m[good]
            i = m if after else m - q
            start = i - words.behind(i, i + q, i - low[node])
            end = i + q + words.ahead(i, i + q, high[node] - i - q)
            good = (start < m) & (end > m) & (end - start >= np.maximum(least, exponent * q))
            found.append((node[good], start[good], end[good], q[good]))
            lo = hi
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))


def maximal(start, end, period) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that lie in no other of their period, each with its least period, by start and period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = period * (int(end.max(initial=0)) + 1) + end
    keep = np.ones(len(reach), bool)
    keep[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(hashes: np.ndarray, text: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(start, end, period) of the runs of all texts; words are numbered through, ``text`` is each one's text."""
    distinct, number = np.unique(hashes, return_inverse=True)
    _, symbols = np.unique(text * np.int64(len(distinct) + 1) + number, return_inverse=True)
    words, g = Stretches(hashes), Grammar(symbols, text)
    parts = []
    rules = np.arange(g.base, len(g.size))
    rules = rules[g.size[rules] >= least]
    begin = g.first[rules]
    node, start, end, q = crossing(words, begin, begin + g.size[g.left[rules - g.base]], begin + g.size[rules], least, exponent)
    if len(node):
        having, own = np.unique(rules[node], return_inverse=True)
        of, place = g.everywhere(having)
        order = np.argsort(own, kind="stable")
        count = np.bincount(own, minlength=len(having))
        first = np.cumsum(count) - count
        each = np.repeat(np.arange(len(of)), count[of])
        nth = np.arange(len(each)) - np.repeat(np.cumsum(count[of]) - count[of], count[of])
        run = order[first[of[each]] + nth]
        shift = place[each] - g.first[having[of[each]]]
        parts.append((start[run] + shift, end[run] + shift, q[run]))
    # The balanced tree over what is left of each text.
    edge = np.append(g.places, len(hashes))
    cuts = np.flatnonzero(np.diff(g.text, prepend=-1, append=-1))
    lo, hi = cuts[:-1], cuts[1:]
    while len(lo):
        wide = (hi - lo >= 2) & (edge[hi] - edge[lo] >= least)
        lo, hi = lo[wide], hi[wide]
        mid = (lo + hi) // 2
        parts.append(crossing(words, edge[lo], edge[mid], edge[hi], least, exponent)[1:])
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
    return maximal(*[np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)])


def joined(words: Words, keep: np.ndarray) -> pa.LargeStringArray:
    """Each text's kept words, joined by one space."""
    n = len(words.starts)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    held = np.flatnonzero(keep)
    blank = held[1:][text[held[1:]] == text[held[:-1]]]  # words with another one before
    edge = np.zeros(len(words.data) + 1, np.int32)
    edge[words.starts[held]] += 1
    edge[words.ends[held]] -= 1
    on = np.cumsum(edge[:-1]) > 0
    on[words.starts[blank] - 1] = True
    data = words.data[on]
    data = np.where(SPACE[data], np.uint8(32), data)
    size = np.zeros(n, np.int64)
    size[held] = words.ends[held] - words.starts[held]
    size[blank] += 1
    offsets = np.concatenate(([0], np.cumsum(size)))[words.first]
    return pa.LargeStringArray.from_buffers(len(words.first) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _marked(text: str, least: int, exponent: int, schema: pa.Schema):
    def run(batches):
        for batch in in_slices(batches, ["text"], SLICE_BYTES):
            words = Words(batch.column("text"))
            n = len(words.starts)
            of = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
            start, end, period = runs_of(words.hashes, of, least, exponent)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, end, -1)
            kept = joined(words, np.cumsum(edge[:n]) == 0)
            items = pa.StructArray.from_arrays([pa.array(start - words.first[of[start]]), pa.array(end - start), pa.array(period)], fields=list(RUN))
            offsets = np.searchsorted(start, words.first).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(offsets), items)
            columns = [batch.column(ROW), pa.array(np.diff(words.first)), runs.cast(schema.field("runs").type), kept.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def mark_runs(
    docs: DataFrame,
    text: str = "text",
    least: int = LEAST,
    exponent: int = EXPONENT,
    names: tuple[str, str, str] = ("n_words", "runs", "collapsed"),
) -> DataFrame:
    """Documents with ``n_words``, ``runs`` and ``collapsed``, or so named.

    A run is a stretch of consecutive words with smallest period q (words q apart are the same), of at least
    ``least`` words and ``exponent`` (an even number from 4) periods, that no neighbouring word extends. ``runs`` lists start (word
    number), length and period, by start, then period. ``collapsed`` is the text without the words that
    any run holds after its first q, joined by one space. A null or empty text has no words, no runs and
    an empty ``collapsed``. Every row is a document by itself, however often it is repeated; all columns stay,
    and one named like a new one is replaced. An empty table gives no rows. Texts are
    handled in slices of bounded bytes, a longer one alone, in memory proportional to it.
    """
    if exponent % 2 or exponent < 4:
        raise ValueError("exponent must be an even number from 4")
    rows = boxed(docs)
    made = T.StructType([rows.schema[0], *T.StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").fields])
    work = rows.select(ROW, field(text).cast("string").alias("text"))
    out = work.mapInArrow(_marked(text, least, exponent, to_arrow_schema(made)), made)
    return unboxed(out, docs.columns, {name: F.col(c) for name, c in zip(names, ("n_words", "runs", "collapsed"))})
