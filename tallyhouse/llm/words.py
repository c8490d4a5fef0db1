"""Words of Arrow text columns as 64-bit hashes, computed over whole byte buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D. A word's hash is a
polynomial with one random number per byte, so equal words have equal hashes in
every task, and different ones differ but for a chance of about 2**-58.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


BASE = 0x9E3779B97F4A7C15
BYTES = numbered(256, 11)
ORDER = numbered(64, 37)


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


POWERS = powers(CHUNK)


class Words:
    """Words of a column: hashes, byte spans in ``data``, and ``first``, the number of each text's first word (one more at the end)."""

    def __init__(self, column, fold: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        low = int(at[0])
        self.data = np.frombuffer(data, np.uint8)[low : int(at[-1])] if data is not None and at[-1] > low else np.zeros(0, np.uint8)
        self.bounds = at - low
        raw = FOLD[self.data] if fold else self.data
        word = ~SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.bounds] = True
        begins, ends = word.copy(), word.copy()
        if len(raw):
            begins[1:] &= ~word[:-1] | edge[1:-1]
            ends[:-1] &= ~word[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.hashes = self._hash(raw)

    def _hash(self, raw: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + CHUNK, "right")))
            a, b = int(self.starts[lo]), int(self.ends[hi - 1])
            power, inverse = POWERS if b - a <= CHUNK else powers(b - a)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(BYTES[raw[a:b]] * power[: b - a], out=total[1:])
            s = self.starts[lo:hi] - a
            out[lo:hi] = (total[self.ends[lo:hi] - a] - total[s]) * inverse[s]
            lo = hi
        return mix(out + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; none if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * ORDER[j]
    return mix(total)


def shingle_set(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``size`` words; all its words as one run if there are fewer."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes, min(size, len(hashes))))


def in_slices(batches: Iterable[pa.RecordBatch], columns: list[str], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes in the columns named, or of one row."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            size += np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0))
        lo = 0
        total = np.concatenate(([0], np.cumsum(size)))
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
