"""Alignment of two tokenizers' tokens of the same texts, by lockstep vectorised merging.

Both tokenizers read every text; a token is a range of bytes. One numpy state vector holds a pair
of pointers, A and B, per lane: each step compares the ends of all lanes' two tokens, advances
the pointer whose token ends first, or both where they end together, which is a cut, and
compacts the lanes that are done. A lane is a document, or a stretch of a long one between two places
where both tokenizers' tokens end. The tokens between two cuts are a group, and all A-B pairs
within a group are links.

Documents are gathered in blocks of bounded bytes. A pair of ids is counted once per document,
first within the block and then over the corpus, and the counts go back to the blocks that hold
the pair, so a pair that every document has costs each block one row.
"""

from __future__ import annotations

import os
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored
from .words import in_slices

SLICE_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20
LANE, PROBE = 1024, 64  # A tokens of a lane, and of one look for a common end
CACHE_WORDS, KEPT_WORDS = 300_000, 100_000
WIDE = 1 << 20  # links handled at once
LONG = 10_000  # characters of a word that only the file's own tokenizer reads
SHIFT = np.int64(1 << 16)  # a pair's number: A id * SHIFT + B id; no vocabulary may be larger
# Fixed value: the split of byte-level BPE files into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_JOINED = re.compile(r"\s |\s$")  # a blank after white space: not a place where both tokenizers' words begin


class ByteTokens:
    """Ids and token bytes of a byte-level BPE file; the strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
        special = set(self.whole.get_added_tokens_decoder())
        vocabulary = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.bytes = [b""] * (max(vocabulary) + 1)
        for i, t in vocabulary.items():
            self.bytes[i] = t.encode() if i in special else bytes(letters[c] for c in t)
        ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in special}
        self.fast = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        """Ids of a text that begins with its blank."""
        if len(text) > LONG and max(map(len, text.split(" "))) > LONG or _JOINED.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokens:
    """Ids and token bytes of a piece model, which puts a blank before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text[1:], num_threads=1)


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group of each member, and its number in it."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


class Reader:
    """Ids of texts by both tokenizers, each distinct word read once and remembered.

    A text is cut before each blank that follows no white space: no token of either kind
    reaches over such a place. Other texts are read whole, as words of their own that are not
    remembered. Memory is trimmed to the KEPT_WORDS first met, among which are the frequent ones.
    """

    def __init__(self, path_a: str, path_b: str):
        self.tokens = (ByteTokens(path_a), PieceTokens(path_b))
        self.length = [np.array([len(b) for b in t.bytes], np.int64) for t in self.tokens]
        if max(map(len, self.length)) > SHIFT:
            raise ValueError("vocabularies of at most 65536 ids")
        self.number: dict[str, int] = {}  # numbers rise in the order in which words were met
        self.same = np.zeros(0, bool)  # whether both tokenizers' bytes are the word's own
        self.ids = [np.zeros(0, np.uint16) for _ in self.tokens]
        self.size = [np.zeros(0, np.int64) for _ in self.tokens]

    def _same(self, k: int, ids, text: bytes) -> bool:
        return b"".join(map(self.tokens[k].bytes.__getitem__, ids)) == text

    def _read(self, k: int, words: list[str]):
        """(ids, ids per word, whether they spell it) of words, which are read as one text if that is cut between all of them."""
        raw = [b" " + w.encode() for w in words]
        stops = np.cumsum([len(r) for r in raw])
        ids = self.tokens[k](" " + " ".join(words))
        ends = np.cumsum(self.length[k][ids])
        if len(ends) and ends[-1] == stops[-1]:
            at = np.searchsorted(ends, stops)
            if (ends[at] == stops).all() and self._same(k, ids, b"".join(raw)):
                return np.array(ids, np.uint16), np.diff(at, prepend=-1), np.ones(len(words), bool)
        if len(words) == 1:
            return np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(1, bool)
        half = len(words) // 2
        return tuple(map(np.concatenate, zip(self._read(k, words[:half]), self._read(k, words[half:]))))

    def _learn(self, new: list[str]) -> None:
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            good = np.ones(len(part), bool)
            for k in range(2):
                ids, size, same = self._read(k, part)
                self.ids[k], self.size[k] = np.concatenate((self.ids[k], ids)), np.concatenate((self.size[k], size))
                good &= same
            self.same = np.concatenate((self.same, good))
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part))))

    def _trim(self) -> None:
        self.number = dict(islice(self.number.items(), KEPT_WORDS))
        n = len(self.number)
        self.same, self.size = self.same[:n], [s[:n] for s in self.size]
        self.ids = [i[: s.sum()] for i, s in zip(self.ids, self.size)]

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B: all ids in a row, and the number of each text's first (one more at the end)."""
        split = [None if _JOINED.search(" " + t) else t.split(" ") for t in texts]
        if len(self.number) > CACHE_WORDS:
            self._trim()
        self._learn([w for w in dict.fromkeys(chain.from_iterable(s for s in split if s)) if w not in self.number])
        known, whole = len(self.number), [t for t, s in zip(texts, split) if s is None]
        rest = iter(range(known, known + len(whole)))
        counts = np.array([1 if s is None else len(s) for s in split], np.int64)
        find = self.number.__getitem__
        number = np.fromiter(chain.from_iterable((next(rest),) if s is None else map(find, s) for s in split), np.int64, int(counts.sum()))
        text = np.repeat(np.arange(len(texts)), counts)
        read = [[self._read(k, [t]) for t in whole] for k in range(2)]
        same = np.concatenate([self.same, *[a[2] & b[2] for a, b in zip(*read)]])
        good = np.bincount(text[~same[number]], minlength=len(texts)) == 0
        number, text = number[good[text]], text[good[text]]
        out = []
        for k in range(2):
            ids, size = np.concatenate([self.ids[k], *[r[0] for r in read[k]]]), np.concatenate([self.size[k], *[r[1] for r in read[k]]])
            first = (np.cumsum(size) - size)[number]
            of, nth = _runs(size[number])
            out.append((ids[first[of] + nth].astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(text, size[number], len(texts))).astype(np.int64)))))
        return out


_readers: dict[tuple[str, str], Reader] = {}


def reader(path_a: str, path_b: str) -> Reader:
    if (path_a, path_b) not in _readers:
        _readers[path_a, path_b] = Reader(path_a, path_b)
    return _readers[path_a, path_b]


def lanes(first_a, first_b, ends_a, ends_b, lane: int = LANE) -> tuple[np.ndarray, ...]:
    """Where the lanes begin in A and B, and where they stop in A: a document each, long ones cut at common ends.

    ``ends_a`` and ``ends_b`` rise over all documents; ``first_a`` and ``first_b`` number each document's first token.
    """
    a, b, stop = [], [], []
    for d in np.flatnonzero(np.diff(first_a)).tolist():
        at, last = int(first_a[d]), int(first_a[d + 1])
        a.append(at)
        b.append(int(first_b[d]))
        look = at + lane
        while look < last - 1:
            ends = ends_a[look : min(look + PROBE, last - 1)]
            place = np.searchsorted(ends_b, ends)
            common = np.flatnonzero(ends_b[place] == ends)
            if len(common):
                look += int(common[0])
                stop.append(look + 1)
                a.append(look + 1)
                b.append(int(place[common[0]]) + 1)
                look += lane
            else:
                look += PROBE
        stop.append(last)
    return tuple(np.array(x, np.int64) for x in (a, b, stop))


def lockstep(at_a, at_b, stop_a, ends_a, ends_b) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and of the B tokens that end at a cut, in order; all lanes advance together."""
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    a, b, stop = at_a.copy(), at_b.copy(), stop_a
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        on_a, on_b = end_a <= end_b, end_b <= end_a
        cut = on_a & on_b
        cut_a[a[cut]] = True
        cut_b[b[cut]] = True
        a += on_a
        b += on_b
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return np.flatnonzero(cut_a), np.flatnonzero(cut_b)


def _summed(doc, pair, times):
    """Distinct (doc, pair) in order, times added."""
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    return doc[at], pair[at], np.add.reduceat(times, at) if len(at) else times


def links(ids_a, ids_b, end_a, end_b, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair of ids) that are linked, and how often; groups end at the tokens given."""
    begin_a, begin_b = np.concatenate(([0], end_a[:-1] + 1)), np.concatenate(([0], end_b[:-1] + 1))
    n_a, n_b = end_a + 1 - begin_a, end_b + 1 - begin_b
    size = n_a * n_b
    parts = []
    for g in np.flatnonzero(size > WIDE).tolist():  # each id once, however often it occurs
        a, times_a = np.unique(ids_a[begin_a[g] : end_a[g] + 1], return_counts=True)
        b, times_b = np.unique(ids_b[begin_b[g] : end_b[g] + 1], return_counts=True)
        pair = (a[:, None] * SHIFT + b).ravel()
        parts.append((np.full(len(pair), doc[g]), pair, (times_a[:, None] * times_b).ravel()))
    rest = np.flatnonzero(size <= WIDE)
    total = np.cumsum(size[rest])
    lo = 0
    while lo < len(rest):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 4 * WIDE, "right")))
        some = rest[lo:hi]
        of, nth = _runs(size[some])
        g = some[of]
        pair = ids_a[begin_a[g] + nth // n_b[g]] * SHIFT + ids_b[begin_b[g] + nth % n_b[g]]
        both, times = np.unique((doc[g] << np.int64(32)) | pair, return_counts=True)
        parts.append((both >> np.int64(32), both & np.int64(0xFFFFFFFF), times))
        lo = hi
    if len(parts) == 1:
        return parts[0]
    return _summed(*[np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)])


class Digits:
    """Decimal ids as rows of bytes, left-justified."""

    def __init__(self, n: int):
        self.width = len(str(max(1, n - 1)))
        text = "".join(str(i).ljust(self.width) for i in range(n)).encode()
        self.rows = np.frombuffer(text, np.uint8).reshape(n, self.width)
        self.length = (self.rows != 32).sum(axis=1)


def spelled(ids_a, ids_b, end_a, end_b, doc_of_group, digits_a: Digits, digits_b: Digits, n_docs: int):
    """Groups of each document as ``a1,a2|b1;a3|b2,b3``: one string column."""
    if not len(ids_a):
        return pa.array([""] * n_docs, pa.large_string())
    n_a, n_b = np.diff(end_a, prepend=-1), np.diff(end_b, prepend=-1)
    done_a, done_b = np.cumsum(n_a), np.cumsum(n_b)
    place_a = np.arange(len(ids_a)) + np.repeat(done_b - n_b, n_a)
    place_b = np.arange(len(ids_b)) + np.repeat(done_a, n_b)
    n = len(ids_a) + len(ids_b)
    width = max(digits_a.width, digits_b.width) + 1
    table, length = np.empty((n, width), np.uint8), np.empty(n, np.int64)
    after = np.full(n, ord(","), np.uint8)
    after[place_a[end_a]] = ord("|")
    after[place_b[end_b]] = ord(";")
    last = np.flatnonzero(np.diff(doc_of_group, append=-1))  # each document's last group
    for ids, place, digits in ((ids_a, place_a, digits_a), (ids_b, place_b, digits_b)):
        table[place, : digits.width] = digits.rows[ids]
        length[place] = digits.length[ids]
    table[np.arange(n), length] = after
    length += 1
    length[place_b[end_b[last]]] -= 1
    data = table[np.arange(width) < length[:, None]]
    size = np.zeros(n_docs, np.int64)
    size[doc_of_group[last]] = np.diff(np.cumsum(length)[place_b[end_b[last]]], prepend=0)
    return pa.LargeStringArray.from_buffers(n_docs, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(data.tobytes()))


def pack_pairs(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Rising pair numbers and their times as gaps and times, seven bits a byte, low ones first."""
    values = np.empty(2 * len(pairs), np.uint64)
    values[0::2] = np.diff(pairs, prepend=0)
    values[1::2] = times
    size = np.ones(len(values), np.int64)
    for k in range(7, 63, 7):
        size += values >= np.uint64(1 << k)
    of, nth = _runs(size)
    out = (values[of] >> (7 * nth).astype(np.uint64)).astype(np.uint8) & 127
    out[nth + 1 < size[of]] |= 128
    return out.tobytes()


def pairs_of(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pair numbers (A id * 65536 + B id, rising) and their times: what ``pack_pairs`` packed."""
    raw = np.frombuffer(packed, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], ends[:-1] + 1))
    _, nth = _runs(ends + 1 - first)
    values = np.add.reduceat((raw & 127).astype(np.int64) << (7 * nth), first)
    return np.cumsum(values[0::2]), values[1::2]


def _aligned(path_a, path_b, block_bytes):
    def run(batches):
        read = reader(path_a, path_b)
        digits_a, digits_b = (Digits(len(x)) for x in read.length)
        part, block, held = TaskContext.get().partitionId(), 0, 0
        for batch in in_slices(batches, ["text"], SLICE_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            (ids_a, first_a), (ids_b, first_b) = read(texts)
            ends_a, ends_b = np.cumsum(read.length[0][ids_a]), np.cumsum(read.length[1][ids_b])
            end_a, end_b = lockstep(*lanes(first_a, first_b, ends_a, ends_b), ends_a, ends_b)
            doc = np.searchsorted(first_a, end_a, "right") - 1
            groups = spelled(ids_a, ids_b, end_a, end_b, doc, digits_a, digits_b, len(texts))
            n_groups = np.bincount(doc, minlength=len(texts))
            size = np.diff(end_a, prepend=-1) * np.diff(end_b, prepend=-1)
            n_links = np.add.reduceat(np.append(size, 0), np.minimum(np.cumsum(n_groups) - n_groups, len(size))) * (n_groups > 0)
            of, pair, times = links(ids_a, ids_b, end_a, end_b, doc)
            cuts = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
            packed = [pack_pairs(pair[lo:hi], times[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
            if held > block_bytes:
                block, held = block + 1, 0
            held += sum(map(len, texts))
            columns = [batch.column("id"), pa.array(np.full(len(texts), (part << 32) + block))]
            columns += [pa.array(c.astype(np.int64)) for c in (np.diff(first_a), np.diff(first_b), n_groups, n_links)]
            yield pa.RecordBatch.from_arrays([*columns, groups.cast(pa.string()), pa.array(packed, pa.binary())], names=["id", "block", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    return run


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, ``pairs`` (see ``pairs_of``) and ``block``.

    A reads a blank and the text, B the text, before which it puts a blank itself. ``groups`` lists the ids
    between cuts, ``a1,a2|b1;a3|b2,b3``. A null or empty text, or one whose tokens' bytes are not a
    blank and the text, has no tokens. Keys may be null or repeated; each row is a document, and
    other columns are left out. An empty table gives no rows. Very long texts are cut into lanes,
    and a group of any size is counted by its distinct ids.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = "id long, block long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary"
    return rows.mapInArrow(_aligned(path_a, path_b, block_bytes), schema).withColumnRenamed("id", key)


def _block_pairs(batches):
    """Pairs of each block and how many of its documents hold them, as far as a task sees it."""
    schema = ["block", "pair", "docs"]

    def out(block, held):
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block)), pa.array(pair), pa.array(n)], schema)

    block, held = None, []
    for batch in batches:
        for b, packed in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist()):
            if b != block and held:
                yield out(block, held)
                held = []
            block = b
            held.append(pairs_of(packed)[0])
    if held:
        yield out(block, held)


def _weighed(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """Adds what the corpus-wide counts say about each document's links."""
    known, at = np.unique(np.asarray(counts.column("pair").combine_chunks()), return_index=True)
    n, best = (np.asarray(counts.column(c).combine_chunks())[at] for c in ("n", "best"))
    found = []
    for packed in rows.column("pairs").to_pylist():
        pair, times = pairs_of(packed)
        i = np.searchsorted(known, pair)
        found.append((int((times * best[i]).sum()), int((times * n[i]).sum())) if len(pair) else (0, 0))
    n_best, count_sum = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
    return rows.drop_columns(["block", "pairs"]).append_column("n_best", n_best).append_column("count_sum", count_sum)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Linked pairs of ids: ``pair`` (A id * 65536 + B id), ``n`` (documents that hold it) and ``best`` (1 if none of its A id's has more)."""
    held = aligned.select("block", "pairs").mapInArrow(_block_pairs, "block long, pair long, docs long")
    return _counted(held)


def _counted(held: DataFrame) -> DataFrame:
    totals = held.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 16))
    most = totals.groupBy("a").agg(F.max("n").alias("most"))
    return totals.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def weigh(aligned: DataFrame) -> DataFrame:
    """Rows of ``align`` with ``n_best`` (links whose pair is its A id's most common) and ``count_sum`` (documents of the pairs of all links).

    ``block`` and ``pairs`` are left out; other columns stay, but for columns of those names.
    ``aligned`` is read three times, so it should be a stored table.
    """
    held = stored(aligned.select("block", "pairs").mapInArrow(_block_pairs, "block long, pair long, docs long"))
    counts = stored(_counted(held))
    answers = held.select("block", "pair").join(counts, "pair")
    kept = [f for f in aligned.schema if f.name not in ("block", "pairs")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_best long, count_sum long"
    return aligned.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_weighed, schema)
