"""Packing: every token once, gapless, few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyhouse.llm.packing import Places, _best_fit, configurations, ids_of, linear_program, pack, token_bytes

from .helpers import clashing, empty, odd

PATH = public_tokenizers.path("word_bpe_49k.json")


def encoded(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "It's a dog. I'LL 'tis DON'T", "<|endoftext|> a", "Σας ΟΔΟΣ", "İstanbul ſ ß ẞ", "a\x1cb", "a\x00b\x85c\xa0d", "é $5²½", "", "  ",
    "日本語 テスト", "don’t", "x" * 500, "ab_c__d9.9", "a　b", "###***&&& 12,345.60", "Thé ÉCOLE straße",
])
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(token_bytes([text], PATH)[0], "<u4").tolist() == encoded(text)


def check_packed(docs, packed, capacity):
    want = Counter()
    for r in docs.collect():
        ids = [*encoded(r.text), 0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[(r.doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by), sum(r.length for r in got)


def test_odd_rows_round_trip(spark):
    docs = clashing(odd(spark))
    packed = pack(docs, with_ids=True)
    check_packed(docs, packed, 2048)
    assert all(zlib.crc32(np.array(ids_of(bytes(r.ids)), "<u4").tobytes()) == r.ids_crc32 for r in packed.collect())


def test_given_documents_leave_almost_no_gap(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(3)
    sequences, tokens = check_packed(docs, pack(docs), 2048)
    assert sequences <= -(-tokens // 2048) + 2


def test_small_capacity_and_empty_table(spark):
    docs = odd(spark).filter("doc_id < 9")
    check_packed(docs, pack(docs, capacity=7), 7)
    assert pack(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_configurations_hold_every_piece_once(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 100): r.randint(1, 10 ** r.randint(0, 5)) for _ in range(r.randint(1, 60))}
    configs = configurations(counts, 100)
    held = Counter()
    for items, times in configs:
        assert sum(x * a for x, a in items.items()) <= 100 and times > 0
        for x, a in items.items():
            held[x] += a * times
    assert held == Counter(counts)
    _, bound = linear_program(counts, 100)
    total = sum(t for _, t in configs)
    assert bound - 1e-6 <= total <= len(counts) + sum(n for x, n in counts.items() if x > 50) + sum(n * x for x, n in counts.items() if x <= 50) / 50
    places = Places(configs)
    for x, n in counts.items():
        ranks = np.arange(min(n, 1000))
        sequence, offset = places.of(np.full(len(ranks), x), ranks)
        assert len(set(zip(sequence.tolist(), offset.tolist()))) == len(ranks) and (offset + x <= 100).all()


@pytest.mark.parametrize("seed", range(4))
def test_no_worse_than_best_fit_and_near_the_bound_with_many_lengths(seed):
    r = random.Random(seed)
    counts = Counter(min(2047, int(r.expovariate(1 / 500)) + 1) for _ in range(30_000))
    total = sum(t for _, t in configurations(counts))
    assert total <= sum(t for _, t in _best_fit(counts, 2048)) and total <= linear_program(counts)[1] + 3


def test_lengths_over_half_stand_alone():
    assert sum(t for _, t in configurations({60: 1000, 55: 7}, 100)) == 1007
