"""Token alignment against a plain walk with the tokenizers themselves."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyhouse.llm import crosstok, queries
from tallyhouse.llm.crosstok import align, pack_pairs, pair_counts, pairs_of, weigh

from .helpers import clashing, empty, odd

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
LETTERS = "abcABC 019 \n\t éßñ日本語 '.,!?▁<>|\x1c\xa0 😀"


@pytest.fixture(scope="module")
def read():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}

    def byte(i):
        piece = b.id_to_piece(i)
        return bytes.fromhex(piece[3:5]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        both = [(i, bytes(map(letters.get, a.id_to_token(i)))) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, byte(i)) for i in b.encode(text)]
        return both if all(b"".join(x for _, x in side) == (" " + text).encode() for side in both) else ([], [])

    return tokens


def groups_of(a, b):
    out, now, n_a, n_b = [], ([], []), 0, 0
    a, b = list(a), list(b)
    while a or b:
        if n_a <= n_b and a:
            i, x = a.pop(0)
            now[0].append(i)
            n_a += len(x)
        else:
            i, x = b.pop(0)
            now[1].append(i)
            n_b += len(x)
        if n_a == n_b:
            out.append(now)
            now = ([], [])
    return out


def expected(read, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, as by the query's contract."""
    groups = [groups_of(*read(t)) for t in texts]
    linked = [Counter((i, j) for a, b in g for i in a for j in b) for g in groups]
    count = Counter(p for c in linked for p in c)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [
        (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(m for p, m in c.items() if count[p] == best[p[0]]),
         sum(m * count[p] for p, m in c.items()), ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g))
        for g, c in zip(groups, linked)
    ]


def noise(n, seed=5):
    r = random.Random(seed)
    pool = ["".join(r.choice(LETTERS) for _ in range(r.randint(1, 12))) for _ in range(40)]
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(n)]


SPECIAL = ["<|endoftext|> <s>x</s> <unk>", " ", "a ", "  b", "don't we'll", "\n" * 300, " " * 300, "x" * 3000, "tab\tand\r\nline", "a▁b", "a\x00b"]


def test_same_as_a_plain_walk(spark, read):
    texts = [*noise(400), *SPECIAL, None, "", "hello world", "hello world"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    aligned = crosstok.stored(align(docs, A, B, block_bytes=500))
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in weigh(aligned).collect()}
    assert [got[i] for i in range(len(texts))] == expected(read, texts)
    assert aligned.select("block").distinct().count() > 3


def test_reader_reads_as_the_tokenizers_do(read, monkeypatch):
    monkeypatch.setattr(crosstok, "CACHE_WORDS", 200)
    monkeypatch.setattr(crosstok, "KEPT_WORDS", 50)
    reader = crosstok.Reader(A, B)
    for part in range(8):
        texts = [*noise(100, part), *SPECIAL, "plain words of a text and more of them", ""]
        for k, (ids, first) in enumerate(reader(texts)):
            assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [[i for i, _ in read(t)[k]] for t in texts]


def test_lanes_cut_long_texts_and_change_nothing(read, monkeypatch):
    text = " ".join(noise(300, 9)).replace("▁", "")
    reader = crosstok.Reader(A, B)
    (ids_a, first_a), (ids_b, first_b) = reader([text, "short"])
    ends = np.cumsum(reader.length[0][ids_a]), np.cumsum(reader.length[1][ids_b])
    one, many = (crosstok.lanes(first_a, first_b, *ends, lane=n) for n in (10**9, 16))
    assert len(one[0]) == 2 < len(many[0])
    for x, y in zip(crosstok.lockstep(*one, *ends), crosstok.lockstep(*many, *ends)):
        assert (x == y).all()


def test_wide_groups_count_each_id_once(monkeypatch):
    a, b = np.array([5, 5, 6, 5]), np.array([7, 8, 7])
    end_a, end_b, doc = np.array([2, 3]), np.array([1, 2]), np.array([0, 0])
    plain = crosstok.links(a, b, end_a, end_b, doc)
    monkeypatch.setattr(crosstok, "WIDE", 2)
    for x, y in zip(plain, crosstok.links(a, b, end_a, end_b, doc)):
        assert x.tolist() == y.tolist()


def test_packed_pairs_round_trip():
    r = random.Random(1)
    for n in (0, 1, 50):
        pairs = np.array(sorted(r.sample(range(1 << 32), n)), np.int64)
        times = np.array([r.choice([1, 2, 300, 1 << 40]) for _ in range(n)], np.int64)
        got = pairs_of(pack_pairs(pairs, times))
        assert got[0].tolist() == pairs.tolist() and got[1].tolist() == times.tolist()


def test_odd_rows_other_columns_and_empty_table(spark, read):
    docs = clashing(odd(spark))
    aligned = crosstok.stored(align(docs, A, B))
    texts = [r.text for r in docs.collect()]
    got = sorted((str(r.doc_id), r.n_links, r.n_best, r.count_sum, r.groups) for r in weigh(aligned).collect())
    assert got == sorted((str(r.doc_id), *x[3:]) for r, x in zip(docs.collect(), expected(read, texts)))
    none = crosstok.stored(align(empty(spark), A, B))
    assert weigh(none).count() == 0 and pair_counts(none).count() == 0


def test_query(spark, small, read):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = expected(read, [r.text for r in docs])
    got = queries.op11_alignment(spark, small).collect()
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *x[:6], digest(x[6])) for r, x in zip(docs, want))
