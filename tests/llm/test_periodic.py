"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyhouse.llm import periodic, queries
from tallyhouse.llm.periodic import mark_runs

from .helpers import clashing, empty, odd, words


def runs(w, least=6, exponent=4):
    """(start, length, period), by start and period."""
    best = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, exponent * q):
                best.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def expected(text, least=6, exponent=4):
    w = words(text)
    found = runs(w, least, exponent)
    return len(w), found, collapsed(w, found)


def noise(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        letters, text = r.choice(["ab", "abcde", [f"w{i}" for i in range(40)]]), []
        for _ in range(r.randint(0, 5)):
            unit = [r.choice(letters) for _ in range(r.randint(1, 9))]
            text += (unit * r.randint(1, 7))[: r.randint(1, 60)] + [r.choice(letters) for _ in range(r.randint(0, 6))]
        out.append("  \n".join(text))
    return out


def got(frame):
    return [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in frame.orderBy("doc_id").collect()]


@pytest.mark.parametrize("least, exponent", [(6, 4), (3, 4), (12, 6)])
def test_same_as_a_search_over_all_periods(spark, least, exponent):
    texts = [*noise(400, least), "a " * 500, "a b c " * 200, " ".join(f"w{i % 200}" for i in range(900)), "x " + "y " * 40 + "z " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(mark_runs(docs, least=least, exponent=exponent)) == [expected(t, least, exponent) for t in texts]


def test_small_steps_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic, "AT_ONCE", 7)
    for text in noise(60, 11):
        w = words(text)
        numbers = np.array([hash(x) & 0xFFFFFFFF for x in w], np.uint64)
        start, end, period = periodic.runs_of(numbers, np.zeros(len(w), np.int64))
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == runs(w)


def test_grammar_spells_the_text_and_uses_each_symbol_twice():
    r = random.Random(4)
    symbols = np.array([r.randrange(6) for _ in range(3000)] + [7 + r.randrange(3) for _ in range(500)])
    text = np.repeat([0, 1], [3000, 500])
    g = periodic.Grammar(symbols, text)

    def spell(x):
        return [x] if x < g.base else spell(int(g.left[x - g.base])) + spell(int(g.right[x - g.base]))

    assert [y for x in g.symbols.tolist() for y in spell(x)] == symbols.tolist()
    rules = np.arange(g.base, len(g.size))
    number, place = g.everywhere(rules)
    assert (np.bincount(number, minlength=len(rules)) >= 2).all()
    for x in rules[:50].tolist():
        spelled = spell(x)
        for p in place[number == x - g.base].tolist():
            assert symbols[p : p + len(spelled)].tolist() == spelled


def test_odd_rows_other_columns_and_empty_table(spark):
    docs = clashing(odd(spark))
    found = mark_runs(docs)
    assert found.columns == [*[c for c in docs.columns if c != "n_words"], "n_words", "runs", "collapsed"]
    have = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
    assert have == sorted((str(r.doc_id), *expected(r.text)) for r in docs.collect())
    assert mark_runs(empty(spark)).count() == 0


def looped(key, w):
    h = zlib.crc32(str(key).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query(spark, small):
    want = []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        w = looped(r.doc_id, words(r.text))
        found = runs(w)
        start, length, period = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((r.doc_id, len(found), start, length, period, length * 1000 // period if found else None, sha(lines), sha(collapsed(w, found))))
    assert sorted(map(tuple, queries.op12_periodic_runs(spark, small).collect())) == sorted(want)
    assert sum(x[1] for x in want) > 5


def test_query_on_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert len(rows) == odd(spark).count()
    assert all(r.runs_sha256 and r.collapsed_sha256 for r in rows)
