"""Substring dedup against a plain walk over all windows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyhouse.llm import repeats
from tallyhouse.llm.repeats import cut_repeats

from .helpers import clashing, cut, empty, odd, rows


def documents(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def noise(seed, n=60):
    r = random.Random(seed)
    alphabet = [f"w{i}" for i in range(6)]
    pool = [" ".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [r.choice(pool) if r.random() < 0.5 else " ".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 5))]
        texts.append("  \n".join(parts))
    return texts


@pytest.mark.parametrize("size, rounds", [(35, repeats.ROUNDS), (12, repeats.ROUNDS), (5, ("pair", "run", "pair"))])
def test_same_as_a_walk_over_all_windows(spark, size, rounds):
    texts = [*noise(size), "a " * 100, "a b " * 50, "a b c " * 30, "x " + "a " * 40]
    got = cut_repeats(documents(spark, texts), window=size, rounds=rounds, block_bytes=2000)
    want = Counter((i, *x) for i, x in enumerate(cut(texts, size)))
    assert rows(got.select("doc_id", "n_words", "n_removed", "kept")) == want
    assert sum(x[2] for x in want) > 0


def test_odd_rows_and_other_columns(spark):
    docs = clashing(odd(spark))
    got = cut_repeats(docs)
    assert got.columns == [*[c for c in docs.columns if c not in ("n_words", "kept")], "n_words", "n_removed", "kept"]
    texts = [r.text for r in docs.collect()]
    want = Counter((r.doc_id, *x) for r, x in zip(docs.collect(), cut(texts)))
    assert rows(got.select("doc_id", "n_words", "n_removed", "kept")) == want
    assert {r.block for r in got.select("block").collect()} == {"mine"}


def test_empty_table(spark):
    assert cut_repeats(empty(spark)).count() == 0


def test_equal_windows_choose_equal_symbols():
    shared = " ".join(f"s{i}" for i in range(40))
    column = pa.array([f"a b c {shared} d e", f"q {shared}", None, ""])
    p = repeats.Parsed(column, 35)
    a, b = (int(np.flatnonzero(p.text == t)[0]) for t in (0, 1))
    assert (p.chosen[a + 3 : a + 9] == p.chosen[b + 1 : b + 7]).all() and (p.chosen[a + 3 : a + 9] != repeats.NONE).all()
