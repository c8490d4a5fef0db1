"""Near copies against all pairs."""

from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import nearcopies
from tallyhouse.llm.nearcopies import estimate, near_copies, one_of_each, registers

from .helpers import clashing, empty, near, odd, rows, variants


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def result(df):
    return rows(df.select("doc_id", "n_shingles", "component_id"))


@pytest.mark.parametrize("edits", [(0, 4), (0, 30), (3, 9), (5, 12)])
def test_same_as_all_pairs(spark, edits):
    texts = [t for seed in range(4) for t in variants(25, seed, edits=edits)] + [t for s in range(20) for t in variants(3, 100 + s, 8, (0, 2))]
    got = near_copies(frame(spark, texts))
    assert result(got) == Counter(near(list(enumerate(texts))))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_a_chain_whose_ends_differ(spark):
    words = [f"w{i}" for i in range(200)]
    texts = []
    for step in range(12):
        texts.append(" ".join(words[step * 8 : step * 8 + 100]))
    assert result(near_copies(frame(spark, texts[::-1]))) == Counter(near(list(enumerate(texts[::-1]))))


def test_odd_rows(spark):
    docs = odd(spark)
    assert result(near_copies(docs)) == Counter(near([(r.doc_id, r.text) for r in docs.collect()]))


def test_one_of_each_keeps_columns_and_single_rows(spark):
    docs = clashing(odd(spark))
    left = one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 5, 6, 8, 9, 10, 11]


def test_empty_tables(spark):
    assert near_copies(empty(spark)).count() == 0
    assert one_of_each(empty(spark)).count() == 0


def test_estimates_are_close_and_corrected_for_chance():
    draw = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        common, a, b = (draw.integers(0, 2**63, n).astype(np.uint64) for n in (300, 50, 50))
        x, y = np.unique(np.concatenate((common, a))), np.unique(np.concatenate((common, b)))
        r = registers([x, y])
        errors.append(float(estimate(r[:1], r[1:], np.array([len(x)]), np.array([len(y)]))[0]) - 0.75)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    assert 0 < nearcopies.chance(np.array([10**6]), np.array([10**6]))[0] < 0.002


def test_small_sets_are_compared_in_full_whatever_their_estimate():
    import numpy as np
    import pyarrow as pa

    from tallyhouse.llm.nearcopies import REGISTERS, _likely

    a, b = np.zeros(REGISTERS, np.uint16).tobytes(), np.ones(REGISTERS, np.uint16).tobytes()
    rows = {"a": [1, 2, 3], "b": [11, 12, 13], "n_a": [4, 4, 400], "n_b": [3, 2, 300], "sketch_a": [a] * 3, "sketch_b": [b] * 3}
    (out,) = _likely([pa.RecordBatch.from_pydict(rows)])
    assert out.column("a").to_pylist() == [1]
