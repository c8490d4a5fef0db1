"""Cross-entropy difference against models built in plain Python."""

import math
from collections import Counter

import pytest

from tallyhouse.llm.lmscore import ORDER, cross_entropy_difference, grams

from .helpers import clashing, empty, odd


def model(texts):
    counts = [Counter() for _ in range(ORDER + 1)]
    for t in texts:
        for g in grams(t).tolist():
            for k in range(1, ORDER + 1):
                counts[k][g & ((1 << 8 * k) - 1)] += 1
    context, types = [Counter() for _ in range(ORDER + 1)], [Counter() for _ in range(ORDER + 1)]
    for k in range(1, ORDER + 1):
        for g, n in counts[k].items():
            context[k][g >> 8] += n
            types[k][g >> 8] += 1

    def p(g, k):
        if k == 0:
            return 1 / 256
        g &= (1 << 8 * k) - 1
        below, n, t = p(g, k - 1), context[k][g >> 8], types[k][g >> 8]
        return (counts[k][g] + t * below) / (n + t) if n else below

    return p


def brute(rows, targets):
    background, target = model([t for _, t in rows]), model([t for k, t in rows if k in targets])
    out = []
    for key, text in rows:
        g = grams(text).tolist()
        score = sum(math.log(background(x, ORDER)) - math.log(target(x, ORDER)) for x in g) / len(g) if g else None
        out.append((key, len(g), score))
    return out


def compare(got, want):
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for a, b in zip(got, want):
        assert (a[2] is None) == (b[2] is None) and (a[2] is None or a[2] == pytest.approx(b[2], abs=1e-5))


@pytest.mark.parametrize("frequent", [1 << 20, 200, 0])
def test_same_as_plain_models(spark, small, frequent):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").filter("length(text) < 1500")
    rows = [tuple(r) for r in docs.collect()]
    targets = {k for k, _ in rows if k % 5 == 0}
    got = cross_entropy_difference(docs, spark.createDataFrame([(k,) for k in targets], "doc_id long"), frequent=frequent)
    compare(got.collect(), brute(rows, targets))


def test_odd_rows_and_empty_tables(spark):
    docs = clashing(odd(spark)).filter("doc_id is null or doc_id not in (9, 10)")
    targets = spark.createDataFrame([(3,), (3,), (None,), (99,)], "doc_id long")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = cross_entropy_difference(docs, targets)
    assert got.columns == ["doc_id", "n_tokens", "score"]
    compare(got.collect(), brute(rows, {3}))
    compare(cross_entropy_difference(docs, targets.limit(0)).collect(), brute(rows, set()))
    assert cross_entropy_difference(empty(spark), targets).count() == 0


def test_target_like_text_scores_lower(spark):
    rows = [(i, "abcabcabc abc") for i in range(5)] + [(10 + i, "xyz zyx zzxy") for i in range(20)] + [(50, "abc abcabc"), (51, "zyx xyz")]
    targets = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    got = {r.doc_id: r.score for r in cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), targets).collect()}
    assert got[50] < 0 < got[51]
