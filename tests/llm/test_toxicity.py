"""Toxicity: held-out labels, misspellings, and the vectorised parts against plain Python."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyhouse.llm import queries, toxicity
from tallyhouse.llm.toxicity import fit, score

from .helpers import clashing, empty, odd

BAD = ["blorgface", "zwickelnase", "grumpfutter"]


def corpus(n, seed=3):
    """(id, text, toxic): texts of random syllables, of which one in five has bad words, in long texts one in fifty words."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = ["".join(r.choice(["an", "der", "li", "mo", "tes", "ru"]) for _ in range(r.randint(1, 4))) for _ in range(r.choice([8, 60, 400]))]
        toxic = int(r.random() < 0.2)
        if toxic:
            for _ in range(1 + len(w) // 50):
                w[r.randrange(len(w))] = r.choice(BAD) + r.choice(["", "s", "!", ","])
        out.append((i, " ".join(w), toxic))
    return out


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    return rows, docs, fit(docs, labels, bound=400)


def test_held_out_texts_and_misspellings(spark, trained):
    rows, docs, model = trained
    got = {r.doc_id: r for r in score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r, _ in held)
    caught = [r.predicted for r, y in held if y]
    clean = [r.predicted for r, y in held if not y]
    assert np.mean(caught) > 0.9 and np.mean(clean) < 0.02
    texts = ["der li blorgfase moan", "anli blurgface rumo tes", "LIDER BLORGFACE", "der li moan tesru", "anli rumo tes"]
    scores = model.scores(pa.array(texts))
    assert scores[:3].min() > scores[3:].max()


def test_scores_are_means_of_subword_weights(trained):
    _, _, model = trained
    texts = ["Der  moan, blorgface!", "über über", "", None, "...", "x" * 5000]

    def bucket_weights(word):
        data = np.frombuffer(word, np.uint8)
        _, buckets = toxicity.subwords(data, np.array([0]), np.array([len(data)]))
        marked = len(word) + 2
        assert len(buckets) == 1 + sum(max(0, marked - n + 1) for n in toxicity.NGRAMS)
        return model.weights[buckets].astype(float).mean()

    for text, got in zip(texts, model.odds(pa.array(texts))):
        plain = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in (text or "").encode()).lower()
        words = plain.split()
        want = model.bias + (np.mean([bucket_weights(w) for w in words]) if words else 0)
        assert got == pytest.approx(want, abs=1e-5)


def test_equal_texts_and_slices_score_alike(trained):
    _, _, model = trained
    texts = [t for _, t, _ in corpus(50, 8)]
    whole = model.scores(pa.array(texts))
    assert np.allclose(whole, [model.scores(pa.array([t]))[0] for t in texts])
    assert np.allclose(whole[10:20], model.scores(pa.array(texts)[10:20]))


def test_without_labels_of_both_kinds(spark, trained):
    _, docs, _ = trained
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert set(np.round(fit(docs, none).scores(pa.array(["a", ""])), 6)) == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(50)] + [(None, 0), (3, 7)], "doc_id long, toxic int")
    assert fit(docs, ones).scores(pa.array(["a"]))[0] > 0.9
    assert 0.4 < fit(empty(spark), none).scores(pa.array(["a"]))[0] < 0.6


def test_odd_rows_other_columns_and_empty_table(spark, trained):
    _, _, model = trained
    docs = clashing(odd(spark))
    got = score(docs, model)
    assert got.columns == [*docs.columns, "score", "predicted"]
    assert got.count() == docs.count() and got.filter("score is null or isnan(score)").count() == 0
    assert score(empty(spark), model).count() == 0


def test_query_holds_out_a_third(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op13_toxicity(spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.score, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    toxic, clean = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.6  # of 33 toxic texts learned from
