"""The pipeline, stage by stage."""

from collections import Counter

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from tallyhouse.llm.leaks import Matcher
from tallyhouse.llm.language import fit, identify

from .helpers import SENTENCE, clashing, cut, empty, near, odd


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    assert "pipeline" in queries()


def test_each_stage_does_its_whole_work(spark, small):
    """Every stage's rows against brute force on its own input; the packing has tests of its own."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    accepted = {r.doc_id for r in identify(docs, fit(docs)).filter("accepted").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns
        if name == "language_id":
            assert set(after) == accepted
        elif name == "near_dedup":
            assert set(after) == {k for k, _, c in near([(k, r.text) for k, r in before.items()]) if k == c}
        elif name == "substring_dedup":
            want = {k: x for k, x in zip(before, cut([r.text for r in before.values()])) if x[1] == 0 or x[1] < x[0]}
            assert {k: r.text for k, r in after.items()} == {k: x[2] if x[1] else before[k].text for k, x in want.items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            match = Matcher(items)
            assert set(after) == {k for k, r in before.items() if not match(r.text)}
            assert len(after) < len(before)
        before = after
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, small).collect()} == set(before)


def test_run_is_its_stages(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


@pytest.mark.parametrize("make", [odd, empty, lambda s: clashing(odd(s))])
def test_odd_rows(spark, small, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, small)
        assert left.columns == docs.columns
        docs = spark.createDataFrame(left.collect(), left.schema)
    assert corpus_pipeline.packing(spark, docs, small).count() >= docs.count()
    assert docs.filter(docs.text == SENTENCE).count() <= 1


def test_a_passage_in_all_documents_is_cut_from_all(spark, small):
    rows = [(i, f"{' '.join(f'a{i}x{j}' for j in range(60))} {SENTENCE}", "en", "s", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.substring_dedup(spark, docs, small).collect()
    assert Counter(len(r.text.split()) for r in got) == {60: 5}
