"""Quality: held-out accuracy, and shrinkage of sites."""

import numpy as np
import pytest

from tallyhouse.llm.quality import Classifier, fit, rate, strength
from tallyhouse.llm.grams import FEATURES

from .helpers import SENTENCE, clashing, empty, odd


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(tables):
    docs, labels = tables
    model = fit(docs, labels.filter("doc_id % 2 = 0"))
    held = labels.filter("doc_id % 2 = 1").select("doc_id", "quality").withColumnRenamed("quality", "truth")
    got = rate(docs, model).join(held, "doc_id").select("truth", "good").toPandas()
    assert (got.good[got.truth == 1]).mean() > 0.98
    assert (~got.good[got.truth == 0]).mean() > 0.7


def test_sparse_sites_shrink_and_large_ones_speak(spark):
    weights = np.zeros(FEATURES, np.float32)
    from tallyhouse.llm.grams import features

    weights[features("good good", False)] = 1
    weights[features("bad bad", False)] = -1
    model = Classifier(weights, 3.0, 0.0)
    rows = [(i, "good good", "p", "g", 1) for i in range(60)] + [(100 + i, "bad bad", "p", "b", 1) for i in range(60)]
    rows += [(200, "zzz", "p", "g", 1), (201, "zzz", "p", "b", 1), (202, "zzz", "p", "new", 1), (203, None, "p", "g", 1), (204, "", None, None, 1)]
    got = {r.doc_id: r for r in rate(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), model).collect()}
    assert got[200].quality > 0.8 and got[201].quality < 0.2 and 0.35 < got[202].quality < 0.65
    assert got[203].quality == pytest.approx(got[203].site_quality) and got[203].good


def test_groups_that_differ_by_chance_only_get_the_strongest_prior(spark):
    groups = spark.createDataFrame([(5.0, 5.0, 10, 0.5), (5.0, 5.0, 10, 0.5)], "s double, ss double, n long, up double")
    assert strength(groups, "s", "ss", "n", "up") == 1e4


def test_odd_rows_and_empty_tables(spark, tables):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1), (6, None), (7, 9)], "doc_id long, quality int")
    docs = clashing(odd(spark))
    got = rate(docs, fit(docs, labels))
    assert got.columns == [*[c for c in docs.columns if c != "quality"], "text_quality", "site_quality", "quality", "good"]
    assert got.count() == docs.count() and all(0 < r.quality < 1 for r in got.collect())
    none = fit(empty(spark), labels)
    assert rate(empty(spark), none).count() == 0
    assert {r.quality for r in rate(odd(spark), fit(odd(spark), labels.limit(0))).select("quality").collect()} == {0.5}
    assert SENTENCE
