"""Language identification: accuracy on held-out rows, and the evidence beside the text."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyhouse.llm.language import NONE, Model, fit, host_of, identify, suffix_of

from .helpers import clashing, empty, odd


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return fit(docs.filter("doc_id % 2 = 0"))


def test_held_out_accuracy_of_the_text_alone(docs, model):
    held = docs.filter("doc_id % 2 = 1")
    got = identify(held, model, declared=None, address=None).collect()
    assert np.mean([r.lang == r.language for r in got]) >= 0.98
    assert all(r.accepted for r in got)


def test_every_declared_language_has_a_model_at_every_size(spark, docs):
    """One language in a script of its own and 80 more of one document each, beside many times the bound."""
    greek = "το ποτάμι κυλούσε δίπλα στον παλιό μύλο και κανείς δεν ζούσε εκεί για πολλά ήσυχα χρόνια "
    names = [f"{a}{b}q" for a in "abcdefgh" for b in "abcdefghij"]
    rare = [(-1 - i, " ".join(f"{n}{x}o" for x in "klmnp") + " " + n, n) for i, n in enumerate(names)]
    rare += [(10**6 + i, greek * (i + 1), "el") for i in range(3)]
    table = docs.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    model = fit(table, bound=20)
    assert set(model.languages) == {"en", "de", "fr", "es", "el", *names}
    got = identify(table.filter("lang = 'el'"), model, declared=None, address=None).collect()
    assert {(r.language, r.accepted) for r in got} == {("el", True)}


def test_a_label_of_copies_keeps_its_model(spark, docs):
    copies = spark.range(60).select(F.lit("αβγ δεζ ηθι").alias("text"), F.lit("el").alias("lang"))
    assert "el" in fit(docs.select("text", "lang").unionAll(copies), bound=1).languages


def test_declaration_and_host_decide_where_the_text_says_little(spark, model):
    host = lambda lang, n, h: [(i, t, lang, h, 1) for i, t in enumerate([long_text(lang)] * n)]
    rows = host("de", 30, "https://x.de/a") + host("fr", 30, "https://y.fr/b") + [(100, "an", None, "https://x.de/c", 1), (101, "an", None, "https://y.fr/d", 1), (102, "an", "en-GB", "https://z.org", 1), (103, "an", None, "https://new.fr/d", 1)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), model).filter("doc_id >= 100").collect()}
    assert got[100].language == "de" and got[101].language == "fr" and got[103].language == "fr"
    assert got[102].language == "en"


def long_text(lang):
    return {"de": "und der die ein schlichung heit keit verbeinen ", "fr": "que le la les eaux ouement tion elle "}[lang] * 5


def test_odd_rows(spark, model):
    rows = clashing(odd(spark))
    got = identify(rows, model)
    assert got.columns == [*[c for c in rows.columns if c != "language"], "language", "confidence", "accepted"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[4]) == 2 and by[4][0] == by[4][1]
    for key in (1, 2, 5):
        assert (by[key][0].language, by[key][0].confidence, by[key][0].accepted) == (NONE, 0.0, False)
    assert by[3][0].accepted and got.count() == rows.count()


def test_empty_tables(spark, model):
    assert identify(empty(spark), model).count() == 0
    blank = fit(empty(spark))
    assert blank.languages == ()
    assert {r.language for r in identify(odd(spark), blank).collect()} == {NONE}


def test_none_of_these():
    model = Model(("a",), np.full((1, 1 << 15), -30.0, np.float32))
    assert model.evidence(["some words"])[0].argmax() == 1


def test_address_parts(spark):
    rows = spark.createDataFrame([("https://A.b.DE/x?y",), ("src0",), (None,), ("http://h",)], "a string")
    host = host_of(F.col("a"))
    assert [tuple(r) for r in rows.select(host, suffix_of(host)).collect()] == [("a.b.de", "de"), ("src0", ""), ("", ""), ("h", "")]
