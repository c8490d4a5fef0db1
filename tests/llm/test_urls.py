"""URL filter: rules exactly, the models against plain Python, no Python in the plan."""

import io
import math
from collections import Counter
from contextlib import redirect_stdout

import pytest

from tallyhouse.llm.queries import URL_RULES
from tallyhouse.llm.urls import ORDER, START, Rule, judge, limit_of, model

RULES = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"),
    ("https://Example.ORG/es/1?q#f", "example.org", "/es/1", "example.org/es/", "block"),
    ("https://www.example.org/en/12", "www.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://www.example.org/en/2", "www.example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("x://com/fr/", "com", "/fr/", "com/fr/", "allow"),
    ("x://b.com/de/y", "b.com", "/de/y", "com/de/", "block"),
    ("http://a.org", "a.org", "", None, None),
    ("http://a.org?x=/y", "a.org", "", None, None),
    ("http://u://v/w", "u:", "//v/w", None, None),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://É.org/\n/x", "É.org", "/\n/x", "org/", "allow"),
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, r[0], "mine", "mine") for i, r in enumerate([*RULES, *RULES[:1]])], "page_id long, url string, score string, gram string")
    got = judge(pages, URL_RULES)
    assert got.columns == ["page_id", "url", "gram", "host", "path", "rule", "verdict", "score"]
    by = {r.page_id: r for r in got.collect()}
    assert len(by) == len(RULES) + 1
    for i, (_, host, path, rule, verdict) in enumerate(RULES):
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule)
        assert by[i].verdict == verdict or verdict is None and by[i].verdict in ("allow", "block")
    assert judge(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in judge(pages, []).collect()} == {"allow"}


def test_model_is_interpolated_witten_bell(spark):
    allow, block, other = ["abab", "abc"], ["xyx", "aby"], ["azb"]
    counts = Counter()
    for side, words in (("allow", allow), ("block", block), ("", other)):
        for w in words:
            padded = START * ORDER + w
            for i in range(len(w)):
                counts[padded[i : i + ORDER + 1], side] += 1
    grams = sorted({g for g, _ in counts})
    table = spark.createDataFrame([(g, counts[g, "allow"], counts[g, "block"]) for g in grams], "gram string, allow long, block long")

    def p(g, side):
        if len(g) == 1:
            letters = {x[-1] for x in grams}
            of = sum(n for (x, s), n in counts.items() if s == side and x[-1] == g)
            return (of + 1) / (sum(n for (_, s), n in counts.items() if s == side) + len(letters) + 1)
        seen = Counter()
        for (x, s), n in counts.items():
            if s == side:
                seen[x[-len(g) :]] += n
        same = [n for x, n in seen.items() if x[:-1] == g[:-1] and n]
        below = p(g[1:], side)
        return (seen[g] + len(same) * below) / (sum(same) + len(same)) if same else below

    got = {r.gram: r.ratio for r in model(table).collect()}
    assert got == {g: pytest.approx(math.log(p(g, "allow")) - math.log(p(g, "block"))) for g in grams}


def test_limit_splits_the_examples(spark):
    rows = [(0.5 + i / 10, "allow") for i in range(5)] + [(-0.2 - i / 10, "block") for i in range(5)]
    assert -0.2 < limit_of(spark.createDataFrame(rows, "score double, label string")) < 0.5
    assert limit_of(spark.createDataFrame(rows[:5], "score double, label string")) == 0.0


def test_held_out_urls_and_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rules = [Rule("block", "spam-farm.example.org", "/"), Rule("block", "www.cheap-pills.example.com", "/"), Rule("allow", "net", "/")]
    got = judge(pages, rules)
    out = io.StringIO()
    with redirect_stdout(out):
        got.explain("formatted")
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue() and "CartesianProduct" not in out.getvalue()
    spam = got.filter("url like '%pills%' or url like '%spam-farm%'").groupBy("verdict").count().collect()
    assert [r.verdict for r in spam] == ["block"]
