"""Decontamination against the full edit distance table."""

import random

import pytest

from pyspark.sql import functions as F

from tallyhouse.llm.leaks import ERROR_RATE, LEAST_EDITS, Matcher, edits_allowed, leaks, least_distance, plain, without_leaks

from .helpers import SENTENCE, clashing, empty, odd


def table_distance(item, text):
    last = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        last = row
    return min(last)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("seed", range(20))
def test_bit_vectors_and_pieces_find_what_the_table_finds(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abc ") for _ in range(n)).strip() or "a"
    for _ in range(20):
        item, text = plain(word(r.randint(1, 40))) or "a", plain(word(r.randint(0, 80)))
        if r.random() < 0.7:
            changed = [c if r.random() > 0.1 else r.choice(["", "x", c + "y"]) for c in item]
            text = f"{text} {''.join(changed)} {text}"
            text = plain(text)
        distance = table_distance(item, text)
        assert least_distance(item, text) == distance
        for rate in (0.0, 0.1, 0.3):
            found = Matcher([(1, item)], rate)(text)
            assert found == ([(1, distance)] if distance <= int(len(item) * rate) else []), (item, text, rate)


def test_edited_passages_are_found_and_others_are_not(spark):
    item = SENTENCE
    changed = item.replace("river", "RIVER,").replace("quiet", "quit").replace("birds", "birdz")
    docs = spark.createDataFrame([(1, f"before. {changed}\nafter"), (2, item[: len(item) // 2]), (3, "nothing here")], "doc_id long, text string")
    got = leaks(docs, items(spark, [(5, item), (5, item), (6, None), (7, ""), (8, "...")]))
    assert [(r.doc_id, r.item_id, r.distance) for r in got.collect()] == [(1, 5, 2)]
    assert 2 <= int(len(plain(item)) * ERROR_RATE)


SHORT = "the old mill by the river had been empty for many years when she came to live there"


def test_replaced_words_are_found_in_short_items(spark):
    changed = [SHORT.replace("empty", "deserted"), SHORT.replace("river", "harbour").replace("years", "winters"), SHORT.replace("she", "suddenly she"), SHORT]
    other = "she had been to the old mill many times by the river and came there for years to live"
    docs = spark.createDataFrame([(i, f"something before {t}. and after") for i, t in enumerate([*changed, other])], "doc_id long, text string")
    got = {r.doc_id: r.distance for r in leaks(docs, items(spark, [(5, SHORT)])).collect()}
    assert got.keys() == {0, 1, 2, 3} and got[2] == 9 and got[3] == 0
    assert [r.doc_id for r in without_leaks(docs, items(spark, [(5, SHORT)])).collect()] == [4]


def test_edits_are_counted_in_characters():
    item = "über den flüssen hängen müde nebel und drüben träumt ein kühles dörfchen für sich"
    text = item.replace("ü", "и").replace("ä", "д")  # eight letters of two bytes become others
    assert Matcher([(1, item)], 0.12)(f"vor {text} nach") == [(1, 8)]


@pytest.mark.parametrize("seed", range(10))
def test_agreeing_pieces_lose_nothing(seed):
    r = random.Random(seed)
    for _ in range(30):
        item = plain("".join(r.choice("abcdef é ") for _ in range(r.randint(3, 90)))) or "a"
        budget = edits_allowed(len(item), 0.0)
        chars = list(item)
        for _ in range(r.randint(0, budget + 2)):
            at = r.randrange(len(chars)) if chars else 0
            chars[at : at + 1] = r.choice(["", "x", "yz", chars[at] + "w"]) if chars else "x"
        text = plain("".join(r.choice("abcdef ") for _ in range(r.randint(0, 60))) + "".join(chars) + item[: len(item) // 2])
        distance = table_distance(item, text)
        assert Matcher([(1, item), (2, item)], 0.0, LEAST_EDITS)(text) == ([(1, distance), (2, distance)] if distance <= budget and text else []), (item, text)


def test_many_item_blocks_give_the_same(spark, small, monkeypatch):
    from tallyhouse.llm import leaks as module

    docs, tests = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(tuple(r) for r in leaks(docs, tests).collect())
    monkeypatch.setattr(module, "ITEM_BYTES", 2000)
    assert sorted(tuple(r) for r in leaks(docs, tests).collect()) == whole and whole
    held = {r[0] for r in whole}
    assert without_leaks(docs, tests).filter(F.col("doc_id").isin(*held)).count() == 0
    assert without_leaks(docs, tests).count() == docs.filter(~docs.doc_id.isin(*held)).count()


def test_odd_rows(spark):
    docs, tests = clashing(odd(spark)), items(spark, [(1, SENTENCE), (None, "ONE"), (3, None)])
    got = leaks(docs, tests)
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in got.collect()) == [(0, 1), (3, 1), (4, 1), (4, 1), (6, 0), (7, 0)]
    left = without_leaks(docs, tests)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 5, 8, 9, 10, 11]
    assert without_leaks(docs, items(spark, [])).count() == docs.count()
    assert leaks(empty(spark), tests).count() == 0
