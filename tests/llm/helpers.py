"""Odd documents that every operator has to take, and plain-Python twins of operators."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SENTENCE = "the river ran past an old mill where nobody had lived for many quiet years and still the wheel turned slowly in green water while small birds nested under its broken roof each spring without any fear of people at all"

ODD = [
    (1, None, "en", "a.example.de", 0),
    (2, "", None, None, 0),
    (None, SENTENCE, "en", None, 9),
    (3, SENTENCE, "en", "a.example.de", 9),
    (4, SENTENCE, None, "b.example.de", 9),
    (4, SENTENCE, None, "b.example.de", 9),
    (5, " \t\n\x0b ", "x!", "", 5),
    (6, "one", "en-GB", "c", 3),
    (7, "ONE", "EN", "c", 3),
    (8, "x y " * 300, "en", "c", 1200),
    (9, "ab" * 60_000, "en", "c", 120_000),
    (10, " ".join(f"w{i}" for i in range(20_000)), "en", "c", 100_000),
    (11, "ÄÖ é 日本語 ß İ   x", "de", "https://a.fr/x", 9),
    (None, None, None, None, None),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def clashing(df):
    """With columns named like the operators' own and their working ones."""
    for name in ("block", "v", "id", "n", "n_words", "kept", "language", "host", "row", "_row", "text_key", "component_id", "length", "quality", "tags", "b.c"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("mine"))
    return df


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def words(text, fold=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text) if fold else text)


def cut(texts, size=35):
    """(words, removed, kept text) of each text."""
    seen = Counter(tuple(w[p : p + size]) for w in map(words, texts) for p in range(len(w) - size + 1))
    out = []
    for w in map(words, texts):
        keep = [True] * len(w)
        for p in range(len(w) - size + 1):
            if seen[tuple(w[p : p + size])] > 1:
                keep[p : p + size] = [False] * size
        out.append((len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k)))
    return out


def shingles(text):
    w = words(text, fold=True)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(documents):
    """(id, shingles, component) of each (id, text)."""
    sets = [shingles(t) for _, t in documents]
    having = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            having[x].append(i)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in having[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(documents):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(documents)]


def variants(n, seed, base_words=120, edits=(0, 30)):
    """Texts around one base, with different numbers of changed words."""
    import random

    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(*edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out
