"""Near-duplicate documents by HyperMinHash.

A document is the set of its 5-word shingles. Documents with the same set form a class
and travel as one. A class has 126 registers: its shingle hashes are dealt to buckets, and
a register keeps, of the least hash in its bucket, the count of leading zeros and 10
mantissa bits (an empty bucket borrows from the first full one of a fixed random order).
Three registers make a band; at a similarity of 0.75 a pair shares none of 42 bands with a
chance of about 1e-10.

A band's bucket is never expanded into all its pairs. Its least class leads it, and every
member is paired with the leader. A pair is estimated from the registers, corrected for
chance collisions, and dropped if it is six standard errors below the threshold, unless the
smaller set has fewer shingles than there are registers; the rest is confirmed on full sets. Classes linked so far form components, and a link within one
changes nothing. Buckets that still hold several components hand their members to an
exact step: in the order of rising frequency, two sets above the threshold share a shingle
among the first 1/7 of the smaller and the first 1/4 of the larger, with enough of both
after it. Members that only resemble a third document start with shingles of their own,
and so make no pairs there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import boxed, durable, field, release, stored, unboxed
from .words import Words, in_slices, mix, shingle_set

BAND = 3
BANDS = 42
REGISTERS = BAND * BANDS
MANTISSA = 10
SHINGLE = 5
OVER, OF = 75, 100  # linked: OF * intersection >= OVER * union

_PROBES = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)
_PROBES = np.concatenate((np.arange(REGISTERS)[:, None], _PROBES), axis=1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of non-empty sets of hashes: (leading zeros << MANTISSA) | mantissa."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    least = np.full(len(sets) * REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    spread = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    np.minimum.at(least, of * REGISTERS + (hashes % np.uint64(REGISTERS)).astype(np.int64), spread)
    least = least.reshape(len(sets), REGISTERS)
    fraction, exponent = np.frexp(least.astype(np.float64) + 1)
    out = (np.maximum(64 - exponent, 0) << MANTISSA) | ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    empty = least == np.uint64(0xFFFFFFFFFFFFFFFF)
    for lo in range(0, len(sets), 256):
        part = empty[lo : lo + 256]
        rows = np.flatnonzero(part.any(axis=1))
        if len(rows):
            first = np.argmax(~part[rows][:, _PROBES], axis=2)
            source = _PROBES[np.arange(REGISTERS), first]
            out[lo + rows] = np.take_along_axis(out[lo + rows], source, axis=1)
    return out.astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of n and m shingles agree.

    The least of k uniform numbers falls into [x, y) with probability (1-x)**k - (1-y)**k;
    a register value is such an interval, 2**MANTISSA of equal width per leading-zero count.
    """
    k, j = (np.maximum(np.asarray(x, float) / REGISTERS, 1.0)[:, None] for x in (n, m))
    total = np.zeros(len(k))
    for zeros in range(40):
        steps = np.arange(17) / 16  # 16 cells of equal intervals: the density hardly changes within one
        edge = 2.0 ** -(zeros + 1) * (1 + steps)
        p, q = (np.exp(x * np.log1p(-np.minimum(edge, 1 - 1e-12))) for x in (k, j))
        total += ((p[:, :-1] - p[:, 1:]) * (q[:, :-1] - q[:, 1:])).sum(axis=1) / (2**MANTISSA / 16)
    return np.minimum(total, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    agree = (a == b).mean(axis=1)
    by_chance = chance(n, m)
    return (agree - by_chance) / (1 - by_chance)


def _sketches(batches):
    for batch in in_slices(batches, ["text"]):
        w = Words(batch.column("text"), fold=True)
        sets = [shingle_set(w.hashes[a:b], SHINGLE) for a, b in zip(w.first[:-1], w.first[1:])]
        full = [i for i, s in enumerate(sets) if len(s)]
        sketch = registers([sets[i] for i in full])
        digest, sketches = [None] * len(sets), [None] * len(sets)
        for k, i in enumerate(full):
            s = sets[i]
            digest[i] = b"".join(int(x).to_bytes(8, "little") for x in (np.bitwise_xor.reduce(mix(s)), np.add.reduce(mix(s + np.uint64(1))), len(s)))
            sketches[i] = sketch[k].tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sketches, pa.binary())],
            ["id", "text_key", "n", "digest", "sketch"],
        )


def _bands(batches):
    for batch in batches:
        raw = b"".join(batch.column("sketch").to_pylist())
        regs = np.frombuffer(raw, np.uint16).reshape(-1, BANDS, BAND).astype(np.uint64)
        key = (regs[:, :, 0] << np.uint64(32)) | (regs[:, :, 1] << np.uint64(16)) | regs[:, :, 2]
        key = mix(key + (np.arange(BANDS, dtype=np.uint64) << np.uint64(48)))
        v = np.repeat(np.asarray(batch.column("v")), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(v)], ["bucket", "v"])


def _likely(batches):
    least = OVER / OF - 6 * math.sqrt((OVER / OF) * (1 - OVER / OF) / REGISTERS)
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
        n, m = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
        sizes = OF * np.minimum(n, m) >= OVER * np.maximum(n, m)
        # Small sets leave buckets empty, and borrowed registers are not independent: these are compared in full.
        good = sizes & ((np.minimum(n, m) < REGISTERS) | (estimate(a, b, n, m) >= least))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])


def _linked(batches):
    known: tuple = (None, None)
    for batch in in_slices(batches, ["text_a", "text_b"]):
        other = Words(batch.column("text_b"), fold=True)
        good = np.zeros(batch.num_rows, bool)
        for i, a in enumerate(batch.column("a").to_pylist()):
            if a != known[0]:
                known = (a, shingle_set(Words(batch.column("text_a").slice(i, 1), fold=True).hashes, SHINGLE))
            mine = shingle_set(other.hashes[other.first[i] : other.first[i + 1]], SHINGLE)
            both = len(np.intersect1d(known[1], mine, assume_unique=True))
            good[i] = OF * both >= OVER * (len(known[1]) + len(mine) - both)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex reachable over undirected edges (a, b).

    Each round hands every vertex the least label of its neighbours and of its own label's
    vertex; pre-aggregated minima only, so a vertex with many edges is one row per task.
    """
    both = durable(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        hop = labels.select(F.col("v").alias("component"), F.col("component").alias("hop"))
        step = labels.join(near, "v").join(hop, "component").withColumn("least", F.least("component", "near", "hop"))
        moved = durable(step.select("v", F.col("least").alias("component"), (F.col("least") < F.col("component")).alias("moved")))
        labels = moved.drop("moved")
        release(edges.sparkSession)
        if not moved.filter("moved").head(1):
            return labels


def _texts_of(vertices: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(v, text): the text of one document of each class, out of (id, text_key, text)."""
    keyed = classes.join(vertices.select("v"), "v").select("v", "id", "text_key")
    same = keyed["id"].eqNullSafe(texts["id"]) & (keyed["text_key"] == texts["text_key"])
    return keyed.join(texts, same).select("v", "text").dropDuplicates(["v"])


def _shingles(batches):
    for batch in in_slices(batches, ["text"], 1 << 20):
        w = Words(batch.column("text"), fold=True)
        sets = [shingle_set(w.hashes[a:b], SHINGLE) for a, b in zip(w.first[:-1], w.first[1:])]
        v = np.repeat(np.asarray(batch.column("v")), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(np.concatenate(sets).view(np.int64))], ["v", "shingle"])


def _across(apart: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of vertices (v, c) of different components c, none above the threshold missing."""
    known = apart.join(classes.select("v", "n"), "v")
    sets = stored(texts.join(apart.select("v"), "v").select("v", "text").mapInArrow(_shingles, "v long, shingle long"))
    often = sets.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1")
    shared = sets.join(often, "shingle")
    order = Window.partitionBy("v").orderBy("times", "shingle")
    placed = shared.withColumn("nth", F.row_number().over(order) - 1).withColumn("k", F.count("*").over(Window.partitionBy("v")))
    at = placed.join(known, "v").withColumn("at", F.col("nth") + F.col("n") - F.col("k"))
    early = stored(at.filter(f"{OF} * at <= {OF - OVER} * n").select("shingle", "v", "c", "n", "at"))
    kinds = early.groupBy("shingle", "c").agg(F.count("*").alias("members"))
    top = kinds.groupBy("shingle").agg(F.max(F.struct("members", "c")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = early.join(top.select("shingle", F.col("top.c").alias("top")), "shingle")
    side = lambda s: [F.col(x).alias(f"{x}_{s}") for x in ("v", "c", "n", "at")]
    outside = mixed.filter("c != top").select("shingle", "top", *side("x"))
    both = outside.join(mixed.select("shingle", *side("y")), "shingle").filter(
        f"c_x != c_y and (c_y = top or v_x < v_y) and {OF} * least(n_x, n_y) >= {OVER} * greatest(n_x, n_y)"
        f" and {OVER + OF} * least(n_x - at_x, n_y - at_y) >= {OVER} * (n_x + n_y)"
    )
    return both.select(F.least("v_x", "v_y").alias("a"), F.greatest("v_x", "v_y").alias("b")).distinct()


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) that are linked: estimated first, then compared in full."""
    side = lambda s: classes.select(F.col("v").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    likely = durable(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_likely, "a long, b long"))
    text = lambda s: texts.select(F.col("v").alias(s), F.col("text").alias(f"text_{s}"))
    joined = likely.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")
    return durable(joined.mapInArrow(_linked, "a long, b long"))


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``text_key`` (a hash of its text), ``n_shingles``, ``component_id``, ``kept``.

    Words are runs of non-blank bytes with A-Z lower-cased. A text of fewer than five words
    has one shingle, one of none (or null) has none and is linked with nothing: it is its
    own component. ``component_id`` is the least id reachable, ``kept`` whether that is the
    row's own. Rows of one id are one vertex if their shingles agree. A row without an id
    takes part with its text; its component's id is the least one there is, else null, and
    it is kept if there is none. Equal rows have equal results.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text", F.octet_length("text")))
    sketched = stored(rows.mapInArrow(_sketches, "id long, text_key long, n long, digest binary, sketch binary"))
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("least")
    classes = sketched.filter("n > 0").groupBy("digest").agg(least, F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    classes = durable(classes.orderBy("least").select(F.monotonically_increasing_id().alias("v"), "digest", "least.id", "least.text_key", "n", "sketch"))
    members = classes.select("v", "sketch").mapInArrow(_bands, "bucket long, v long")
    led = members.groupBy("bucket").agg(F.min("v").alias("a"), F.max("v").alias("last")).filter("last > a").select("bucket", "a")
    led = durable(led)
    shared = stored(members.join(led, "bucket").select("bucket", "v", "a"))
    pairs = shared.filter("v > a").select("a", F.col("v").alias("b")).distinct()
    candidates = shared.select("v").unionAll(shared.select(F.col("a").alias("v"))).distinct()
    texts = stored(_texts_of(candidates, classes, rows))
    release(docs.sparkSession)
    links = _confirmed(pairs, classes, texts)
    found = components(links)
    placed = shared.join(found, "v", "left").select("bucket", "v", F.coalesce("component", "v").alias("c"))
    several = placed.groupBy("bucket").agg(F.min("c").alias("c"), F.max("c").alias("last")).filter("c < last").select("bucket")
    apart = durable(placed.join(several, "bucket").select("v", "c").distinct())
    if apart.head(1):
        rest = durable(_across(apart, classes, texts).join(pairs, ["a", "b"], "left_anti"))
        release(docs.sparkSession)
        found = components(durable(links.unionAll(_confirmed(rest, classes, texts))))
    named = classes.join(found, "v", "left").select("digest", "id", F.coalesce("component", "v").alias("c"))
    ids = named.groupBy("c").agg(F.min("id").alias("component_id"))
    named = named.join(ids, "c").select("digest", "component_id")
    out = sketched.join(named, "digest", "left").select(
        "id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("id").isNull() & F.col("component_id").isNull())
    return out.withColumn("kept", kept).withColumnRenamed("id", key)


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without near copies: of each component the row with the least id.

    Rows that agree in id and text count as one, and so do rows without an id that are in
    one component without ids or have the same text; a document without words stays.
    """
    whole = field(text).cast("string")
    rows = boxed(docs).withColumns({"id": field(key).cast("long"), "text_key": F.xxhash64(whole, F.octet_length(whole))})
    judged = near_copies(docs, text, key).select(F.col(key).alias("id"), "text_key", "kept").distinct().filter("kept").drop("kept")
    same = rows["id"].eqNullSafe(judged["id"]) & (rows["text_key"] == judged["text_key"])
    stays = rows.join(judged, same, "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "text_key").orderBy(F.lit(1)))
    return unboxed(stays.withColumn("nth", first).filter("nth = 1"), docs.columns, {})
