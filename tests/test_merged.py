"""Sums merged into generations: bounded folders, repeated batches, merges that die."""

import os

import pytest

from tallyhouse.streaming.merged import MergedSums


def batch(spark, n):
    return spark.createDataFrame([("a", 1, 10 + n), (None, n % 3, 1)], "k string, d bigint, v bigint").coalesce(1)


def expected(n):
    """Sums of the first n batches."""
    out = {("a", 1): sum(10 + i for i in range(n))}
    for i in range(n):
        out[None, i % 3] = out.get((None, i % 3), 0) + 1
    return out


def table(spark, path, every=8):
    return MergedSums(spark, str(path), ["k", "d"], ["v"], every)


def rows(df):
    return {(r.k, r.d): r.v for r in df.collect()}


def folders(path, name):
    return sorted(int(f.split("=")[1]) for f in os.listdir(path / name) if "=" in f)


def test_a_hundred_batches_leave_few_folders(spark, tmp_path):
    sums = table(spark, tmp_path)
    assert sums.read() is None
    for n in range(100):
        sums.add(batch(spark, n), n)
        if n % 25 == 3:
            assert rows(sums.read()) == expected(n + 1)
    assert rows(sums.read()) == expected(100) and rows(sums.read(before=100)) == expected(100)
    assert len(folders(tmp_path, "batches")) <= 2 * 8 + 4 and len(folders(tmp_path, "merged")) == 2


def test_repeated_batches_and_merges_that_die(spark, tmp_path, monkeypatch):
    sums = table(spark, tmp_path, every=3)
    for n in range(6):
        sums.add(batch(spark, n), n)
    for _ in range(2):  # the batch is repeated, so its merge is asked for again
        sums.add(batch(spark, 6), 6)
    assert rows(sums.read()) == expected(7) and rows(sums.read(before=6)) == expected(6)
    for n in (7, 8):
        sums.add(batch(spark, n), n)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(MergedSums, "_publish", die)
        with pytest.raises(RuntimeError):
            sums.add(batch(spark, 9), 9)
    assert rows(sums.read()) == expected(9)  # the generation without a row in the manifest does not count
    sums.add(batch(spark, 9), 9)
    assert rows(sums.read()) == expected(10)
    assert folders(tmp_path, "merged") == [2, 3]
