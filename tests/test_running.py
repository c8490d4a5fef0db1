import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.running import Running, find_hot, running

OUTS = {
    "s": Running("sum", "v"),
    "s_before": Running("sum", "v", inclusive=False),
    "n": Running("count", "v"),
    "n_before": Running("count", "v", inclusive=False),
    "low": Running("min", "v"),
    "high_before": Running("max", "v", inclusive=False),
    "last": Running("last", "v"),
    "last_before": Running("last", "v", inclusive=False),
}


@pytest.mark.parametrize("hot_rows", [1, 7, 100])
def test_slices_give_what_a_window_gives(spark, hot_rows):
    rng = random.Random(hot_rows)
    rows = [
        (i, None if rng.random() < 0.2 else "t", "hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}",
         rng.randrange(40), None if rng.random() < 0.3 else rng.randrange(-50, 50))
        for i in range(500)
    ]
    frame = spark.createDataFrame(rows, "id int, t string, k string, at int, v bigint")
    plain = running(frame, ["t", "k"], ["at", "id"], OUTS)
    split = running(frame, ["t", "k"], ["at", "id"], OUTS, hot_rows)
    columns = plain.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.select(columns).collect()))


def test_a_coarser_measurement_serves_finer_groups(spark):
    frame = spark.range(300).select(
        F.lit("a").alias("k"), (F.col("id") % 3).alias("part"), F.col("id").alias("at"), F.col("id").alias("v")
    )
    hot = find_hot(frame, ["k"], 20)
    split = running(frame, ["k", "part"], ["at"], {"s": Running("sum", "v")}, hot)
    plain = running(frame, ["k", "part"], ["at"], {"s": Running("sum", "v")})
    assert sorted(plain.collect()) == sorted(split.select(plain.columns).collect())


def test_no_partition_holds_a_hot_group(spark):
    frame = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    split = running(frame, ["k"], ["at"], {"n": Running("count", "at")}, 500)
    largest = split.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 2000
