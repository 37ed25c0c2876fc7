"""Global ranks and running totals against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from leadline.operators.ranking import global_rank, running_start


def test_global_rank_splits_a_shared_value(spark):
    draw = random.Random(3)
    rows = [(7 if draw.random() < 0.6 else draw.randrange(50), k) for k in range(3000)] + [(None, 3000 + k) for k in range(5)]
    df = spark.createDataFrame(rows, "v long, k long").repartition(5)
    got = {r["k"]: r["place"] for r in global_rank(df, ["v", "k"], "place", null_rank=False).collect()}
    expected = sorted((r for r in rows if r[0] is not None))
    assert got == {k: i for i, (_, k) in enumerate(expected, start=1)} | {k: None for v, k in rows if v is None}


def test_global_rank_descending_and_empty(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 2), (3.0, 1)], "v double, k long")
    ranked = global_rank(df, [F.desc("v"), F.asc("k")])
    assert {(r["v"], r["k"]): r["rank"] for r in ranked.collect()} == {(3.0, 1): 1, (3.0, 2): 2, (1.0, 1): 3}
    assert global_rank(df.limit(0), ["v"]).count() == 0
    with pytest.raises(ValueError):
        global_rank(df, [F.desc("v")], null_rank=False)


def test_running_start_over_chunks(spark):
    draw = random.Random(4)
    rows = [(draw.choice("aab"), k, draw.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, v long").withColumn("c", F.expr("k div 37"))
    got = {r["k"]: r["start"] for r in running_start(df, ["g"], "c", ["k"], "v").collect()}
    sums, expected = {"a": 0, "b": 0}, {}
    for g, k, v in rows:
        expected[k] = sums[g]
        sums[g] += v
    assert got == expected
