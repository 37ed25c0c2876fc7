import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadline.operators.aggregate import histogram, seeded_sample
from leadline.operators.order_stats import exact_quantiles, rank_bands, rank_cut
from leadline.operators.split import month_folds, share_split


def skewed(n=600):
    """A third of the rows share one value; the rest are spread over a heavy tail."""
    rnd = random.Random(7)
    return [(5.0 if i % 3 == 0 else math.exp(rnd.uniform(-5, 12)), i % 7, i) for i in range(n)]


@pytest.mark.parametrize("buckets,slice_rows", [(4096, 200_000), (4, 3)])
def test_rank_cut_is_exact_on_hot_values(spark, buckets, slice_rows):
    data = skewed()
    df = spark.createDataFrame(data, "v double, a int, b int")
    ordered = sorted(data)
    for rank in (1, 100, 250, 333, 599, 600):
        cut = rank_cut(df, ["v", "a", "b"], rank, buckets, slice_rows)
        first = sorted(map(tuple, df.filter(cut.at_or_before()).collect()))
        assert first == ordered[:rank]


@pytest.mark.parametrize("n", [5, 7, 11, 100])
def test_bands_follow_first_come_ranks(spark, n):
    df = spark.createDataFrame([(float(i // 4), i) for i in range(n)], "v double, k int")
    got = [r["band"] for r in rank_bands(df, ["v", "k"], list("abcde"), "band", 8, 2).orderBy("k").collect()]
    expected = pd.qcut(pd.Series([float(i // 4) for i in range(n)]).rank(method="first"), 5, labels=list("abcde"))
    assert got == list(expected.astype(str))


def test_searched_quantiles_equal_the_built_in_ones(spark):
    data = [("hot", v) for v, _, _ in skewed(900)] + [("cold", float(i)) for i in range(10)] + [(None, 1.0), (None, 4.0), ("empty", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    plain = sorted(map(tuple, exact_quantiles(df, ["k"], "v", probs).collect()), key=str)
    searched = sorted(map(tuple, exact_quantiles(df, ["k"], "v", probs, distinct_limit=50, buckets=16).collect()), key=str)
    assert [r[0] for r in plain] == [r[0] for r in searched]
    for a, b in zip(plain, searched):
        assert a[1:] == pytest.approx(b[1:])
    whole = exact_quantiles(df, [], "v", probs, distinct_limit=5, buckets=16).first()
    expected = pd.Series([v for _, v in data]).quantile([0.1, 0.5, 0.99]).tolist()
    assert list(whole) == pytest.approx(expected)


def test_share_split_cuts_inside_a_shared_time(spark):
    df = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 9)], "t int, k int")
    got = {r["k"]: r["split"] for r in share_split(df, ["t", "k"]).collect()}
    assert [k for k in range(10) if got[k] == "test"] == [8, 9]


def test_folds_expand_and_need_enough_months(spark):
    df = spark.createDataFrame([(f"2020-{m:02d}",) for m in (1, 2, 4, 5, 7)], "month string")
    folds = month_folds(df, "month", initial=3)
    assert [(f["fold"], f["train_end"], f["test_start"]) for f in folds] == [(1, "2020-04", "2020-05"), (2, "2020-05", "2020-07")]
    with pytest.raises(ValueError):
        month_folds(df, "month", initial=5)


def test_histogram_top_edge_and_sample_are_stable(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    assert {r["bin"]: r["n"] for r in histogram(df, "x", 5).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    one = sorted(r["x"] for r in seeded_sample(df, ["x"], 4).collect())
    two = sorted(r["x"] for r in seeded_sample(df.repartition(5), ["x"], 4).collect())
    assert one == two and len(one) == 4
    assert histogram(df.filter(F.col("x") == 3), "x", 5).count() == 1


def test_searched_quantiles_of_many_crowded_groups(spark):
    """Thousands of searched groups, a null and an unequal one among them, equal the built-in quantiles."""
    df = spark.range(0, 60000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN -1 WHEN id % 2000 = 1 THEN NULL ELSE id % 2000 END AS k", "pmod(xxhash64(id), 100000) / 7.0D AS v"
    )
    probs = {"q25": 0.25, "q50": 0.5, "q90": 0.9}
    plain = sorted(map(tuple, exact_quantiles(df, ["k"], "v", probs).collect()), key=str)
    searched = sorted(map(tuple, exact_quantiles(df, ["k"], "v", probs, distinct_limit=5, buckets=16).collect()), key=str)
    assert len(plain) > 1300 and [r[0] for r in plain] == [r[0] for r in searched]
    assert all(a == pytest.approx(b, rel=1e-12) for x, y in zip(plain, searched) for a, b in zip(x[1:], y[1:]))
