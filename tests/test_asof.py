"""As-of joins and look-back totals against plain loops, over one chunk and many."""

import random
from datetime import datetime, timedelta

import pytest

from leadline.operators.asof import asof_join, lookback_totals

START = datetime(2024, 1, 1)


def tables(spark, seed):
    draw = random.Random(seed)
    at = lambda: START + timedelta(minutes=draw.randrange(400)) if draw.random() < 0.95 else None
    key = lambda: draw.choice(["hot"] * 6 + ["b", "c", None])
    left = [(k, key(), at()) for k in range(150)]
    right = [(k, key(), at(), draw.choice([None, 1.5, 2.0, 7.25])) for k in range(120)]
    return (
        spark.createDataFrame(left, "id long, k string, ts timestamp"), left,
        spark.createDataFrame(right, "r long, k string, seen timestamp, v double").repartition(3), right,
    )


@pytest.mark.parametrize("strict, tolerance, chunk", [(True, None, 10), (False, None, 100_000), (True, 1200, 7), (False, 0, 25)])
def test_asof_join_equals_a_loop(spark, strict, tolerance, chunk):
    left_df, left, right_df, right = tables(spark, chunk)
    out = asof_join(left_df, right_df, ["k"], "ts", "seen", ["r", "v"], ["r"], strict, tolerance, "last_", chunk)
    assert out.columns == ["id", "k", "ts", "last_r", "last_v"]
    got = {r["id"]: (r["last_r"], r["last_v"]) for r in out.collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        before = [(s, r, v) for r, rk, s, v in right if None not in (k, t, s) and rk == k and (s < t or (not strict and s == t))]
        s, r, v = max(before, key=lambda x: x[:2]) if before else (None, None, None)
        if s is not None and tolerance is not None and (t - s).total_seconds() > tolerance:
            r = v = None
        assert got[i] == (r, v)


@pytest.mark.parametrize("chunk", [9, 100_000])
def test_lookback_equals_a_loop(spark, chunk):
    left_df, left, right_df, right = tables(spark, 5)
    out = lookback_totals(left_df, right_df, ["k"], "ts", "seen", "v", {"short": 600, "long": 7200}, chunk).collect()
    assert len(out) == len(left)
    for r in out:
        for name, seconds in (("short", 600), ("long", 7200)):
            if r["k"] is None or r["ts"] is None:
                assert r[f"{name}_count"] is None and r[f"{name}_sum"] is None
                continue
            t = next(x[2] for x in left if x[0] == r["id"])
            hit = [v for _, k, s, v in right if k == r["k"] and s and v is not None and t - timedelta(seconds=seconds) <= s < t]
            assert r[f"{name}_count"] == len(hit) and r[f"{name}_sum"] == (sum(hit) if hit else None)


def test_nothing_to_look_up(spark):
    left_df, left, right_df, _ = tables(spark, 6)
    assert asof_join(left_df, right_df.limit(0), ["k"], "ts", "seen", ["v"]).where("last_v is null").count() == len(left)
    assert asof_join(left_df.limit(0), right_df, ["k"], "ts", "seen", ["v"]).count() == 0
