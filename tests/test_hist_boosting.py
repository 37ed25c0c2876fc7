"""Histogram boosting against a plain trainer that reads raw values."""

import random

import duckdb
import numpy as np
import pytest

from leadline.operators import hist_boosting
from leadline.operators.hist_boosting import BoostParams, fit_boosting


def table(spark, n=400, seed=1, nulls=True):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = float(draw.randrange(12)), draw.choice([0.5, 1.5, 2.5]), draw.random() * 5
        y = 3 * a - 4 * (b > 1) + (c if a > 6 else -c) + draw.random()
        rows.append((None if nulls and draw.random() < 0.1 else a, b, None if nulls and draw.random() < 0.2 else round(c, 1), y))
    return spark.createDataFrame(rows, "a double, b double, c double, y double"), rows


def plain_boosting(rows, p):
    """Best-first trees by trying every value of every column; nulls to either side."""
    x = [[r[k] for r in rows] for k in range(3)]
    y = np.array([r[3] for r in rows])
    pred = np.full(len(y), y.mean())

    def best(at):
        g = (pred - y)[at]
        whole, found = g.sum() ** 2 / (len(at) + p.l2), None
        for f in range(3):
            values = [x[f][i] for i in at]
            null = np.array([v is None for v in values])
            for null_left in (False, True) if null.any() else (False,):
                for v in sorted({v for v in values if v is not None}):
                    left = np.array([null_left if w is None else w <= v for w in values])
                    if min(left.sum(), (~left).sum()) < max(p.min_leaf, 1):
                        continue
                    gain = g[left].sum() ** 2 / (left.sum() + p.l2) + g[~left].sum() ** 2 / ((~left).sum() + p.l2) - whole
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, at[left], at[~left])
        return found

    for _ in range(p.iterations):
        leaves = [(np.arange(len(y)), 0)]
        while len(leaves) < p.max_leaves:
            options = [(best(at), k) for k, (at, depth) in enumerate(leaves) if p.max_depth is None or depth < p.max_depth]
            options = [o for o in options if o[0]]
            if not options:
                break
            (_, left, right), k = max(options, key=lambda o: o[0][0])
            depth = leaves.pop(k)[1] + 1
            leaves += [(left, depth), (right, depth)]
        step = np.zeros(len(y))
        for at, _ in leaves:
            step[at] = -p.rate * (pred - y)[at].sum() / (len(at) + p.l2)
        pred = pred + step
    return pred


@pytest.mark.parametrize(
    "params",
    [
        BoostParams(iterations=4, rate=0.5, max_leaves=6, min_leaf=5),
        BoostParams(iterations=3, rate=0.3, max_leaves=31, max_depth=3, min_leaf=10, l2=0.7),
        BoostParams(iterations=2, rate=1.0, max_leaves=40, min_leaf=1),
    ],
)
def test_trees_equal_a_plain_trainer(spark, monkeypatch, params):
    monkeypatch.setattr(hist_boosting, "STAGE_ROUNDS", 2)
    df, rows = table(spark)
    model = fit_boosting(df.repartition(3), ["a", "b", "c"], "y", params)
    got = {tuple(r[:4]): r["predicted"] for r in model.predict(df).collect()}
    expected = plain_boosting(rows, params)
    assert all(got[r] == pytest.approx(e, abs=1e-8) for r, e in zip(rows, expected))
    assert all(sum(f < 0 for f, d in zip(t.feature, t.depth)) for t in model.trees)
    assert sum(model.gains().values()) == pytest.approx(1.0)


def test_predictions_equal_the_model_said_in_sql(spark):
    df, rows = table(spark, seed=2)
    model = fit_boosting(df, ["a", "b", "c"], "y", BoostParams(iterations=5, rate=0.4, max_leaves=8))
    con = duckdb.connect()
    con.execute("CREATE TABLE t (a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE)")
    unseen = [(None, None, None, 0.0), (99.0, -5.0, 2.25, 0.0)]
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows + unseen)
    said = {r[:4]: r[4] for r in con.execute(f"SELECT a, b, c, y, {model.as_sql()} FROM t").fetchall()}
    for r in model.predict(df.union(spark.createDataFrame(unseen, df.schema))).collect():
        assert r["predicted"] == pytest.approx(said[tuple(r[:4])], abs=1e-9)


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(5000).selectExpr("cast(id as double) as a", "cast(id % 7 as double) as b", "cast(id >= 2500 as double) as y")
    edges = hist_boosting.fit_edges(df, ["a", "b"], 16)
    assert len(edges[0]) == 15 and abs(edges[0][7] - 2499.5) < 1 and edges[1].tolist() == [0, 1, 2, 3, 4, 5]
    model = fit_boosting(df, ["a"], "y", BoostParams(iterations=1, rate=1.0, max_bins=16))
    wrong = model.predict(df).where("abs(predicted - y) > 0.01").count()
    assert wrong == 0


def test_early_stop_and_odd_tables(spark):
    noise = spark.range(3000).selectExpr("cast(hash(id) % 50 as double) as a", "cast(hash(id, 1) % 100 as double) as y")
    model = fit_boosting(noise, ["a"], "y", BoostParams(iterations=60, patience=3))
    assert 3 < len(model.errors) < 60 and model.errors[0] > 0
    df, _ = table(spark, 30)
    empty = fit_boosting(df.limit(0), ["a", "b"], "y")
    assert empty.trees == [] and empty.predict(df).where("predicted = 0").count() == 30
    flat = fit_boosting(df.selectExpr("a", "cast(null as double) as b", "5.0 as y"), ["a", "b"], "y")
    assert flat.trees == [] and flat.base == 5.0
