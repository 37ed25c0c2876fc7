"""Extremely randomised trees against a plain recursive trainer with the same draws."""

import random

import numpy as np
import pytest

from leadline.operators import extra_trees
from leadline.operators.extra_trees import ForestParams, drawn, fit_extra_trees


def plain_tree(x, y, p, tree, node=0, depth=0):
    """Mean per row index, by recursion."""
    rows = sorted(y)
    mean = {i: sum(y.values()) / len(y) for i in rows}
    if depth >= p.max_depth or len(set(y.values())) == 1:
        return mean
    best = None
    for f in range(len(x[rows[0]])):
        values = [x[i][f] for i in rows if x[i][f] is not None]
        if not values or min(values) == max(values):
            continue
        cut = min(values) + drawn(p.seed, tree, node, f) * (max(values) - min(values))
        left = [i for i in rows if x[i][f] is not None and x[i][f] <= cut]
        right = [i for i in rows if i not in set(left)]
        if min(len(left), len(right)) < max(p.min_leaf, 1):
            continue
        score = sum(sum(y[i] for i in side) ** 2 / len(side) for side in (left, right))
        if best is None or score > best[0]:
            best = (score, left, right)
    if best is None:
        return mean
    return {
        i: v
        for k, side in enumerate(best[1:], start=1)
        for i, v in plain_tree(x, {i: y[i] for i in side}, p, tree, 2 * node + k, depth + 1).items()
    }


@pytest.mark.parametrize("params", [ForestParams(4, 4, 5), ForestParams(3, 30, 1, seed=7), ForestParams(2, 0, 1)])
def test_forest_equals_a_plain_trainer(spark, monkeypatch, params):
    monkeypatch.setattr(extra_trees, "MAX_CELLS", 60)  # several passes per level
    draw = random.Random(params.seed)
    rows = []
    for i in range(120):
        a, b, c = draw.random() * 9, float(draw.randrange(3)), None if draw.random() < 0.1 else draw.random()
        rows.append((i, a, b, c, a * a - 5 * b + (c or 2.0) + draw.random()))
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, y double")
    model = fit_extra_trees(df.repartition(3), ["a", "b", "c"], "y", params)
    got = {r["i"]: r["predicted"] for r in model.predict(df).collect()}
    x, y = {r[0]: r[1:4] for r in rows}, {r[0]: r[4] for r in rows}
    plain = [plain_tree(x, y, params, t) for t in range(params.trees)]
    for i in x:
        assert got[i] == pytest.approx(np.mean([t[i] for t in plain]), abs=1e-9)
    weights = model.importance()
    assert sum(weights.values()) == pytest.approx(1.0 if params.max_depth else 0.0)
    if params.max_depth:
        assert weights["a"] > weights["c"]


def test_forest_of_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, None)], "a double, y double")
    flat = fit_extra_trees(df, ["a"], "y", ForestParams(2, 5))
    assert all(len(t.feature) == 1 for t in flat.trees) and flat.predict(df).where("predicted = 5").count() == 3
    empty = fit_extra_trees(df.limit(0), ["a"], "y", ForestParams(2, 5))
    assert empty.predict(df).where("predicted = 0").count() == 3
