"""Random forests against a plain recursive trainer with the same draws, and the sizes that queries grow."""

import random

import numpy as np
import pytest

from leadline.catalog import models as catalog
from leadline.operators import extra_trees, grown_trees, hist_boosting, random_forest
from leadline.operators.random_forest import RandomForestParams, draws, fit_random_forest, looked_at


def rows_of(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = float(draw.randrange(40)), float(draw.randrange(3)), None if draw.random() < 0.1 else float(draw.randrange(6))
        rows.append((i, a, b, c, a * (1 + b) - 3 * (c if c is not None else 8.0) + draw.random()))
    return rows


def plain_tree(x, y, w, p, tree, number=0, depth=0):
    """Value per row index (rows the tree does not see too), by recursion."""
    seen = [i for i in y if w[i]]
    n, s = sum(w[i] for i in seen), sum(w[i] * y[i] for i in seen)
    flat = {i: s / n for i in y}
    if depth >= p.max_depth or len({y[i] for i in seen}) == 1:
        return flat
    best, looks = None, looked_at(p, tree, np.array([number], np.uint64), len(x[seen[0]]))[0]
    for f in np.flatnonzero(looks):
        for cut in sorted({x[i][f] for i in seen}):
            left = [i for i in seen if x[i][f] <= cut]
            n_left, s_left = sum(w[i] for i in left), sum(w[i] * y[i] for i in left)
            if min(n_left, n - n_left) < p.min_leaf:
                continue
            score = s_left**2 / n_left + (s - s_left) ** 2 / (n - n_left)
            if best is None or score > best[0] * (1 + 1e-11):
                best = (score, f, cut)
    if best is None:
        return flat
    _, f, cut = best
    sides = {i: y[i] for i in y if x[i][f] <= cut}, {i: y[i] for i in y if x[i][f] > cut}
    return {i: v for k, side in enumerate(sides, start=1) for i, v in plain_tree(x, side, w, p, tree, 2 * number + k, depth + 1).items()}


@pytest.mark.parametrize(
    "params",
    [RandomForestParams(3, 5, 4), RandomForestParams(2, 30, 1, "sqrt"), RandomForestParams(3, 6, 2, "0.6"), RandomForestParams(1, 16, 5, bootstrap=False)],
)
@pytest.mark.parametrize("local", [1000, 40])  # whole trees in a task, and tops split in passes
def test_forest_equals_a_plain_trainer(spark, monkeypatch, params, local):
    monkeypatch.setattr(grown_trees, "LOCAL_ROWS", local)
    monkeypatch.setattr(grown_trees, "GROUP_ROWS", 400)
    rows = rows_of(200, params.trees)
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, y double").coalesce(1)
    model = fit_random_forest(df, ["a", "b", "c"], "y", params)
    got = {r["i"]: r["predicted"] for r in model.predict(df).collect()}
    x = {r[0]: [99.0 if v is None else v for v in r[1:4]] for r in rows}  # nulls are past every value
    y = {r[0]: r[4] for r in rows}
    base, plain = np.mean(list(y.values())), []
    for t in range(params.trees):
        w = draws(params.seed, t, 0, len(rows)) if params.bootstrap else np.ones(len(rows), int)
        plain.append(plain_tree(x, {i: v - base for i, v in y.items()}, [int(v) for v in w], params, t))
    for i in x:
        assert got[i] == pytest.approx(base + np.mean([t[i] for t in plain]), abs=1e-9)
    assert sum(model.importance().values()) == pytest.approx(1.0)


def test_models_of_several_parts_and_odd_tables(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(300, 9), "i long, a double, b double, c double, y double").coalesce(1)
    p = RandomForestParams(6, 8, 2)
    whole = fit_random_forest(df, ["a", "b", "c"], "y", p)
    monkeypatch.setattr(grown_trees, "NODES_AT_ONCE", 100)
    parted = fit_random_forest(df, ["a", "b", "c"], "y", p)
    assert len(whole.parts) == 1 and len(parted.parts) == 6 and len(parted.trees) == 6
    one, many = ({r["i"]: r["predicted"] for r in m.predict(df).collect()} for m in (whole, parted))
    assert all(many[i] == pytest.approx(v) for i, v in one.items())
    odd = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, None)], "a double, y double")
    assert fit_random_forest(odd, ["a"], "y", p).predict(odd).where("predicted = 5").count() == 3
    assert fit_random_forest(odd.limit(0), ["a"], "y", p).predict(odd).where("predicted = 0").count() == 3


def test_randomised_trees_are_the_same_in_passes_and_in_a_task(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(200, 4), "i long, a double, b double, c double, y double").repartition(3)
    found = []
    for local in (1000, 30, 0):
        monkeypatch.setattr(grown_trees, "LOCAL_ROWS", local)
        model = extra_trees.fit_extra_trees(df, ["a", "b", "c"], "y", extra_trees.ForestParams(3, 9, 2))
        found.append({r["i"]: r["predicted"] for r in model.predict(df).collect()})
    assert all(found[0][i] == pytest.approx(other[i]) for other in found[1:] for i in found[0])


def test_boosting_is_the_same_in_passes_and_in_a_task(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(400, 6), "i long, a double, b double, c double, y double").coalesce(2)
    found = []
    for local in (1000, 10):
        monkeypatch.setattr(hist_boosting, "LOCAL_ROWS", local)
        model = hist_boosting.fit_boosting(df, ["a", "b", "c"], "y", hist_boosting.BoostParams(iterations=13, max_leaves=6, patience=10))
        found.append(({r["i"]: r["predicted"] for r in model.predict(df).collect()}, model.errors))
    assert found[0][1] == pytest.approx(found[1][1])
    assert all(found[0][0][i] == pytest.approx(v) for i, v in found[1][0].items())


class Seen(Exception):
    pass


@pytest.mark.parametrize(
    "query, sizes",
    [
        ("arrival_forest_grid", [(120, 18), (180, 26), (180, 16), (220, 30)]),
        ("arrival_history_forest_scores", [(120, 18)]),
        ("arrival_history_importance", [(120, 18)]),
        ("arrival_tree_scores", [(120, 18), (160, 20), (180, None), (140, 4)]),
        ("sales_model_scores", [(None, None), (None, None), (1, 16), (120, 18), (260, None)]),
    ],
)
def test_queries_fit_their_whole_specs(monkeypatch, query, sizes):
    """Trees or rounds and depth of every model that a query fits; none is cut."""

    def looked(*args):
        raise Seen([(s.params.get("trees", s.params.get("iterations")), s.params.get("max_depth")) for s in next(a for a in args if isinstance(a, list) and hasattr(a[0], "family"))])

    for module, name in ((catalog.arrival, "arrival_models"), (catalog.models, "fit_and_score")):
        monkeypatch.setattr(module, name, looked)
    for name in ("_arrival_lines", "_sales_lines", "stage", "share_split"):
        monkeypatch.setattr(catalog, name, lambda *args, **options: None)
    with pytest.raises(Seen) as seen:
        getattr(catalog, query)(None, None)
    assert seen.value.args[0] == sizes


def test_a_node_draws_as_many_features_as_asked():
    p = RandomForestParams(subset="sqrt")
    looks = looked_at(p, 3, np.arange(500, dtype=np.uint64), 13)
    assert (looks.sum(axis=1) == 4).all() and (looks.sum(axis=0) > 100).all()
    assert random_forest._POISSON.mean() == pytest.approx(1.0, abs=1e-3)
