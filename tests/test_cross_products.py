"""Linear models from cross products against dense numpy, and their optimality."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadline.operators import models
from leadline.operators.cross_products import cross_products, optimality_gaps, solve
from leadline.operators.features import INFREQUENT, Encoding, exact_medians, fit_encoding


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(9)
    out = []
    for k in range(260):
        a, b, x = draw.choice("pqr"), draw.choice(["u", "v", None]), draw.choice([None, 1.0, 2.5, 4.0])
        z = draw.random() * 3
        out.append((a if k > 4 else "rare", b, x, z, 2.0 * (x or 0) - z + (3 if a == "p" else 0) + draw.random()))
    return out


def dense(rows, scale):
    """The one-hot matrix with pooled rare categories, median fills and scaled, centred numbers."""
    usual = max(("u", "v"), key=lambda v: (sum(r[1] == v for r in rows), v == "u"))
    median = float(np.median([r[2] for r in rows if r[2] is not None]))
    columns = [[1.0 if r[0] == v else 0.0 for r in rows] for v in "pqr"] + [[1.0 if r[0] == "rare" else 0.0 for r in rows]]
    columns += [[1.0 if (r[1] or usual) == v else 0.0 for r in rows] for v in "uv"]
    numbers = np.array([[median if r[2] is None else r[2] for r in rows], [r[3] for r in rows]])
    if scale:
        numbers = (numbers - numbers.mean(1, keepdims=True)) / numbers.std(1, ddof=1, keepdims=True)
    return np.column_stack([*columns, *numbers]), np.array([r[4] for r in rows])


@pytest.mark.parametrize("family, alpha", [("linear", 0.0), ("ridge", 3.0), ("lasso", 0.05)])
@pytest.mark.parametrize("scale", [None, "std"])
def test_coefficients_equal_numpy(spark, rows, family, alpha, scale):
    df = spark.createDataFrame(rows, "a string, b string, x double, z double, y double").repartition(3)
    encoding = fit_encoding(df, Encoding(("a", "b"), ("x", "z"), scale=scale))
    assert encoding.slots == ["a=p", "a=q", "a=r", f"a={INFREQUENT}", "b=u", "b=v", "x", "z"]
    fit = solve(cross_products(df, "y", encoding), family, alpha, 20_000)
    x, y = dense(rows, scale)
    xc, yc = x - x.mean(0), y - y.mean()
    if family == "linear":
        expected = np.linalg.lstsq(xc, yc, rcond=1e-10)[0]
    elif family == "ridge":
        expected = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    if family != "lasso":
        assert fit.coefficients == pytest.approx(expected, abs=1e-7)
        predicted = y.mean() + xc @ expected
    else:
        # The optimum: correlations equal the penalty where a coefficient is set, and stay below it elsewhere.
        predicted = y.mean() + xc @ fit.coefficients
        moment = xc.T @ (y - predicted) / len(y)
        on = fit.coefficients != 0
        assert moment[on] == pytest.approx(alpha * np.sign(fit.coefficients[on]), abs=1e-8) and (abs(moment[~on]) <= alpha + 1e-8).all()
        assert 0 < on.sum() < len(on)
    got = sorted(r["predicted"] for r in fit.predict(df, [F.col("y")], clip=False).collect())
    assert got == pytest.approx(sorted(predicted), abs=1e-7)
    gaps = {r["feature"]: r for r in optimality_gaps(fit, df, "y").collect()}
    assert set(gaps) == set(encoding.slots) and all(abs(r["gap"]) < 1e-8 for r in gaps.values())
    assert gaps[f"a={INFREQUENT}"]["rows"] == 5


def test_a_wrong_fit_has_gaps(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, x double, z double, y double")
    fit = solve(cross_products(df, "y", fit_encoding(df, Encoding(("a",), ("z",)))), "linear")
    fit.coefficients[-1] += 0.5
    assert max(abs(r["gap"]) for r in optimality_gaps(fit, df, "y").collect()) > 0.1


def test_ordinal_codes_and_unknown_categories(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, x double, z double, y double")
    spec = models.ModelSpec("m", "linear", Encoding(("a", "b"), ("z",), "ordinal", scale="center"))
    fitted = models.fit_model(df, "y", spec)
    assert len(fitted.model.coefficients) == 3
    gaps = optimality_gaps(fitted.model, df, "y").collect()
    assert {r["feature"] for r in gaps} == {"a", "b", "z"} and all(abs(r["gap"]) < 1e-8 for r in gaps)
    new = spark.createDataFrame([("never seen", "u", 1.0, 1.0, 0.0)], df.schema)
    pooled = models.fit_model(df, "y", models.ModelSpec("m", "ridge", Encoding(("a",), ("z",), unknown_to_pool=True), {"alpha": 1.0}))
    zeros = models.fit_model(df, "y", models.ModelSpec("m", "ridge", Encoding(("a",), ("z",)), {"alpha": 1.0}))
    values = [m.predict(new, ["z"], clip=False).first()["predicted"] for m in (pooled, zeros)]
    beta = zeros.model
    z = (1.0 - beta.design.means[0]) / beta.design.scales[0]
    assert values[1] == pytest.approx(beta.intercept + beta.coefficients[-1] * z) and values[0] != values[1]


def test_exact_medians(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (4.0, None), (9.0, None), (None, None)], "a double, b double")
    assert exact_medians(df, ["a", "b"]) == {"a": 4.0, "b": 0.0}
    wide = spark.range(2001).selectExpr("cast(id * 3 as double) as a")
    monkeypatch.setattr("leadline.operators.features.DISTINCT_LIMIT", 100)
    assert exact_medians(wide, ["a"]) == {"a": 3000.0}
