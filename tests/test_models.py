import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadline.operators import metrics, models
from leadline.operators.expanding_ols import expanding_least_squares
from leadline.operators.features import INFREQUENT, Encoding, fit_encoding
from leadline.operators.profile import refuse_leakage
from leadline.plans import walk_forward


def test_metric_edge_rules(spark):
    rows = [("zero", 0.0, 1.0), ("zero", 0.0, -2.0), ("flat", 2.0, 2.0), ("flat", 2.0, 2.0), ("plain", 1.0, 2.0), ("plain", 3.0, 3.5)]
    df = spark.createDataFrame(rows, "model string, actual double, predicted double")
    got = {r["model"]: r for r in metrics.evaluate(df, ["model"], days=True).collect()}
    assert got["zero"]["wape"] is None and got["zero"]["mape_nonzero_actual"] is None
    assert got["zero"]["mae"] == 0.5 and got["zero"]["r2"] == 0.0
    assert got["flat"]["r2"] == 1.0 and got["flat"]["exact_day_accuracy_rounded"] == 1.0
    assert got["plain"]["r2"] == pytest.approx(1 - 1.25 / 2)
    assert got["plain"]["residual_median"] == pytest.approx(-0.75)
    assert got["plain"]["exact_day_accuracy_rounded"] == 0.0  # 3.5 rounds to 4


def train_rows(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), float(rnd.randrange(9)), 0.0) for _ in range(120)] + [("rare", 1.0, 0.0)] * 3 + [(None, None, 0.0)] * 2
    rows = [(c, x, 2.0 * (x or 0) + (3.0 if c == "a" else 0.0) + rnd.random()) for c, x, _ in rows]
    return spark.createDataFrame(rows, "c string, x double, y double")


def test_encodings_pool_rare_and_handle_unknown(spark):
    train = train_rows(spark)
    new = spark.createDataFrame([("a", 1.0), ("rare", 1.0), ("new", 1.0), (None, None)], "c string, x double")
    zeros = fit_encoding(train, Encoding(("c",), ("x",)))
    vectors = [r["features"].toArray().tolist()[:-1] for r in zeros.transform(new).collect()]
    assert zeros.slots == ["c=a", "c=b", f"c={INFREQUENT}", "x"]
    assert vectors[:3] == [[1, 0, 0], [0, 0, 1], [0, 0, 0]] and sum(vectors[3]) == 1
    pooled = fit_encoding(train, Encoding(("c",), ("x",), unknown_to_pool=True))
    vectors = [r["features"].toArray().tolist()[:-1] for r in pooled.transform(new).collect()]
    assert vectors[:3] == [[1, 0, 0], [0, 0, 1], [0, 0, 1]]
    codes = fit_encoding(train, Encoding(("c",), ("x",), "ordinal"))
    assert [r["features"].toArray()[0] for r in codes.transform(new).collect()][:3] == [0.0, 2.0, -1.0]


def test_ridge_penalty_equals_the_closed_form(spark):
    train = train_rows(spark).na.drop()
    pdf = train.select("x", "y").toPandas()
    spec = models.ModelSpec("r", "ridge", Encoding((), ("x",)), {"alpha": 5.0})
    fitted = models.fit_model(train, "y", spec)
    x, y = pdf.x - pdf.x.mean(), pdf.y - pdf.y.mean()
    assert fitted.model.coefficients[0] == pytest.approx(float((x @ y) / (x @ x + 5.0)), rel=1e-6)
    linear = models.fit_model(train, "y", models.ModelSpec("l", "linear", Encoding((), ("x",))))
    assert linear.model.coefficients[0] == pytest.approx(float(np.polyfit(pdf.x, pdf.y, 1)[0]), rel=1e-6)


def test_leaking_features_are_refused():
    with pytest.raises(ValueError):
        refuse_leakage(["quantity", "actual_days"], ["actual_days"])


def month_rows(spark, months=15, per=40):
    rnd = random.Random(11)
    rows = []
    for m in range(months):
        for i in range(per):
            p = "abcd"[rnd.randrange(4)] if m < 13 else "abcde"[rnd.randrange(5)]
            x = rnd.random()
            rows.append((f"{2020 + m // 12}-{m % 12 + 1:02d}", p, x, 10 * x + ord(p) - 97 + rnd.random() + m * 0.1))
    return spark.createDataFrame(rows, "month string, p string, x double, y double")


def test_walk_forward_rules_use_earlier_months_only(spark):
    df = month_rows(spark)
    pdf = df.toPandas()
    got = walk_forward.walk_forward_rules(df, "month", "y", "p", ["x"]).toPandas()
    for month in sorted(pdf.month.unique())[12:]:
        past = pdf[pdf.month < month]
        means = past.groupby("p").y.mean()
        want = pdf[pdf.month == month].sort_values("x")
        mine = got[(got.month == month) & (got.model == walk_forward.PRODUCT_RULE)].sort_values("x")
        assert list(mine.predicted) == pytest.approx([means.get(p, past.y.mean()) for p in want.p])
    assert sorted(got.fold.unique()) == [1, 2, 3]


def test_frozen_model_is_compared_with_the_retrained_one(spark):
    schema = "model string, fold int, month string, mae double, rmse double, r2 double, wape double, mape_nonzero_actual double"
    frozen = spark.createDataFrame([("m", 1, "a", 10.0, 1.0, 1.0, 1.0, 1.0), ("m", 2, "b", 12.0, 1.0, 1.0, 1.0, 1.0), ("m", 3, "c", 13.0, 1.0, 1.0, 1.0, 1.0)], schema)
    walking = frozen.withColumn("mae", F.lit(10.5))
    table = walk_forward.compare_frozen(frozen, walking, "month")
    row = walk_forward.stable_months(table, "month").first()
    assert row["degraded_over_10pct_month"] == "b" and row["degraded_over_abs_threshold_index"] == 3
    assert row["stable_months"] == 2 and row["worst_month"] == "c"


def test_model_walk_forward_scores_every_later_month(spark):
    df = month_rows(spark)
    spec = models.ModelSpec("lin", "linear", models.onehot(["p"], ["x"], min_rows=5, unknown_to_pool=True))
    pred = walk_forward.walk_forward_models(df, "month", "y", spec, [], parallelism=2)
    assert pred.count() == 3 * 40 and pred.select("fold").distinct().count() == 3


def test_accumulated_least_squares_equals_refitting_each_fold(spark):
    df = month_rows(spark)
    encoding = models.onehot(["p"], ["x"], min_rows=5, unknown_to_pool=True)
    spec = models.ModelSpec("lin", "linear", encoding)
    refit = walk_forward.walk_forward_models(df, "month", "y", spec, ["x"], parallelism=2).toPandas()
    once = expanding_least_squares(df, "month", "y", encoding, ["x"]).toPandas()
    key = ["month", "x", "actual"]
    both = refit.merge(once, on=key, suffixes=("_a", "_b")).merge(df.toPandas(), left_on=key, right_on=["month", "x", "y"])
    seen = both[(both.p != "e") | (both.month == "2021-03")]
    assert len(both) == 120 and len(seen) > 80
    assert np.allclose(seen.predicted_a, seen.predicted_b, atol=1e-6)


def test_encodings_that_differ_in_scale_are_learnt_once(spark, monkeypatch):
    learnt, fit = [], models.fit_encoding
    monkeypatch.setattr(models, "fit_encoding", lambda train, spec: learnt.append(spec) or fit(train, spec))
    rows = train_rows(spark).withColumn("split", F.when(F.col("x") < 7, "train").otherwise("test"))
    scaled, codes = models.ordinal(["c"], ["x"], scale="center"), models.ordinal(["c"], ["x"])
    specs = [models.ModelSpec("lin", "linear", scaled), models.ModelSpec("tree", "tree", codes, {"max_depth": 3, "min_leaf": 2})]
    pred, fitted = models.fit_and_score(rows, "y", specs, ["x"])
    assert len(learnt) == 1 and fitted["lin"].encoding.spec.scale == "center" and fitted["tree"].encoding.spec.scale is None
    got = {(r["model"], r["split"]): r["n"] for r in pred.groupBy("model", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(m, s): n for m in ("lin", "tree") for s, n in want.items()}
