"""Rules and MLlib regressors behind one interface: fit on train rows, score long rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark import StorageLevel
from pyspark.ml.base import Model
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.functions import numbers
from leadline.operators.cross_products import MAX_SLOTS, LinearFit, Sums, cross_products, solve
from leadline.operators.extra_trees import ForestParams, fit_extra_trees
from leadline.operators.features import Encoding, FittedEncoding, fit_encoding
from leadline.operators.grown_trees import GrownTrees
from leadline.operators.hist_boosting import BoostedTrees, BoostParams, fit_boosting
from leadline.operators.random_forest import RandomForestParams, fit_random_forest
from leadline.session import stage

SEED = 42
NORMAL_SOLVER_LIMIT = 4096


@dataclass(frozen=True)
class ModelSpec:
    """A named regressor: its encoding and its parameters."""

    name: str
    family: str
    encoding: Encoding
    params: dict[str, Any] = field(default_factory=dict)


@dataclass
class FittedModel:
    spec: ModelSpec
    encoding: FittedEncoding
    model: Model

    def predict(self, df: DataFrame, keep: Sequence[str], clip: bool = True) -> DataFrame:
        """``keep`` columns, the model's name and the prediction, clipped at 0. ``df`` may have its ``features`` already."""
        scored = self.model.transform(df if "features" in df.columns else self.encoding.transform(df))
        value = numbers.clip_low(F.col("prediction")) if clip else F.col("prediction")
        return scored.select(*keep, F.lit(self.spec.name).alias("model"), value.alias("predicted"))


@dataclass
class FittedLinear:
    """Linear, ridge or lasso regression solved from cross products."""

    spec: ModelSpec
    encoding: FittedEncoding
    model: LinearFit

    def predict(self, df: DataFrame, keep: Sequence[str | Column], clip: bool = True) -> DataFrame:
        scored = self.model.predict(df, [F.col(c) if isinstance(c, str) else c for c in keep], clip)
        return scored.select(*scored.columns[:-1], F.lit(self.spec.name).alias("model"), "predicted")


@dataclass
class FittedTrees:
    """Boosted, bagged or randomised trees on ordinal codes and filled numbers."""

    spec: ModelSpec
    encoding: FittedEncoding
    model: BoostedTrees | GrownTrees

    def predict(self, df: DataFrame, keep: Sequence[str | Column], clip: bool = True) -> DataFrame:
        shown = [F.col(c) if isinstance(c, str) else c for c in keep]
        scored = self.model.predict(_tree_inputs(self.encoding, df, shown), "predicted")
        value = numbers.clip_low(F.col("predicted")) if clip else F.col("predicted")
        return scored.select("_kept.*", F.lit(self.spec.name).alias("model"), value.alias("predicted"))


def _tree_inputs(encoding: FittedEncoding, df: DataFrame, keep: Sequence[Column]) -> DataFrame:
    """Kept columns in a struct, then one number per feature."""
    coded = encoding.codes(df)
    cells = [F.col(f"_o_{c}").alias(c) for c in encoding.spec.categorical] + [F.col(f"_m_{c}").alias(c) for c in encoding.spec.numeric]
    return coded.select(F.struct(*keep).alias("_kept") if keep else F.lit(None).alias("_kept"), F.struct(*cells).alias("_f")).select("_kept", "_f.*")


def _linear(width: int, **params) -> LinearRegression:
    solver = "normal" if width <= NORMAL_SOLVER_LIMIT and not params.get("elasticNetParam") else "l-bfgs"
    return LinearRegression(featuresCol="features", labelCol="_label", solver=solver, standardization=False, **params)


def _estimator(spec: ModelSpec, train: DataFrame, width: int):
    p = dict(spec.params)
    if spec.family == "linear":
        return _linear(width, regParam=0.0)
    if spec.family == "lasso":
        return _linear(width, regParam=p["alpha"], elasticNetParam=1.0, maxIter=p.get("max_iter", 1000), tol=1e-6)
    if spec.family == "ridge":
        # MLlib divides the loss by n and scales the label, so the penalty is alpha * std / n.
        normal = width <= NORMAL_SOLVER_LIMIT
        spread = F.stddev_pop("_label") if normal else F.stddev_samp("_label")
        n, std = train.agg(F.count(F.lit(1)), spread).first()
        return _linear(width, regParam=p["alpha"] * (std or 1.0) / max(n, 1))
    trees = {
        "featuresCol": "features", "labelCol": "_label", "seed": SEED,
        "maxDepth": p.get("max_depth", 10), "minInstancesPerNode": p.get("min_leaf", 1), "maxBins": p.get("max_bins", 64),
        "maxMemoryInMB": p.get("memory_mb", 1024), "cacheNodeIds": p.get("max_depth", 10) > 12,
    }
    if spec.family == "tree":
        return DecisionTreeRegressor(**trees)
    if spec.family == "forest":
        return RandomForestRegressor(**trees, numTrees=p["trees"], featureSubsetStrategy=p.get("subset", "all"))
    if spec.family == "boosting":
        return GBTRegressor(**trees, maxIter=p["iterations"], stepSize=p["rate"])
    raise ValueError(f"unknown model family: {spec.family}")


def fit_model(
    train: DataFrame, target: str, spec: ModelSpec, encoding: FittedEncoding | None = None, sums: dict[Encoding, Sums] | None = None
) -> FittedModel | FittedLinear | FittedTrees:
    """Fit one spec; pass ``encoding`` and ``sums`` to share what specs of one encoding have in common."""
    labelled = train.withColumn("_label", F.col(target).cast("double"))
    encoding = encoding or fit_encoding(labelled, spec.encoding)
    if spec.family in ("linear", "ridge", "lasso") and len(encoding.slots) <= MAX_SLOTS:
        sums = {} if sums is None else sums
        if spec.encoding not in sums:
            sums[spec.encoding] = cross_products(labelled, "_label", encoding)
        solved = solve(sums[spec.encoding], spec.family, spec.params.get("alpha", 0.0), spec.params.get("max_iter", 1000))
        return FittedLinear(spec, encoding, solved)
    if spec.family in ("hist_boosting", "extra_trees", "random_forest"):
        inputs = _tree_inputs(encoding, labelled, [F.col("_label")]).select("_kept._label", *encoding.slots)
        if not set(encoding.coded_columns) <= set(train.columns):
            inputs = stage(inputs)
        if spec.family == "hist_boosting":
            grown = fit_boosting(inputs, encoding.slots, "_label", BoostParams(**spec.params))
        elif spec.family == "random_forest":
            grown = fit_random_forest(inputs, encoding.slots, "_label", RandomForestParams(**spec.params, seed=SEED))
        else:
            p = spec.params
            grown = fit_extra_trees(inputs, encoding.slots, "_label", ForestParams(p["trees"], p["max_depth"], p["min_leaf"], SEED))
        return FittedTrees(spec, encoding, grown)
    ready = labelled if "features" in labelled.columns else encoding.transform(labelled)
    encoded = ready.select("_label", "features")
    model = _estimator(spec, labelled, len(encoding.slots)).fit(encoded)
    return FittedModel(spec, encoding, model)


def fit_and_score(rows: DataFrame, target: str, specs: Sequence[ModelSpec], keep: Sequence[str], split: str = "split"
                  ) -> tuple[DataFrame, dict[str, FittedModel]]:
    """Fit every spec on the train rows and score all rows; long predictions and the models.

    Specs whose encodings differ in scale only share what the train rows taught. Ordinal codes and filled numbers are
    worked out once and staged; every fit and score reads these. MLlib's trees read their inputs many times, so for them
    the vectors are kept on the executors' disks, once per encoding.
    """
    train = rows.filter(F.col(split) == "train")
    encoded: dict[Encoding, DataFrame] = {}
    shown = list(dict.fromkeys([*keep, split, target]))
    learnt: dict[Encoding, FittedEncoding] = {}
    coded: dict[Encoding, DataFrame] = {}
    encodings: dict[Encoding, FittedEncoding] = {}
    sums: dict[Encoding, Sums] = {}
    fitted: dict[str, FittedModel] = {}
    out = None
    for spec in specs:
        plain = replace(spec.encoding, scale=None)
        if plain not in learnt:
            learnt[plain] = fit_encoding(train, plain)
        if spec.encoding not in encodings:
            encodings[spec.encoding] = replace(learnt[plain], spec=spec.encoding)
        encoding, inputs = encodings[spec.encoding], rows
        if plain.kind == "ordinal" and "features" not in rows.columns:
            if plain not in coded:
                coded[plain] = stage(encoding.codes(rows).select(*shown, *encoding.coded_columns))
            inputs = coded[plain]
        if spec.family in ("tree", "forest", "boosting") and "features" not in rows.columns:
            if spec.encoding not in encoded:
                encoded[spec.encoding] = encoding.transform(inputs).select(*shown, "features").persist(StorageLevel.DISK_ONLY)
            inputs = encoded[spec.encoding]
        model = fit_model(inputs.filter(F.col(split) == "train"), target, spec, encoding, sums)
        fitted[spec.name] = model
        scored = model.predict(inputs, [*keep, split, F.col(target).cast("double").alias("actual")])
        out = scored if out is None else out.unionByName(scored)
    return out, fitted


def tree_importance(fitted: FittedModel) -> DataFrame:
    """Importance per feature, largest first."""
    if isinstance(fitted, FittedTrees):
        found = fitted.model.importance() if isinstance(fitted.model, GrownTrees) else fitted.model.gains()
        weights = [found[slot] for slot in fitted.encoding.slots]
    else:
        weights = fitted.model.featureImportances.toArray().tolist()
    rows = [(fitted.spec.name, slot, float(w)) for slot, w in zip(fitted.encoding.slots, weights)]
    table = SparkSession.active().createDataFrame(rows, "model string, feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def coefficient_table(fitted: FittedModel) -> DataFrame:
    """Signed and absolute coefficient per slot, largest first."""
    weights = list(fitted.model.coefficients)
    rows = [(fitted.spec.name, slot, float(w), abs(float(w))) for slot, w in zip(fitted.encoding.slots, weights)]
    table = SparkSession.active().createDataFrame(
        rows, "model string, feature string, coefficient double, abs_coefficient double"
    )
    return table.orderBy(F.desc("abs_coefficient"), "feature")


def only_features(importance: DataFrame, features: Sequence[str]) -> DataFrame:
    return importance.filter(F.col("feature").isin(list(features)))


# --- Fixed values: parameters of the compared regressors -------------------------------


def onehot(categorical: Sequence[str], numeric: Sequence[str], **options) -> Encoding:
    return Encoding(tuple(categorical), tuple(numeric), "onehot", **options)


def ordinal(categorical: Sequence[str], numeric: Sequence[str], **options) -> Encoding:
    return Encoding(tuple(categorical), tuple(numeric), "ordinal", **options)


def arrival_specs(categorical: Sequence[str], numeric: Sequence[str]) -> list[ModelSpec]:
    wide, codes = onehot(categorical, numeric, scale="std"), ordinal(categorical, numeric)
    return [
        ModelSpec("Linear Regression", "linear", wide),
        ModelSpec("Ridge Regression", "ridge", wide, {"alpha": 1.0}),
        ModelSpec("Lasso Regression", "lasso", wide, {"alpha": 0.0005, "max_iter": 5000}),
        ModelSpec("Random Forest", "random_forest", codes, {"trees": 120, "max_depth": 18, "min_leaf": 8}),
        ModelSpec("Extra Trees", "extra_trees", codes, {"trees": 160, "max_depth": 20, "min_leaf": 6}),
        ModelSpec("Hist Gradient Boosting", "hist_boosting", codes, {"iterations": 180, "rate": 0.08, "l2": 0.05, "patience": 10}),
        ModelSpec("Gradient Boosting", "hist_boosting", codes, {"iterations": 140, "rate": 0.08, "max_depth": 4, "max_leaves": 16, "min_leaf": 1}),
    ]


def forest_grid(categorical: Sequence[str], numeric: Sequence[str]) -> list[ModelSpec]:
    codes = ordinal(categorical, numeric)
    return [
        ModelSpec("RF_base_previous", "random_forest", codes, {"trees": 120, "max_depth": 18, "min_leaf": 8, "subset": "all"}),
        ModelSpec("RF_deeper_leaf4", "random_forest", codes, {"trees": 180, "max_depth": 26, "min_leaf": 4, "subset": "0.8"}),
        ModelSpec("RF_regularized_leaf12", "random_forest", codes, {"trees": 180, "max_depth": 16, "min_leaf": 12, "subset": "sqrt"}),
        ModelSpec("RF_deep_leaf2", "random_forest", codes, {"trees": 220, "max_depth": 30, "min_leaf": 2, "subset": "0.7"}),
    ]


def sales_specs(categorical: Sequence[str], numeric: Sequence[str], suffix: str = "") -> list[ModelSpec]:
    scaled, codes = ordinal(categorical, numeric, scale="center"), ordinal(categorical, numeric)
    return [
        ModelSpec("Linear Regression" + suffix, "linear", scaled),
        ModelSpec("Lasso" + suffix, "lasso", scaled, {"alpha": 0.001, "max_iter": 10000}),
        ModelSpec("Decision Tree" + suffix, "random_forest", codes, {"trees": 1, "max_depth": 16, "min_leaf": 20, "bootstrap": False}),
        ModelSpec("Random Forest" + suffix, "random_forest", codes, {"trees": 120, "max_depth": 18, "min_leaf": 8}),
        ModelSpec("Hist Gradient Boosting" + suffix, "hist_boosting", codes, {"iterations": 260, "rate": 0.06, "l2": 0.01, "patience": 10}),
    ]


def demand_specs(categorical: Sequence[str], numeric: Sequence[str]) -> list[ModelSpec]:
    wide = onehot(categorical, numeric, scale="center", unknown_to_pool=True)
    codes = ordinal(categorical, numeric)
    return [
        ModelSpec("Linear Regression", "linear", wide),
        ModelSpec("Lasso", "lasso", wide, {"alpha": 0.001, "max_iter": 10000}),
        ModelSpec("Decision Tree", "tree", codes, {"max_depth": 18, "min_leaf": 10}),
        ModelSpec("Random Forest", "forest", codes, {"trees": 120, "max_depth": 30, "min_leaf": 5, "subset": "sqrt"}),
        ModelSpec("Hist Gradient Boosting", "hist_boosting", codes, {"iterations": 200, "rate": 0.06, "l2": 0.05, "patience": 10}),
    ]


def with_params(spec: ModelSpec, **params) -> ModelSpec:
    return replace(spec, params={**spec.params, **params})

