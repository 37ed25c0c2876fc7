"""Error metrics as one aggregation over long predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.functions import numbers
from leadline.operators.order_stats import exact_quantiles


def error_measures(actual: Column, predicted: Column) -> dict[str, Column]:
    """MAE, MSE, RMSE, R2, WAPE, MAPE over non-zero actuals, residual mean and deviation (all aggregates)."""
    err = actual - predicted
    sse, n = F.sum(err * err), F.count(err)
    sst = F.var_pop(actual) * n
    r2 = F.when(sst > 0, 1 - sse / sst).otherwise(F.when(sse == 0, 1.0).otherwise(0.0))
    scale = F.sum(F.abs(actual))
    return {
        "mae": F.avg(F.abs(err)),
        "mse": F.avg(err * err),
        "rmse": F.sqrt(F.avg(err * err)),
        "r2": r2,
        "wape": F.when(scale > 0, F.sum(F.abs(err)) / scale),
        "mape_nonzero_actual": F.avg(F.when(actual != 0, F.abs(err / actual))),
        "residual_mean": F.avg(err),
        "residual_std": F.stddev_pop(err),
    }


def day_measures(actual: Column, predicted: Column) -> dict[str, Column]:
    """Share of exact days after rounding, share within one day (aggregates)."""
    rounded = F.rint(numbers.clip_low(predicted))
    return {
        "exact_day_accuracy_rounded": numbers.rate(rounded == actual),
        "within_1_day_accuracy": numbers.rate(F.abs(actual - predicted) <= 1),
    }


def evaluate(pred: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted", clip: bool = True,
             median: bool = True, days: bool = False) -> DataFrame:
    """One metric row per ``by`` group; predictions are clipped at 0 unless told not to.

    ``pred`` is read several times: stage it first.
    """
    value = numbers.clip_low(F.col(predicted)) if clip else F.col(predicted)
    rows = pred.select(*by, F.col(actual).cast("double").alias("_y"), value.alias("_p"))
    measures = error_measures(F.col("_y"), F.col("_p"))
    if days:
        measures.update(day_measures(F.col("_y"), F.col("_p")))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[m.alias(k) for k, m in measures.items()])
    if median:
        residuals = rows.select(*by, (F.col("_y") - F.col("_p")).alias("_e"))
        middle = exact_quantiles(residuals, by, "_e", {"residual_median": 0.5}, staged=True)
        out = out.join(middle, list(by)) if by else out.withColumn("residual_median", middle.scalar())
    return out


def fold_summary(pred: DataFrame, fold: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Row-weighted metrics over all folds next to the mean and median of the fold metrics."""
    value = numbers.clip_low(F.col(predicted))
    rows = pred.select(fold, F.col(actual).cast("double").alias("_y"), value.alias("_p"))
    per_fold = rows.groupBy(fold).agg(
        *[error_measures(F.col("_y"), F.col("_p"))[m].alias(m) for m in ("mae", "wape")]
    )
    overall = error_measures(F.col("_y"), F.col("_p"))
    total = rows.agg(
        F.count(F.lit(1)).alias("test_rows"),
        overall["mae"].alias("weighted_mae"),
        overall["mse"].alias("weighted_mse"),
        overall["rmse"].alias("global_rmse"),
        overall["r2"].alias("global_r2"),
        overall["wape"].alias("global_wape"),
        overall["mape_nonzero_actual"].alias("global_mape"),
    )
    # Folds are months: a few hundred rows, so the built-in median is bounded.
    folds = per_fold.agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("mae").alias("mean_fold_mae"),
        F.median("mae").alias("median_fold_mae"),
        F.avg("wape").alias("mean_fold_wape"),
    )
    return total.select("*", *[folds.select(c).scalar().alias(c) for c in folds.columns])


def residuals_long(pred: DataFrame, keys: Sequence[str], models: Sequence[str], actual: str = "actual") -> DataFrame:
    """(keys, model, actual, predicted, residual, absolute_error) rows from one column per model."""
    long = pred.unpivot([*keys, actual], list(models), "model", "predicted")
    err = F.col(actual) - F.col("predicted")
    return long.withColumn("residual", err).withColumn("absolute_error", F.abs(err))


def residual_summary(residuals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, MAE, mean, population deviation and median of the residuals per group."""
    out = residuals.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.abs("residual")).alias("mae"),
        F.avg("residual").alias("residual_mean"),
        F.stddev_samp("residual").alias("residual_std_samp"),
        F.stddev_pop("residual").alias("residual_std_pop"),
    )
    middle = exact_quantiles(residuals, by, "residual", {"residual_median": 0.5})
    return out.join(middle, list(by))


def best_gap(metrics: DataFrame, metric: str = "mae", prefix: str = "Baseline") -> DataFrame:
    """Best rule, best model, and how far the model is behind the rule.

    ``metrics`` has one row per model, so its single-row result is a tiny aggregate.
    """
    rule = F.col("model").startswith(prefix)
    order = F.struct(F.col(metric), F.col("model"))
    out = metrics.agg(
        F.min(F.when(rule, order)).alias("r"),
        F.min(F.when(~rule, order)).alias("m"),
    ).select(
        F.col("r.model").alias("best_rule"),
        F.col(f"r.{metric}").alias("rule_error"),
        F.col("m.model").alias("best_model"),
        F.col(f"m.{metric}").alias("model_error"),
    )
    gap = F.col("model_error") - F.col("rule_error")
    return out.withColumn("gap", gap).withColumn("gap_pct", F.try_divide(F.col("gap"), F.col("rule_error")))


def improvement_flag(gap: Column, threshold: float = 0.02) -> Column:
    """Verdict on the error saved: better, worse, or no clear difference."""
    return F.when(gap > threshold, "improves").when(gap < -threshold, "worsens").otherwise("no clear change")
