"""Monthly validation: retrained every month against trained once."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadline.functions import numbers
from leadline.operators.metrics import evaluate
from leadline.operators.models import ModelSpec, fit_model
from leadline.operators.split import month_folds

# Thresholds of the degradation report.
RATIO_LIMIT = 1.10
GAP_LIMIT = 2.0

GLOBAL_RULE, PRODUCT_RULE = "Baseline global mean", "Baseline mean by Product"


def month_means(lines: DataFrame, month: str, value: str) -> DataFrame:
    """Per month: its position, and the mean of all earlier months (one row per month)."""
    monthly = lines.groupBy(month).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    order = W.orderBy(month)
    past = order.rowsBetween(W.unboundedPreceding, -1)
    return monthly.select(
        month,
        F.row_number().over(order).alias("_index"),
        (F.sum("_s").over(past) / F.sum("_n").over(past)).alias("global_mean"),
    )


def walk_forward_rules(lines: DataFrame, month: str, value: str, product: str, keep: Sequence[str] = (), initial: int = 12) -> DataFrame:
    """Expanding-window means as predictions of every month after the first ``initial``.

    A fold never re-reads its training months: means per (product, month) are running sums
    over the monthly totals, so all folds together cost one aggregation and one join.
    """
    lines = lines.filter(F.col(month).isNotNull() & F.col(value).isNotNull())
    months = month_means(lines, month, value).filter(F.col("_index") > initial)
    past = W.partitionBy(product).orderBy(month).rowsBetween(W.unboundedPreceding, -1)
    products = (
        lines.filter(F.col(product).isNotNull())
        .groupBy(product, month)
        .agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
        .select(product, month, (F.sum("_s").over(past) / F.sum("_n").over(past)).alias("_mean"))
    )
    scored = lines.join(months, month).join(products, [product, month], "left")
    wide = scored.select(
        *keep,
        month,
        (F.col("_index") - initial).alias("fold"),
        F.col(value).alias("actual"),
        F.col("global_mean").alias(GLOBAL_RULE),
        F.coalesce("_mean", "global_mean").alias(PRODUCT_RULE),
    )
    return wide.unpivot([*keep, month, "fold", "actual"], [GLOBAL_RULE, PRODUCT_RULE], "model", "predicted")


def frozen_rules(lines: DataFrame, month: str, value: str, product: str, keep: Sequence[str] = (), initial: int = 12) -> DataFrame:
    """The same rules learnt once on the first ``initial`` months and never updated."""
    lines = lines.filter(F.col(month).isNotNull() & F.col(value).isNotNull())
    months = month_means(lines, month, value).select(month, (F.col("_index") - initial).alias("fold"))
    early = lines.join(months.filter(F.col("fold") <= 0).select(month), month, "left_semi")
    overall = early.agg(F.avg(value)).scalar()
    means = early.groupBy(product).agg(F.avg(value).alias("_mean"))
    wide = lines.join(months.filter(F.col("fold") > 0), month).join(means, product, "left").select(
        *keep,
        month,
        "fold",
        F.col(value).alias("actual"),
        overall.alias(GLOBAL_RULE),
        F.coalesce(F.col("_mean"), overall).alias(PRODUCT_RULE),
    )
    return wide.unpivot([*keep, month, "fold", "actual"], [GLOBAL_RULE, PRODUCT_RULE], "model", "predicted")


def walk_forward_models(rows: DataFrame, month: str, target: str, spec: ModelSpec, keep: Sequence[str], initial: int = 12,
                        step: int = 1, parallelism: int = 4) -> DataFrame:
    """One distributed fit per fold, several folds at a time; long predictions of all test months.

    Stage ``rows`` partitioned by month first: a fold then scans only the months it needs.
    """

    def run(fold: dict) -> DataFrame:
        train = rows.filter(F.col(month) <= fold["train_end"])
        test = rows.filter(F.col(month).between(fold["test_start"], fold["test_end"]))
        model = fit_model(train, target, spec)
        return model.predict(test, [*keep, month, F.lit(fold["fold"]).alias("fold"), F.col(target).cast("double").alias("actual")])

    folds = month_folds(rows, month, initial, step)
    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(run, folds))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def frozen_model(rows: DataFrame, month: str, target: str, spec: ModelSpec, keep: Sequence[str], initial: int = 12) -> DataFrame:
    """Fit once on the first months, score all later ones."""
    first = month_folds(rows, month, initial)[0]
    model = fit_model(rows.filter(F.col(month) <= first["train_end"]), target, spec)
    months = rows.select(month).distinct().filter(F.col(month) > first["train_end"])
    index = months.select(month, F.row_number().over(W.orderBy(month)).alias("fold"))
    later = rows.join(index, month)
    return model.predict(later, [*keep, month, "fold", F.col(target).cast("double").alias("actual")])


def month_scores(predictions: DataFrame, month: str) -> DataFrame:
    return evaluate(predictions, ["model", "fold", month])


def training_rows(lines: DataFrame, month: str, initial: int = 12) -> DataFrame:
    """Fold table: train range, test month, rows on both sides."""
    monthly = lines.filter(F.col(month).isNotNull()).groupBy(month).agg(F.count(F.lit(1)).alias("test_rows"))
    order = W.orderBy(month)
    past = order.rowsBetween(W.unboundedPreceding, -1)
    return (
        monthly.select(
            (F.row_number().over(order) - initial).alias("fold"),
            F.first(month).over(past).alias("train_month_start"),
            F.last(month).over(past).alias("train_month_end"),
            F.col(month).alias("test_month"),
            F.sum("test_rows").over(past).alias("train_rows"),
            "test_rows",
        )
        .filter(F.col("fold") > 0)
    )


def compare_frozen(frozen: DataFrame, walking: DataFrame, month: str, metrics: Sequence[str] = ("mae", "rmse", "r2", "wape", "mape_nonzero_actual")
                   ) -> DataFrame:
    """Frozen against retrained per month: gap, ratio and the two degradation flags."""
    keys = ["model", month]
    left = frozen.select(*keys, F.col("fold").alias("month_index_after_train"), *[F.col(m).alias(f"static_{m}") for m in metrics])
    right = walking.select(*keys, *[F.col(m).alias(f"walk_forward_{m}") for m in metrics])
    gap = F.col("static_mae") - F.col("walk_forward_mae")
    ratio = F.try_divide(F.col("static_mae"), F.col("walk_forward_mae"))
    return left.join(right, keys, "left").withColumns(
        {
            "mae_gap_static_minus_walk": gap,
            "mae_ratio_static_vs_walk": ratio,
            "degraded_over_10pct": numbers.flag(ratio > RATIO_LIMIT),
            "degraded_over_abs_threshold": numbers.flag(gap > GAP_LIMIT),
        }
    )


def stable_months(comparison: DataFrame, month: str) -> DataFrame:
    """First breach of each threshold, months held before it, and the worst month, per model.

    No breach gives null: the model held for all months seen.
    """
    index = F.col("month_index_after_train")

    def first_breach(flag: str) -> list:
        hit = F.col(flag)
        return [
            F.min(F.when(hit, index)).alias(f"{flag}_index"),
            F.min_by(F.when(hit, F.col(month)), F.when(hit, index)).alias(f"{flag}_month"),
        ]

    out = comparison.groupBy("model").agg(
        *first_breach("degraded_over_10pct"),
        *first_breach("degraded_over_abs_threshold"),
        F.max_by(month, F.struct("mae_gap_static_minus_walk", month)).alias("worst_month"),
        F.max("mae_gap_static_minus_walk").alias("worst_gap"),
    )
    return out.withColumn("stable_months", F.col("degraded_over_abs_threshold_index") - 1)
