"""Is the delivery promise right? Promise-versus-actual reports and a better promise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadline.functions import numbers
from leadline.operators.aggregate import crosstab, summarise, top_per_group


def with_delay(lines: DataFrame, actual: str = "actual_days", promised: str = "promised_days") -> DataFrame:
    """Add ``delay_days`` and ``underestimated`` (actual over promised; false when unknown)."""
    delay = F.col(actual) - F.col(promised)
    return lines.withColumn("delay_days", delay).withColumn("underestimated", numbers.flag(delay > 0))


def mode_calibration(lines: DataFrame, mode: str = "shipping_mode", order_id: str = "order_id", late: str = "official_late",
                     canceled: str = "is_canceled") -> DataFrame:
    """Promise, outcome and error of every mode in one aggregation, latest mode first."""
    out = summarise(
        with_delay(lines),
        [mode],
        {
            "orders": F.count(order_id),
            "official_late_rate": numbers.rate(F.col(late)),
            "promised_days": F.avg("promised_days"),
            "actual_days": F.avg("actual_days"),
            "mean_error_days": F.avg("delay_days"),
            "underestimated_rate": numbers.rate(F.col("underestimated")),
            "canceled_rate": numbers.rate(F.col(canceled)),
        },
    )
    out = out.withColumns(
        {
            "official_late_pct": numbers.percent(F.col("official_late_rate")),
            "underestimated_rate_pct": numbers.percent(F.col("underestimated_rate")),
            "canceled_pct": numbers.percent(F.col("canceled_rate")),
        }
    )
    return out.orderBy(F.desc("official_late_pct"), mode)


def lateness_by(lines: DataFrame, keys: Sequence[str], min_orders: int = 0, modes: Sequence[str] | None = None,
                mode: str = "shipping_mode", late: str = "official_late") -> DataFrame:
    """Lateness per group, for the given modes, groups under ``min_orders`` left out."""
    source = with_delay(lines)
    if modes is not None:
        source = source.filter(F.col(mode).isin(list(modes)))
    out = summarise(
        source,
        keys,
        {"orders": F.count("order_id"), "official_late_rate": numbers.rate(F.col(late)), "mean_error_days": F.avg("delay_days")},
        having=F.col("orders") >= min_orders,
    )
    return out.withColumn("official_late_pct", numbers.percent(F.col("official_late_rate")))


def critical_places(lines: DataFrame, place: str, min_orders: int, k: int, modes: Sequence[str],
                    mode: str = "shipping_mode") -> DataFrame:
    """The k latest places of each mode."""
    ranked = lateness_by(lines, [mode, place], min_orders, modes, mode)
    return top_per_group(ranked, [mode], k, F.desc("official_late_pct"), F.col(place))


def status_crosstab(lines: DataFrame, status: str = "delivery_status") -> DataFrame:
    """How the stated delivery status splits by the arithmetic one, in percent of the status."""
    counts = crosstab(with_delay(lines), status, "underestimated", [False, True], prefix="underestimated", normalise=True)
    return counts.select(
        status, *[(F.bround(F.col(c), 4) * 100).alias(f"{c}_pct") for c in counts.columns if c != status]
    )


def recommend_promise(lines: DataFrame, mode: str = "shipping_mode", actual: str = "actual_days",
                      promised: str = "promised_days", late: str = "official_late") -> DataFrame:
    """Promise the mean rounded up to whole days; broken promises before and after.

    Lines are counted once per (mode, promised, actual) cell, in one scan. Everything after
    that works on the cells, a handful per mode, so no mode is a hot group.
    """
    days, n = F.col(actual), F.col("_n")
    per_mode, per_promise = W.partitionBy(mode), W.partitionBy(mode, promised)
    mean = F.sum(days * n).over(per_mode) / F.sum(n).over(per_mode)
    cells = (
        lines.na.drop(subset=[mode, actual, promised, late])
        .groupBy(mode, actual, promised)
        .agg(F.count(F.lit(1)).alias("_n"), numbers.count_if(F.col(late)).alias("_late"))
        .withColumns({"_mean": mean, "_promise_lines": F.sum(n).over(per_promise)})
        .withColumn("_better", F.ceil("_mean").cast("int"))
    )
    broken, still_broken = (F.sum(F.when(days > limit, n).otherwise(0)) for limit in (F.col(promised), F.col("_better")))
    summary = cells.groupBy(mode).agg(
        F.sum("_n").alias("orders"),
        F.min_by(promised, F.struct(-F.col("_promise_lines"), F.col(promised))).alias("current_promise_days"),
        F.first("_mean").alias("actual_mean_days"),
        F.percentile(days, F.lit(0.5), n).alias("actual_median_days"),
        broken.alias("current_broken_promises"),
        F.sum("_late").alias("official_late_orders"),
        F.first("_better").alias("recommended_baseline_days"),
        still_broken.alias("baseline_broken_promises"),
    )
    return (
        summary.withColumn("promises_fixed", F.col("current_broken_promises") - F.col("baseline_broken_promises"))
        .withColumn("current_broken_rate", F.col("current_broken_promises") / F.col("orders"))
        .withColumn("baseline_broken_rate", F.col("baseline_broken_promises") / F.col("orders"))
        .withColumn("broken_rate_drop_pp", (F.col("current_broken_rate") - F.col("baseline_broken_rate")) * 100)
    )


def promise_compliance(lines: DataFrame, mode: str = "shipping_mode", actual: str = "actual_days",
                       promised: str = "promised_days") -> DataFrame:
    """Share of kept promises per mode."""
    met = numbers.rate(F.col(actual) <= F.col(promised))
    return summarise(
        lines,
        [mode],
        {
            "orders": F.count("order_id"),
            "promise_met_pct": F.bround(met * 100, 2),
            "promised_days": F.bround(F.avg(promised), 2),
            "actual_days": F.bround(F.avg(actual), 2),
        },
    )
