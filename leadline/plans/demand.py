"""How many units of each product will sell each day: panel, simple rules, recommendation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.functions import dates, labels
from leadline.operators.aggregate import mode_by
from leadline.operators.joins import lookup_mean
from leadline.operators.panel import densify, lag_columns, rolling_columns
from leadline.session import stage

# Horizons of the panel's history.
LAGS = [1, 7, 30, 365]
GROUP_LAGS = [1, 7, 30]
WINDOWS = [7, 30]
SUMS = ["quantity_sold", "sales_sum", "order_lines"]
MEANS = ["avg_price", "avg_discount", "avg_discount_rate"]

RULES = {
    "Baseline global train mean": "global_mean",
    "Baseline product train mean": "product_mean",
    "Baseline lag 1d by Product": "lag_1d",
    "Baseline rolling 7d by Product": "rolling_7d",
    "Baseline rolling 30d by Product": "rolling_30d",
}
RULE_LABELS = {
    "Baseline rolling 7d by Product": "Referencia 7 dias por producto",
    "Baseline lag 1d by Product": "Ultimo dia por producto",
    "Baseline rolling 30d by Product": "Referencia 30 dias por producto",
    "Baseline product train mean": "Media historica por producto",
    "Baseline global train mean": "Media global",
}


@dataclass(frozen=True)
class DemandColumns:
    ts: str = "order_ts"
    product: str = "product"
    category: str = "category"
    department: str = "department"
    quantity: str = "quantity"
    sales: str = "sales"
    price: str = "price"
    discount: str = "discount"
    discount_rate: str = "discount_rate"


def daily_cells(lines: DataFrame, c: DemandColumns = DemandColumns()) -> DataFrame:
    """Sums and counts per (product, day, category, department): all the panel needs from the lines, in one scan."""
    rows = lines.na.drop(subset=[c.ts, c.product]).withColumn("order_date", F.to_date(c.ts))
    means = {"avg_price": c.price, "avg_discount": c.discount, "avg_discount_rate": c.discount_rate}
    return rows.groupBy(c.product, "order_date", c.category, c.department).agg(
        F.sum(c.quantity).alias("quantity_sold"),
        F.sum(c.sales).alias("sales_sum"),
        F.count(F.lit(1)).alias("order_lines"),
        *[F.sum(source).alias(f"{name}_sum") for name, source in means.items()],
        *[F.count(source).alias(f"{name}_n") for name, source in means.items()],
    )


def daily_facts(cells: DataFrame, c: DemandColumns = DemandColumns()) -> DataFrame:
    """Product-by-day facts of the days with sales."""
    return cells.groupBy(c.product, "order_date").agg(
        *[F.sum(name).alias(name) for name in SUMS],
        *[F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n")).alias(name) for name in MEANS],
    )


def product_meta(cells: DataFrame, c: DemandColumns = DemandColumns()) -> DataFrame:
    """Usual category and department of each product, and the first day it sold."""
    first = cells.groupBy(c.product).agg(F.min("order_date").alias("product_first_seen"))
    return (
        first.join(mode_by(cells, [c.product], c.category, "category_name", "Unknown", "order_lines"), c.product)
        .join(mode_by(cells, [c.product], c.department, "department_name", "Unknown", "order_lines"), c.product)
    )


def demand_panel(lines: DataFrame, c: DemandColumns = DemandColumns()) -> tuple[DataFrame, list[str]]:
    """Product x day panel with product, category and overall history; returns it with the feature names.

    The lines are scanned once, into staged cells. Product windows run on the densified facts
    without another shuffle. Category and overall totals are added up from the sparse
    facts, densified on their own small keys, and joined to the panel.
    """
    cells = stage(daily_cells(lines, c))
    facts = daily_facts(cells, c)
    meta = product_meta(cells, c)
    day = "order_date"
    first, last = (F.lit(d).cast("date") for d in cells.agg(F.min(day), F.max(day)).first())
    product = [c.product]

    own: dict[str, Column] = {}
    for column in SUMS + MEANS:
        own |= lag_columns(product, day, column, LAGS, "product_")
        own |= rolling_columns(product, day, column, WINDOWS, "product_")
    panel = densify(facts, product, day, SUMS, MEANS, first, last)
    panel = panel.select("*", *[col.alias(name) for name, col in own.items()])

    by_category = (
        facts.join(meta.select(c.product, "category_name"), c.product)
        .groupBy("category_name", day)
        .agg(F.sum("quantity_sold").alias("category_quantity_sold"), F.sum("sales_sum").alias("category_sales_sum"))
    )
    group: dict[str, Column] = {}
    for column in ("category_quantity_sold", "category_sales_sum"):
        group |= lag_columns(["category_name"], day, column, GROUP_LAGS)
        group |= rolling_columns(["category_name"], day, column, WINDOWS, sums=False)
    by_category = densify(
        by_category, ["category_name"], day, ["category_quantity_sold", "category_sales_sum"], (), first, last
    ).select("category_name", day, *[col.alias(name) for name, col in group.items()])

    # One row per day: the windows without key run over the length of the calendar only.
    everything = lag_columns([], day, "global_quantity_sold", GROUP_LAGS)
    everything |= rolling_columns([], day, "global_quantity_sold", WINDOWS, sums=False)
    overall = facts.groupBy(day).agg(F.sum("quantity_sold").alias("global_quantity_sold"))
    overall = densify(overall, [], day, ["global_quantity_sold"], (), first, last)
    overall = overall.select(day, *[col.alias(name) for name, col in everything.items()])

    panel = panel.join(meta, c.product).join(by_category, ["category_name", day], "left").join(overall, day, "left")
    panel = panel.withColumns(
        {
            "had_sale": (F.col("order_lines") > 0).cast("int"),
            "days_since_product_first_seen": dates.days_since(day, "product_first_seen"),
            "is_generic_fixed_holiday": dates.is_fixed_holiday(day).cast("int"),
            "calendar_period": dates.calendar_period(day),
            **dates.calendar_columns(day, hour=False),
        }
    )
    return panel, [*own, *group, *everything]


def rule_predictions(panel: DataFrame, test_start: str, product: str = "product", target: str = "quantity_sold") -> DataFrame:
    """Test rows with one prediction column per rule; a missing history gives the training mean."""
    day = F.col("order_date")
    start = F.lit(test_start).cast("date")
    train, test = panel.filter(day < start), panel.filter(day >= start)
    overall = train.agg(F.avg(target)).scalar()
    test = test.select(
        product,
        "order_date",
        F.col(target).cast("double").alias("actual"),
        overall.alias("global_mean"),
        *[
            F.coalesce(F.col(f"product_{target}_{history}"), overall).alias(rule)
            for rule, history in {"lag_1d": "lag_1d", "rolling_7d": "roll_mean_7d", "rolling_30d": "roll_mean_30d"}.items()
        ],
    )
    return lookup_mean(test, train, product, target, "product_mean")


def long_rule_predictions(predictions: DataFrame, product: str = "product") -> DataFrame:
    """(product, day, actual, model, predicted) rows, models under their full names."""
    wide = predictions.select(
        product, "order_date", "actual", *[F.col(column).alias(name) for name, column in RULES.items()]
    )
    return wide.unpivot([product, "order_date", "actual"], list(RULES), "model", "predicted")


def monthly_totals(predictions: DataFrame, predicted: str, day: str = "order_date", actual: str = "actual") -> DataFrame:
    return predictions.groupBy(dates.month_label(day).alias("month")).agg(
        F.sum(actual).alias("actual_quantity"), F.sum(predicted).alias("predicted_quantity"), F.count(F.lit(1)).alias("n_rows")
    )


def monthly_reference(panel: DataFrame, test_start: str, target: str = "quantity_sold") -> DataFrame:
    """Actual and recommended units per test month; days without history are predicted as 0."""
    test = panel.filter(F.col("order_date") >= F.lit(test_start).cast("date"))
    rule = F.coalesce(F.col(f"product_{target}_roll_mean_7d"), F.lit(0.0))
    return monthly_totals(test.select("order_date", F.col(target).alias("actual"), rule.alias("recommended")), "recommended")


def total_gap(monthly: DataFrame) -> DataFrame:
    """Grand totals, their gap and the gap as a share of the actual units."""
    gap = F.col("total_predicted") - F.col("total_actual")
    return (
        monthly.agg(F.sum("actual_quantity").alias("total_actual"), F.sum("predicted_quantity").alias("total_predicted"))
        .withColumn("total_gap", gap)
        .withColumn("total_gap_pct", F.try_divide(gap, F.col("total_actual")))
    )


def rank_systems(metrics: DataFrame, models: dict[str, str] = RULE_LABELS) -> DataFrame:
    """Metrics of the compared systems under their report names, best first."""
    chosen = metrics.filter(F.col("model").isin(list(models)))
    return chosen.withColumn("system", labels.relabel(F.col("model"), models)).orderBy("mae", "model")
