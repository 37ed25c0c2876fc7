"""Who and what sells: banded sales features and grouped sales reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadline.functions import dates, labels, numbers
from leadline.operators.aggregate import in_value_order, with_share
from leadline.operators.joins import full_outer_filled
from leadline.operators.order_stats import rank_bands
from leadline.session import stage


@dataclass(frozen=True)
class SalesColumns:
    ts: str = "order_ts"
    sales: str = "sales"
    order_id: str = "order_id"
    quantity: str = "quantity"
    price: str = "price"
    discount: str = "discount"
    discount_rate: str = "discount_rate"
    profit_ratio: str = "profit_ratio"
    customer: str = "customer_id"


def add_sales_calendar(df: DataFrame, c: SalesColumns = SalesColumns()) -> DataFrame:
    """Drop rows without time or sales; add calendar labels and discount, quantity and margin bins."""
    ts = F.col(c.ts)
    return df.na.drop(subset=[c.ts, c.sales]).withColumns(
        {
            "order_date": F.to_date(ts),
            "order_year_month": dates.month_label(ts),
            "order_month_name": dates.month_name(ts),
            "order_day_name": dates.day_name(ts),
            "order_quarter": dates.quarter_label(ts),
            "is_weekend": dates.is_weekend(ts),
            "is_generic_fixed_holiday": dates.is_fixed_holiday(ts),
            "calendar_period": dates.calendar_period(ts),
            "has_discount": labels.has_discount(F.col(c.discount)),
            "discount_rate_bin": labels.cut(
                F.coalesce(F.col(c.discount_rate), F.lit(0.0)), labels.DISCOUNT_RATE_EDGES, labels.DISCOUNT_RATE_LABELS
            ),
            "discount_amount_bin": labels.cut(
                F.coalesce(F.col(c.discount), F.lit(0.0)), labels.DISCOUNT_AMOUNT_EDGES, labels.DISCOUNT_AMOUNT_LABELS
            ),
            "quantity_bin": F.col(c.quantity).cast("long").cast("string"),
            "profit_ratio_bin": labels.cut(
                numbers.finite_or_null(F.col(c.profit_ratio)), labels.PROFIT_RATIO_EDGES, labels.PROFIT_RATIO_LABELS
            ),
        }
    )


def add_price_band(df: DataFrame, key: Sequence[str], price: str = "price") -> DataFrame:
    """Five price bands by first-come rank of the lines."""
    return rank_bands(df, [price, *key], labels.PRICE_BANDS, "product_price_bin")


def customer_totals(df: DataFrame, customer: str = "customer_id", sales: str = "sales", name: str = "customer_total_sales") -> DataFrame:
    """A row per customer. Sums are rounded to a hundred-thousandth so that a rerun ranks customers alike."""
    return df.groupBy(customer).agg(F.round(F.sum(sales), 5).alias(name))


def add_customer_total(df: DataFrame, customer: str = "customer_id", sales: str = "sales", name: str = "customer_total_sales") -> DataFrame:
    """The customer's total sales on each line.

    Aggregate and join back instead of a window: partial sums keep a huge customer out of
    a single task. The total covers the whole table, so it is for reports, not for models.
    """
    return df.join(customer_totals(df, customer, sales, name), customer, "left")


def add_customer_band(df: DataFrame, key: Sequence[str], total: str = "customer_total_sales") -> DataFrame:
    """Five value bands by first-come rank of the lines; one customer may straddle two bands."""
    return rank_bands(df, [total, *key], labels.CUSTOMER_BANDS, "customer_value_band")


def add_customer_band_per_customer(df: DataFrame, customer: str = "customer_id", sales: str = "sales") -> DataFrame:
    """Variant that ranks customers, not lines, so that each customer has one band.

    ``df`` is read twice; its totals are staged, as the search of the bands reads them several times.
    """
    totals = stage(df.filter(F.col(customer).isNotNull()).groupBy(customer).agg(F.round(F.sum(sales), 5).alias("customer_total_sales")))
    banded = rank_bands(totals, ["customer_total_sales", customer], labels.CUSTOMER_BANDS, "customer_value_band")
    return df.join(banded, customer, "left")


_MEASURES = ["sales", "orders", "rows", "avg_sale", "avg_quantity", "avg_discount_rate"]


def _folded(df: DataFrame, dimensions: dict[str, str], c: SalesColumns, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """feature, value (as text) and measures per value of many dimensions; ``orders`` counts different orders.

    The lines of an order are brought together and in a row, so a task counts an order once per value by what it has seen
    of the order it is at. Each line is moved once, whatever the number of dimensions, and no task keeps orders.
    ``derive`` adds dimensions after the move, so that they are not moved.
    """
    names = list(dimensions)
    measures = [F.col(x).cast("double").alias(n) for x, n in ((c.sales, "_s"), (c.quantity, "_q"), (c.discount_rate, "_d"))]
    cells = [F.col(column).cast("string").alias(f"_v{k}") for k, column in enumerate(dimensions.values())]
    moved = df.withColumn("_order", F.col(c.order_id)).repartition("_order").sortWithinPartitions("_order")
    lines = (moved if derive is None else derive(moved)).select("_order", *measures, *cells)
    sums = ["_s", "_q", "_d", "_sn", "_qn", "_dn", "_n", "_orders"]
    schema = "feature string, value string, " + ", ".join(f"{x} {'double' if x in ('_s', '_q', '_d') else 'long'}" for x in sums)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, [set() for _ in names]
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("_order").dictionary_encode(null_encoding="encode")
            order, ids = coded.indices.to_numpy(), coded.dictionary
            if not (ids[0].is_valid and ids[0].as_py() == last):
                seen = [set() for _ in names]
            last, tail = ids[len(ids) - 1].as_py(), int(np.searchsorted(order, len(ids) - 1))
            known = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            weights = [(x.fill_null(0.0).to_numpy(), x.is_valid().to_numpy(zero_copy_only=False)) for x in map(batch.column, ("_s", "_q", "_d"))]
            for k, name in enumerate(names):
                cell = batch.column(f"_v{k}").dictionary_encode(null_encoding="encode")
                code, values = cell.indices.to_numpy(), cell.dictionary
                m = len(values)
                pairs = np.unique(order.astype(np.int64) * m + code)
                pairs = pairs[np.isin(pairs // m, known)] if len(known) < len(ids) else pairs
                words = values.to_pylist()
                if seen[k]:
                    again = [i for i, w in enumerate(words) if w in seen[k]]
                    pairs = pairs[~((pairs < m) & np.isin(pairs, again))]
                at_end = {words[i] for i in np.unique(code[tail:])}
                seen[k] = seen[k] | at_end if len(ids) == 1 else at_end
                out = [np.bincount(code, w, m) for w, _ in weights] + [np.bincount(code[ok], minlength=m) for _, ok in weights]
                out += [np.bincount(code, minlength=m), np.bincount(pairs % m, minlength=m)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * m, pa.string()), values, *map(pa.array, out)], names=["feature", "value", *sums])

    added = lines.mapInArrow(fold, schema).groupBy("feature", "value").agg(*[F.sum(x).alias(x) for x in sums])
    mean = lambda x: F.try_divide(F.col(x), F.col(f"{x}n"))
    return added.select(
        "feature",
        "value",
        F.when(F.col("_sn") > 0, F.col("_s")).alias("sales"),
        F.col("_orders").alias("orders"),
        F.col("_n").alias("rows"),
        mean("_s").alias("avg_sale"),
        mean("_q").alias("avg_quantity"),
        mean("_d").alias("avg_discount_rate"),
    )


def sales_by(df: DataFrame, column: str, top_n: int | None = None, value_order: Sequence[str] | None = None,
             c: SalesColumns = SalesColumns()) -> DataFrame:
    """Sales, orders, lines and averages per value of a dimension, with the share of all sales.

    Null is a value of the dimension. Shares refer to all values, also when only the top ones are returned.
    """
    q, d, s = F.col(c.quantity), F.col(c.discount_rate), F.col(c.sales)
    kind = df.schema[column].dataType
    grouped = _folded(df, {column: column}, c).select(F.col("value").cast(kind).alias(column), *_MEASURES)
    # The total is read from the staged groups, not by a second scan of the lines.
    out = with_share(stage(grouped), "sales", "sales_share")
    if value_order is not None:
        out = in_value_order(out, column, value_order)
    elif top_n is not None:
        out = out.orderBy(F.desc("sales"), column).limit(top_n)
    else:
        out = out.orderBy(F.desc("sales"), column)
    rest = [x for x in out.columns if x != column]
    return out.select(F.lit(column).alias("feature"), labels.short_label(F.col(column)).alias("value"), *rest)


def sales_report(df: DataFrame, dimensions: dict[str, tuple[str, int | None]], c: SalesColumns = SalesColumns(),
                 derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Many ``sales_by`` reports in one table, told apart by ``feature``, from one pass over the lines.

    ``dimensions`` names each report's column and its top n (None: all values). Totals, shares and top rows are read
    from the staged groups. ``derive`` adds columns of dimensions that follow from a line alone; they are not moved.
    """
    grouped = stage(_folded(df, {name: column for name, (column, _) in dimensions.items()}, c, derive))
    totals = grouped.groupBy("feature").agg(F.sum("sales").alias("_total"))
    shared = grouped.join(totals, "feature").withColumn("sales_share", F.col("sales") / F.col("_total")).drop("_total")
    cut = {name: n for name, (_, n) in dimensions.items() if n is not None}
    if cut:
        rank = F.row_number().over(W.partitionBy("feature").orderBy(F.desc("sales"), "value"))
        first = shared.filter(F.col("feature").isin(list(cut))).withColumn("_rank", rank).filter(F.col("_rank") <= max(cut.values()))
        allowed = F.element_at(F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]), F.col("feature"))
        shared = shared.filter(~F.col("feature").isin(list(cut))).unionByName(first.filter(F.col("_rank") <= allowed).drop("_rank"))
    return shared.withColumn("value", labels.short_label(F.col("value")))


def sales_versus_views(lines: DataFrame, events: DataFrame, key: str, sales: str = "sales") -> DataFrame:
    """Share of sales against share of web views per product; products on either side count."""
    sold = lines.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(sales).alias("sales"))
    seen = events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("views"))
    both = full_outer_filled(sold, seen, key, ["sales", "views"]).filter((F.col("sales") > 0) | (F.col("views") > 0))
    both = with_share(with_share(stage(both), "sales", "sales_share"), "views", "views_share")
    return both.withColumn("share_gap_sales_minus_views", F.col("sales_share") - F.col("views_share"))
