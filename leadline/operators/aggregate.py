"""Grouped summaries, top-k, reshaping and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadline.functions import labels, numbers
from leadline.operators.order_stats import exact_quantiles


def summarise(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], having: Column | None = None,
              drop_null_keys: bool = True) -> DataFrame:
    """One grouped aggregation; null keys are dropped unless asked for, ``having`` filters groups."""
    source = df.na.drop(subset=list(keys)) if drop_null_keys and keys else df
    out = source.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()])
    return out.filter(having) if having is not None else out


def mode_by(df: DataFrame, keys: Sequence[str], value: str, name: str, unknown: str | None = None,
            weight: str | None = None) -> DataFrame:
    """Most frequent non-null value per key, the smallest on ties; ``weight`` holds the rows a row stands for.

    Values are counted first, so a huge group reaches the last step as one row per value.
    Groups without any value get ``unknown`` (text) or null.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*keys, value).agg(rows.alias("_n"))
    # A null value loses to every real one, whatever its count.
    rank = F.struct(F.col(value).isNull(), -F.col("_n"), F.col(value))
    best = F.min_by(F.col(value), rank)
    if unknown is not None:
        best = F.coalesce(best, F.lit(unknown))
    return counts.groupBy(*keys).agg(best.alias(name))


def median_by(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def with_share(df: DataFrame, measure: str, name: str) -> DataFrame:
    """Share of the measure's total over the (already aggregated) rows, total as a scalar subquery."""
    return df.withColumn(name, F.col(measure) / df.agg(F.sum(measure)).scalar())


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, keys: Sequence[str], k: int, *order: Column | str) -> DataFrame:
    """First k rows of each group; Spark cuts each map task to k rows per group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def in_value_order(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.orderBy(labels.ordinal_of(F.col(column), values), column)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence, row_order: Sequence[str] | None = None,
             prefix: str = "n", normalise: bool = False) -> DataFrame:
    """Counts of ``column`` values per ``row`` value, 0 where absent; shares of the row on request.

    Columns are conditional counts over a fixed value list: one partial aggregation, no
    job to find the values.
    """
    hit = {f"{prefix}_{str(v).lower().replace('-', 'm')}": numbers.count_if(F.col(column) == F.lit(v)) for v in values}
    out = summarise(df.na.drop(subset=[column]), [row], hit)
    if normalise:
        total = sum((F.col(c) for c in hit), F.lit(0))
        out = out.select(row, *[(F.col(c) / total).alias(c) for c in hit])
    return in_value_order(out, row, row_order) if row_order else out


def pivot_measure(df: DataFrame, row: str, column: str, values: dict[str, object], measure: str) -> DataFrame:
    """One column per listed value of ``column`` holding the measure, missing cells 0."""
    cells = {
        name: F.coalesce(F.max(F.when(F.col(column) == F.lit(v), F.col(measure))), F.lit(0.0))
        for name, v in values.items()
    }
    return summarise(df, [row], cells)


def correlations(df: DataFrame, columns: Sequence[str], target: str, k: int = 15) -> DataFrame:
    """Pearson correlation of each column with the target (pairwise nulls skipped), strongest first."""
    values = df.select(*[F.col(c).cast("double").alias(c) for c in (*columns, target)])
    row = values.agg(*[F.corr(c, target).alias(c) for c in columns])
    long = row.unpivot([], list(columns), "feature", "correlation")
    return long.orderBy(F.abs("correlation").desc_nulls_last(), "feature").limit(k)


def histogram(df: DataFrame, value: str, bins: int, clip_at: float | None = None) -> DataFrame:
    """Equal-width histogram of the non-null values, optionally of those up to a quantile.

    The range is read first (two numbers); the top edge belongs to the last bin.
    """
    data = df.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if clip_at is not None:
        upper = exact_quantiles(data, [], "_v", {"upper": clip_at}).first()["upper"]
        data = data.filter(F.col("_v") <= F.lit(upper))
    lo, hi = (F.lit(edge).cast("double") for edge in data.agg(F.min("_v"), F.max("_v")).first())
    width = (hi - lo) / F.lit(float(bins))
    cell = F.when(hi > lo, F.least(F.floor((F.col("_v") - lo) / width), F.lit(bins - 1))).otherwise(0)
    return (
        data.withColumn("bin", cell.cast("long"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_low", lo + F.col("bin") * width)
    )


def seeded_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The same n rows on every run and every partitioning: those with the smallest key hashes."""
    return df.orderBy(F.xxhash64(*[F.col(c) for c in key], F.lit(seed)), *key).limit(n)
