"""Table profiling: each report is one or two aggregations over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.functions import dates, numbers
from leadline.operators.order_stats import exact_quantiles


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _long(wide: DataFrame, columns: Sequence[str], parts: dict[str, str], name: str = "column_name") -> DataFrame:
    """One row per column from a one-row frame that holds ``<part>__<column>`` cells."""
    structs = [
        F.struct(F.lit(c).alias(name), *[F.col(f"`{part}__{c}`").alias(out) for part, out in parts.items()])
        for c in columns
    ]
    return wide.select(F.inline(F.array(*structs)))


def per_column(df: DataFrame, columns: Sequence[str], measures: dict[str, "callable"]) -> DataFrame:
    """Aggregate measures of every column in one pass, one output row per column.

    ``measures`` maps an output name to a function from a column to an aggregate.
    """
    cells = [make(F.col(f"`{c}`")).alias(f"{m}__{c}") for c in columns for m, make in measures.items()]
    return _long(df.agg(*cells), columns, {m: m for m in measures})


def unpivot_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) rows of the columns as text."""
    return df.unpivot([], [F.col(f"`{c}`").cast("string").alias(c) for c in columns], "column_name", "value")


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))


def column_info(df: DataFrame) -> DataFrame:
    types = dict(df.dtypes)
    kind = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    return per_column(df, df.columns, {"non_null": F.count}).withColumn("data_type", kind[F.col("column_name")])


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles, max."""
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    moments = per_column(
        values,
        columns,
        {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max},
    )
    long = values.unpivot([], list(columns), "column_name", "value")
    quartiles = exact_quantiles(long, ["column_name"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return moments.join(quartiles, "column_name", "left")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value); null is a value."""
    return unpivot_text(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value and its frequency (smallest value on ties)."""
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    return counts.groupBy("column_name").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    counts = per_column(df, columns, {"nulls": lambda c: numbers.count_if(c.isNull()), "n_rows": lambda c: F.count(F.lit(1))})
    share = F.bround(F.col("nulls") / F.col("n_rows") * 100, 2)
    return counts.select("column_name", "nulls", share.alias("null_pct")).orderBy(F.desc("null_pct"), F.desc("nulls"), "column_name")


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column and their share of rows.

    The exact form counts (column, value) pairs, so partial aggregation shrinks the shuffle;
    several ``countDistinct`` in one aggregate would expand the rows instead.
    """
    columns = list(columns or df.columns)
    if approximate:
        counts = per_column(df, columns, {"n_distinct": F.approx_count_distinct})
    else:
        pairs = value_counts(df, columns)
        present = F.count(F.when(F.col("value").isNotNull(), 1))
        counts = pairs.groupBy("column_name").agg(present.alias("n_distinct"))
    total = df.agg(F.count(F.lit(1))).scalar()
    pct = F.bround(F.col("n_distinct") / total * 100, 2)
    return counts.withColumn("distinct_pct", pct).orderBy(F.desc("n_distinct"), "column_name")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows, surplus copies and their share."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
        .withColumn("duplicates", F.col("n_rows") - F.col("n_distinct"))
        .withColumn("duplicate_pct", F.bround(F.col("duplicates") / F.col("n_rows") * 100, 2))
    )


def date_like_columns(
    df: DataFrame, columns: Sequence[str], formats: Sequence[str], min_success: float = 0.8, sample_size: int | None = None
) -> DataFrame:
    """Text columns that parse as timestamps often enough, with the range of parsed values.

    All rows are parsed; a first-rows sample is taken only when ``sample_size`` is given.
    """
    source = df.limit(sample_size) if sample_size else df
    measures = {
        "success": lambda c: F.avg(F.when(c.isNotNull(), dates.parse_timestamp_any(c, formats).isNotNull().cast("double"))),
        "first_ts": lambda c: F.min(dates.parse_timestamp_any(c, formats)),
        "last_ts": lambda c: F.max(dates.parse_timestamp_any(c, formats)),
    }
    return per_column(source, columns, measures).filter(F.col("success") >= min_success)


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column with count and share of rows; null counts as a value."""
    counts = value_counts(df, columns)
    order = W.partitionBy("column_name").orderBy(F.desc("n"), F.col("value").asc_nulls_first())
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        counts.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
        .withColumn("pct", F.bround(F.col("n") / total * 100, 2))
    )


def keyword_hits(df: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    """Rows whose lower-cased text contains each keyword, all in one pass."""
    low = F.lower(F.col(text))
    cells = [numbers.count_if(low.contains(kw)).alias(f"hits__{kw}") for kw in keywords]
    return _long(df.agg(*cells), keywords, {"hits": "hits"}, "keyword")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of every value, nulls kept."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.bround(F.col("n") / df.agg(F.count(F.lit(1))).scalar() * 100, 2))


def prevalence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Positive count and percentage of boolean columns."""
    counts = per_column(
        df, flags, {"positive_count": lambda c: F.sum(c.cast("long")), "positive_rate": lambda c: F.avg(c.cast("double"))}
    )
    return counts.select("column_name", "positive_count", numbers.percent(F.col("positive_rate")).alias("positive_pct"))


def parse_failures(df: DataFrame, columns: Sequence[str], fmt: str = dates.TEXT_TIMESTAMP) -> DataFrame:
    """Values per text column that give no timestamp; null sources count too."""
    return per_column(df, columns, {"unparsed": lambda c: numbers.count_if(dates.parse_timestamp(c, fmt).isNull())})


def day_consistency(df: DataFrame, floor_days: str, stated_days: str) -> DataFrame:
    """Rows whose floor days differ from the stated days, and rows without computable days."""
    same = numbers.flag(F.col(floor_days) == F.col(stated_days))
    return df.agg(numbers.count_if(~same).alias("mismatches"), numbers.count_if(F.col(floor_days).isNull()).alias("missing_delta"))


def stated_days_at(df: DataFrame, exact_days: str, stated_days: str, at: float = 0.5) -> DataFrame:
    """Distribution of the stated days where the exact delta equals ``at`` days."""
    hit = df.filter((F.col(exact_days) == F.lit(at)) & F.col(stated_days).isNotNull())
    return hit.groupBy(stated_days).agg(F.count(F.lit(1)).alias("n")).orderBy(stated_days)


def coverage(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of rows with a value, per feature."""
    return per_column(df, features, {"coverage": lambda c: F.avg(c.isNotNull().cast("double"))})


def feature_audit(df: DataFrame, requested: Sequence[str], leakage: Sequence[str]) -> DataFrame:
    """Presence, coverage, distinct values, kind and leakage verdict of requested features."""
    present = [c for c in dict.fromkeys(requested) if c in df.columns]
    numeric = set(numeric_columns(df))
    ask = df.sparkSession.createDataFrame(
        [(c, c in df.columns, "numeric" if c in numeric else "text" if c in df.columns else None, c in leakage) for c in dict.fromkeys(requested)],
        "column_name string, present boolean, kind string, leakage boolean",
    )
    stats = coverage(df, present).join(cardinality(df, present).select("column_name", "n_distinct"), "column_name")
    status = (
        F.when(F.col("leakage"), "excluded: leakage")
        .when(~F.col("present"), "missing")
        .when(F.col("coverage") == 0, "empty")
        .when(F.col("coverage") < 1, "partial")
        .otherwise("available")
    )
    return ask.join(stats, "column_name", "left").withColumn("status", status)


def refuse_leakage(features: Sequence[str], leakage: Sequence[str]) -> list[str]:
    """The features unchanged, or an error naming those that would leak the target."""
    bad = [f for f in features if f in set(leakage)]
    if bad:
        raise ValueError(f"features leak the target: {bad}")
    return list(features)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def kpi_row(df: DataFrame, sales: str, distinct: dict[str, str]) -> DataFrame:
    """Rows, total sales and distinct counts.

    Distinct counts go through (column, value) pairs, not through several ``countDistinct``.
    """
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(sales).alias("total_sales"))
    pairs = value_counts(df, list(distinct.values())).filter(F.col("value").isNotNull())
    wide = pairs.agg(*[numbers.count_if(F.col("column_name") == c).alias(out) for out, c in distinct.items()])
    return wide.select(totals.select("n_rows").scalar().alias("n_rows"), totals.select("total_sales").scalar().alias("total_sales"), *distinct)


def hour_matches(ts: Column, claimed: Column) -> Column:
    return numbers.flag(F.hour(ts) == claimed)
