"""Join idioms of the reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join where null keys match null keys; key columns of the left side are kept."""
    l, r = left.alias("l"), right.alias("r")
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l.join(r, on, "left").select("l.*", *extra)


def lookup_mean(rows: DataFrame, train: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Mean of ``value`` in the training rows of the same key; unseen keys get the global mean."""
    means = train.groupBy(key).agg(F.avg(value).alias("_mean"))
    overall = train.agg(F.avg(value)).scalar()
    return rows.join(means, key, "left").withColumn(name, F.coalesce("_mean", overall)).drop("_mean")


def full_outer_filled(left: DataFrame, right: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """Full outer join of two aggregates; missing measures are 0."""
    return left.join(right, key, "full_outer").na.fill(0, subset=list(measures))


def keep_top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the n keys with most rows (key order on ties)."""
    busiest = (
        df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), key).limit(n).select(key)
    )
    return df.join(busiest, key, "left_semi")


def calendar_per_key(keys: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """Every key with every day from first to last; the days are generated inside each row."""
    days = F.sequence(first, last, F.expr("interval 1 day"))
    return keys.select("*", F.explode(days).alias(name))
