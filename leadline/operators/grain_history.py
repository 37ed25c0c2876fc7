"""Daily sales history of a line at several grains (everything, product, category, ...).

Lags of an exact number of days and rolling sums over calendar days are range frames over
the sparse daily totals, so no calendar is generated and no table is joined to shifted
copies of itself. A key has at most one row per day, which bounds every window partition
by the length of the calendar, however many lines the key has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadline.operators.joins import left_join_null_safe
from leadline.session import stage

# Feature rows of a grain that are broadcast, at most; about 100 bytes each.
SMALL_ROWS = 200_000


@dataclass(frozen=True)
class Grain:
    prefix: str
    keys: tuple[str, ...] = ()
    rolling: bool = True


def feature_names(grains: Sequence[Grain], lags: Sequence[int], windows: Sequence[int], measure: str = "sales") -> list[str]:
    out = []
    for g in grains:
        out += [f"{g.prefix}_{measure}_lag_{n}d" for n in lags]
        if g.rolling:
            for w in windows:
                out += [f"{g.prefix}_{measure}_roll_sum_{w}d", f"{g.prefix}_{measure}_roll_mean_{w}d"]
    return out


def daily_history(lines: DataFrame, grain: Grain, day: str, value: str, lags: Sequence[int], windows: Sequence[int],
                  measure: str = "sales", first_day: Column | None = None) -> DataFrame:
    """One row per (key, day with sales) with the grain's features.

    A missing day makes a lag null; in the rolling windows it counts as 0. The first day of
    the table has no past, so its rolling values are null.
    """
    keys = list(grain.keys)
    daily = lines.groupBy(*keys, day).agg(F.sum(value).alias("_s")).withColumn("_d", F.unix_date(day))
    per_key = W.partitionBy(*keys).orderBy("_d")
    columns = [
        F.max("_s").over(per_key.rangeBetween(-n, -n)).alias(f"{grain.prefix}_{measure}_lag_{n}d") for n in lags
    ]
    if grain.rolling:
        first_day = first_day if first_day is not None else lines.agg(F.min(day)).scalar()
        past_days = F.col("_d") - F.unix_date(first_day)
        for w in windows:
            total = F.coalesce(F.sum("_s").over(per_key.rangeBetween(-w, -1)), F.lit(0.0))
            total = F.when(past_days > 0, total)
            columns.append(total.alias(f"{grain.prefix}_{measure}_roll_sum_{w}d"))
            columns.append((total / F.least(past_days, F.lit(w))).alias(f"{grain.prefix}_{measure}_roll_mean_{w}d"))
    return daily.select(*keys, day, *columns)


def add_daily_history(lines: DataFrame, grains: Sequence[Grain], day: str, value: str, lags: Sequence[int] = (1, 7, 30, 365),
                      windows: Sequence[int] = (7, 30), measure: str = "sales") -> DataFrame:
    """Lines with the features of all grains. Null keys form a group of their own.

    The features of each grain are staged and counted. Those of at most ``SMALL_ROWS`` rows are broadcast; the lines
    are shuffled for the others only, and before the small ones make them wide.
    """
    first_day = F.lit(lines.agg(F.min(day)).first()[0]).cast("date")
    tables = []
    for grain in grains:
        seen = Observation()
        features = daily_history(lines, grain, day, value, lags, windows, measure, first_day)
        features = stage(features.observe(seen, F.count(F.lit(1)).alias("n")))
        tables.append((seen.get.get("n") or 0, grain, features))
    out = lines
    for n, grain, features in sorted(tables, key=lambda t: -t[0]):
        out = left_join_null_safe(out, F.broadcast(features) if n <= SMALL_ROWS else features, [*grain.keys, day])
    return out.select(*lines.columns, *feature_names(grains, lags, windows, measure))
