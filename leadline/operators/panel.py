"""Dense key-by-day panels with lags and rolling statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def densify(daily: DataFrame, keys: Sequence[str], day: str, zero: Sequence[str], blank: Sequence[str] = (),
            first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Every key gets a row for every day from ``first`` to ``last`` (default: range of the table).

    Each observed row writes the empty days up to the next one, the first row also those
    before it. That needs the key's own rows only: one shuffle of the sparse table, and the
    result is still partitioned by key for the windows that follow. ``zero`` columns are 0 on
    the new days, ``blank`` columns null.
    """
    first = first if first is not None else daily.agg(F.min(day)).scalar()
    last = last if last is not None else daily.agg(F.max(day)).scalar()
    order = W.partitionBy(*keys).orderBy(day)
    start = F.when(F.lag(day).over(order).isNull(), first).otherwise(F.col(day))
    stop = F.coalesce(F.date_sub(F.lead(day).over(order), 1), last)
    spread = daily.select(*keys, day, *zero, *blank, F.sequence(start, stop).alias("_days"))
    spread = spread.select(*keys, F.col(day).alias("_seen"), *zero, *blank, F.explode("_days").alias(day))
    own = F.col(day) == F.col("_seen")
    return spread.select(
        *keys,
        day,
        *[F.when(own, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast(dict(daily.dtypes)[c]).alias(c) for c in zero],
        *[F.when(own, F.col(c)).alias(c) for c in blank],
    )


def lag_columns(keys: Sequence[str], day: str, column: str, lags: Sequence[int], prefix: str = "") -> dict[str, Column]:
    """Value n rows (= days, on a dense panel) earlier."""
    order = W.partitionBy(*keys).orderBy(day)
    return {f"{prefix}{column}_lag_{n}d": F.lag(column, n).over(order) for n in lags}


def rolling_columns(keys: Sequence[str], day: str, column: str, windows: Sequence[int], prefix: str = "",
                    sums: bool = True) -> dict[str, Column]:
    """Mean (and sum) of the previous w days, the current day excluded; nulls are skipped."""
    order = W.partitionBy(*keys).orderBy(day)
    out = {}
    for w in windows:
        frame = order.rowsBetween(-w, -1)
        out[f"{prefix}{column}_roll_mean_{w}d"] = F.avg(column).over(frame)
        if sums:
            out[f"{prefix}{column}_roll_sum_{w}d"] = F.sum(column).over(frame)
    return out
