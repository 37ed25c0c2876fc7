"""Temporal splits and expanding folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.operators.order_stats import rank_cut


def share_split(df: DataFrame, order: Sequence[str], train_share: float = 0.8) -> DataFrame:
    """Add ``split``: the first ``int(n * train_share)`` rows in time order train, the others test.

    ``order`` starts with the time column and goes on with a key that makes it total. The
    cut row is searched exactly; labelling is then a comparison, with no sort and no shuffle.
    """
    train_rows = int(df.count() * train_share)
    if train_rows == 0:
        return df.withColumn("split", F.lit("test"))
    first_side = rank_cut(df, order, train_rows).at_or_before()
    return df.withColumn("split", F.when(first_side, "train").otherwise("test"))


def date_split(df: DataFrame, ts: str, test_start: Column) -> DataFrame:
    return df.withColumn("split", F.when(F.col(ts) < test_start, "train").otherwise("test"))


def month_folds(df: DataFrame, month: str, initial: int = 12, step: int = 1) -> list[dict]:
    """Expanding folds over the months that occur: train on all before, test the next ``step``.

    Only the list of months (one row per calendar month) reaches the driver.
    """
    months = [r[0] for r in df.select(month).filter(F.col(month).isNotNull()).distinct().orderBy(month).collect()]
    if len(months) <= initial:
        raise ValueError(f"need more than {initial} months, got {len(months)}")
    folds = []
    for number, start in enumerate(range(initial, len(months), step), start=1):
        test = months[start : start + step]
        folds.append(
            {"fold": number, "train_start": months[0], "train_end": months[start - 1], "test_start": test[0], "test_end": test[-1]}
        )
    return folds
