"""Global ranks and running totals as columns, without one window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadline.session import stage

# monotonically_increasing_id() keeps the row's place inside its partition in these low bits.
_PLACE_BITS = 33


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank", null_rank: bool = True) -> DataFrame:
    """``df`` with the 1-based place of each row along ``order``, as a long.

    Rows are dealt into key ranges, sorted inside each, and numbered there; one small table
    with a row per range turns places into ranks. Only the first step shuffles the rows. Ranges are
    cut along the whole order, so a value that many rows share is split by the columns after it:
    end ``order`` with a key of the row for a first-come rank that repeats from run to run.
    With ``null_rank`` off, rows whose first order column is null come last and get no rank.
    """
    place, part, base, most = "_place", "_part", "_base", "_most"
    by = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    numbered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(place, F.monotonically_increasing_id())
    # Staged, as a second evaluation may cut the ranges elsewhere.
    rows = stage(numbered).withColumn(part, F.shiftright(place, _PLACE_BITS))
    inside = F.col(place).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    sizes = rows.groupBy(part).agg((F.max(inside) + 1).alias(most))
    # One row per range.
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(part, F.coalesce(F.sum(most).over(before), F.lit(0)).alias(base))
    rank = F.col(base) + inside + 1
    if not null_rank:
        if not isinstance(order[0], str):
            raise ValueError("name the first order column to leave its nulls without a rank")
        rank = F.when(F.col(order[0]).isNotNull(), rank)
    return rows.join(bases, part).select(*[F.col(f"`{c}`") for c in df.columns], rank.cast("long").alias(name))


def running_start(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, name: str = "start"
) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each row of its key, along (``chunk``, ``order``).

    Two levels: a window inside (keys, chunk), and the totals of the chunks before it. So a key
    with very many rows is one task per chunk, not one task. ``df`` is read twice; stage it first if
    it is costly. Keys and chunk hold no nulls. Rows that tie on the whole order may come in either order.
    """
    keys, base = list(keys), "_chunk_base"
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias(base))
    earlier = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(*keys, chunk, F.coalesce(F.sum(base).over(earlier), F.lit(0)).alias(base))
    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return placed.join(bases, [*keys, chunk]).withColumn(name, F.col(name) + F.col(base)).drop(base)
