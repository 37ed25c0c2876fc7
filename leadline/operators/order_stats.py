"""Exact order statistics without a global sort.

A rank cut is the row that ends at a given rank of a total order. Banding, temporal
splits and percentiles need only a few cuts, so nothing is sorted or numbered as a whole:
histogram passes (partial aggregation, a few thousand rows of shuffle) narrow each cut to
a small slice, and only that slice is ordered. A value shared by a third of all rows is
no problem: the search goes on with the next column of the order inside that value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.session import stage

HISTOGRAM_BUCKETS = 4096
SLICE_ROWS = 200_000
# Distinct values of a group that one task may merge; every map task sends so many at most.
DISTINCT_LIMIT = 20_000


@dataclass(frozen=True)
class RankCut:
    """Rows whose key, cut to ``len(values)`` columns, is at or before ``values``."""

    columns: tuple[str, ...]
    values: tuple[Any, ...]

    def at_or_before(self) -> Column:
        out = F.lit(True)
        for name, value in reversed(list(zip(self.columns, self.values))):
            c, v = F.col(name), F.lit(value)
            out = (c < v) | ((c == v) & out)
        return out


def _position(c: Column, kind: T.DataType) -> Column:
    """A number that keeps the order of the column."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, T.NumericType):
        return c
    raise TypeError(f"cannot rank by {kind.simpleString()}")


def _bucket(position: Column, lo: Column, hi: Column, buckets: int) -> Column:
    width = (hi - lo).cast("double")
    step = F.floor((position - lo).cast("double") / width * F.lit(float(buckets)))
    return F.when(width > 0, F.least(step, F.lit(buckets - 1))).otherwise(0).cast("long")


def _narrow(df: DataFrame, name: str, rank: int, buckets: int, slice_rows: int):
    """Slice of ``df`` by one column that holds the rank: (slice, rank in it, its size, value or None)."""
    kind = df.schema[name].dataType
    low, high = df.agg(F.min(name), F.max(name)).first()
    while True:
        inside = df.filter(F.col(name).between(F.lit(low), F.lit(high)))
        pos = _position(F.col(name), kind)
        edge = [_position(F.lit(v), kind) for v in (low, high)]
        histogram = (
            inside.groupBy(_bucket(pos, edge[0], edge[1], buckets).alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
            .collect()
        )
        for row in sorted(histogram, key=lambda r: r["b"]):
            if rank <= row["n"]:
                break
            rank -= row["n"]
        size, low, high = row["n"], row["low"], row["high"]
        inside = df.filter(F.col(name).between(F.lit(low), F.lit(high)))
        if low == high:
            return inside, rank, size, low
        if size <= slice_rows:
            return inside, rank, size, None


def rank_cut(
    df: DataFrame,
    order: Sequence[str],
    rank: int,
    buckets: int = HISTOGRAM_BUCKETS,
    slice_rows: int = SLICE_ROWS,
) -> RankCut:
    """The cut that ends at ``rank`` (1-based) of the rows sorted by ``order``.

    Order columns are numbers, dates or timestamps without nulls. If rows tie on all of
    them across the cut, all tied rows fall on its first side.
    """
    order = list(order)
    fixed: list[Any] = []
    part = df.select(*order)
    for depth, name in enumerate(order):
        part, rank, size, value = _narrow(part, name, rank, buckets, slice_rows)
        if value is not None:
            fixed.append(value)
            if rank == size:
                return RankCut(tuple(order[: depth + 1]), tuple(fixed))
            if size > slice_rows:
                continue
        row = part.orderBy(*order).offset(rank - 1).limit(1).first()
        return RankCut(tuple(order), tuple(row))
    return RankCut(tuple(order), tuple(fixed))


def rank_cuts(
    df: DataFrame,
    order: Sequence[str],
    ranks: Sequence[int],
    buckets: int = HISTOGRAM_BUCKETS,
    slice_rows: int = SLICE_ROWS,
) -> list[RankCut]:
    """Several cuts at once: one shared histogram, then one ordering of the few small slices.

    A cut whose slice stays large goes on alone with ``rank_cut`` inside that slice.
    """
    order = list(order)
    name, keys = order[0], df.select(*order)
    kind = keys.schema[name].dataType
    low, high = keys.agg(F.min(name), F.max(name)).first()
    edges = [_position(F.lit(v), kind) for v in (low, high)]
    cells = (
        keys.groupBy(_bucket(_position(F.col(name), kind), edges[0], edges[1], buckets).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
        .collect()
    )
    cells.sort(key=lambda r: r["b"])
    cuts: dict[int, RankCut] = {}
    slices: dict[int, tuple] = {}
    for rank in ranks:
        left = rank
        for cell in cells:
            if left <= cell["n"]:
                break
            left -= cell["n"]
        if cell["low"] == cell["high"] and left == cell["n"]:
            cuts[rank] = RankCut((name,), (cell["low"],))
        elif cell["n"] <= slice_rows:
            slices[rank] = (cell["b"], left, cell["low"], cell["high"])
        else:
            inside = keys.filter(F.col(name).between(F.lit(cell["low"]), F.lit(cell["high"])))
            cuts[rank] = rank_cut(inside, order, left, buckets, slice_rows)
    if slices:
        which = None
        for b, _, lo, hi in {s[0]: s for s in slices.values()}.values():
            hit = F.col(name).between(F.lit(lo), F.lit(hi))
            which = F.when(hit, b) if which is None else which.when(hit, b)
        position = F.row_number().over(W.partitionBy("_slice").orderBy(*order))
        numbered = keys.withColumn("_slice", which).filter(F.col("_slice").isNotNull()).withColumn("_position", position)
        found = {
            (r["_slice"], r["_position"]): tuple(r[c] for c in order)
            for r in numbered.filter(
                F.struct("_slice", "_position").isin([F.struct(F.lit(b), F.lit(at)) for b, at, _, _ in slices.values()])
            ).collect()
        }
        for rank, (b, at, _, _) in slices.items():
            cuts[rank] = RankCut(tuple(order), found[(b, at)])
    return [cuts[rank] for rank in ranks]


def rank_bands(
    df: DataFrame,
    order: Sequence[str],
    labels: Sequence[str],
    name: str,
    buckets: int = HISTOGRAM_BUCKETS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add the quantile band of each row by first-come rank; null first key gives null.

    With ranks 1..n, band i of q ends at rank ``floor(1 + i * (n - 1) / q)``. The bands are
    comparisons with q - 1 cut rows, so adding them moves no data. The search reads ``df``
    four times; stage it first if it is costly.
    """
    present = df.filter(F.col(order[0]).isNotNull())
    n, q = present.count(), len(labels)
    if n == 0:
        return df.withColumn(name, F.lit(None).cast("string"))
    ends = [1 + i * (n - 1) // q for i in range(1, q)]
    band = F.when(F.col(order[0]).isNull(), F.lit(None).cast("string"))
    for label, cut in zip(labels, rank_cuts(present, order, ends, buckets, slice_rows)):
        band = band.when(cut.at_or_before(), label)
    return df.withColumn(name, band.otherwise(labels[-1]))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    distinct_limit: int = DISTINCT_LIMIT,
    buckets: int = HISTOGRAM_BUCKETS,
    staged: bool = False,
) -> DataFrame:
    """Interpolated quantiles of ``value`` per key, one column per entry of ``probs``.

    The built-in ``percentile`` keeps one counter per distinct value of a group in one
    task, so it serves the groups whose distinct count (sketched first) is within
    ``distinct_limit``. The others, at most rows / limit many, are searched by histograms.
    With ``staged`` ``df`` is cheap to read again, and the search makes no copy of it.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    seen = Observation()
    crowded = data.groupBy(*keys).agg(F.approx_count_distinct("_v").alias("_d")).filter(F.col("_d") > distinct_limit)
    hot = stage(crowded.drop("_d").withColumn("_hot", F.lit(True)).observe(seen, F.count(F.lit(1)).alias("n")))
    direct = [F.percentile("_v", F.lit(p)).alias(name) for name, p in probs.items()]
    if not seen.get.get("n"):
        return data.groupBy(*keys).agg(*direct)
    if not keys:
        return _search_quantiles(data if staged else stage(data), keys, probs, buckets)
    on = reduce(lambda a, b: a & b, [data[k].eqNullSafe(hot[k]) for k in keys])
    cold_part = data.join(hot, on, "left_anti").groupBy(*keys).agg(*direct)
    crowded_rows = data.join(hot, on, "left_semi")
    return cold_part.unionByName(_search_quantiles(crowded_rows if staged else stage(crowded_rows), keys, probs, buckets))


def _search_quantiles(data: DataFrame, keys: list[str], probs: dict[str, float], buckets: int) -> DataFrame:
    """Histogram search for groups with very many distinct values.

    A search is a row (keys, rank, what is left of the rank, value range); a pass counts the buckets of
    every open range, once for all searches in it, and each search goes on in the bucket that holds its rank. Searches
    stay in tables from pass to pass, so neither their number nor that of the groups is bounded by the driver, and
    Spark joins them to the values by their size. A window holds the buckets of one range.
    """
    at = {name: F.lit(p) * (F.col("_n") - 1) for name, p in probs.items()}
    below = {name: F.floor(place).cast("long") for name, place in at.items()}
    above = {name: F.least(rank + 1, F.col("_n") - 1) for name, rank in below.items()}
    ranges = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    ranks = F.explode(F.array_distinct(F.array(*below.values(), *above.values())))
    searches = stage(ranges.withColumn("_rank", ranks).select(*keys, "_n", "_rank", F.col("_rank").alias("_left"), "_low", "_high"))
    is_open = F.col("_low") < F.col("_high")
    span = [*keys, "_low", "_high"]
    by = W.partitionBy(*span).orderBy("_b")
    while True:
        ranges = searches.filter(is_open).select(*span).distinct()
        on = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
        on.append(F.col("d._v").between(F.col("s._low"), F.col("s._high")))
        held = (
            data.alias("d")
            .join(ranges.alias("s"), reduce(lambda a, b: a & b, on))
            .groupBy(
                *[F.col(f"s.{c}").alias(c) for c in span],
                _bucket(F.col("_v"), F.col("_low"), F.col("_high"), buckets).alias("_b"),
            )
            .agg(F.count(F.lit(1)).alias("_held"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
            .withColumn("_before", F.sum("_held").over(by) - F.col("_held"))
        )
        same = [F.col(f"h.{c}").eqNullSafe(F.col(f"s.{c}")) for c in span]
        same += [F.col("_before") <= F.col("_left"), F.col("_left") < F.col("_before") + F.col("_held")]
        cells = (
            held.alias("h")
            .join(searches.filter(is_open).alias("s"), reduce(lambda a, b: a & b, same))
            .select(
                *[F.col(f"s.{k}").alias(k) for k in keys],
                "_n",
                "_rank",
                (F.col("_left") - F.col("_before")).alias("_left"),
                F.col("_from").alias("_low"),
                F.col("_to").alias("_high"),
            )
        )
        seen = Observation()
        narrowed = cells.unionByName(searches.filter(~is_open))
        searches = stage(narrowed.observe(seen, F.count(F.when(is_open, 1)).alias("open")))
        if not seen.get.get("open"):
            break
    values = searches.groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_low"))).alias("_at"))
    found = F.col("_at")
    return values.select(
        *keys,
        *[
            (found[below[name]] + (found[above[name]] - found[below[name]]) * (at[name] - below[name])).alias(name)
            for name in probs
        ],
    )
