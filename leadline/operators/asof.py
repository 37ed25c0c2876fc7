"""As-of joins and look-back totals: what another table knew at a row's time.

Both sides are laid on one time line per key and cut into chunks of time. Inside a (key, chunk) a window carries
the last row, or adds up; across chunks a table with one row per (key, chunk) does the same. So there is no join over
time ranges, every row is moved once, and a key with very many rows is spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadline.functions.dates import micros
from leadline.session import stage

# Rows of the busiest key in a chunk, about; it sets the work of a task and never changes a result.
CHUNK_ROWS = 100_000
SECOND_US = 1_000_000


def _chunk(line: DataFrame, keys: Sequence[str], rows: int) -> Column:
    """Number of the time chunk of ``_at``, evenly cut so that the busiest key has about ``rows`` rows in each."""
    per_key = line.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("_at") - F.min("_at")).alias("span"))
    busiest = per_key.agg(F.max(F.struct("n", "span")).alias("b")).first()["b"]
    if busiest is None or busiest["n"] <= rows or not busiest["span"]:
        return F.lit(0).cast("long")
    return F.floor(F.col("_at") / F.lit(max(busiest["span"] * rows // busiest["n"], 1))).cast("long")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
    strict: bool = True,
    tolerance_seconds: float | None = None,
    prefix: str = "last_",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``left`` with ``columns`` of the last ``right`` row of the same keys before the row's time, named with ``prefix``.

    ``strict`` leaves out right rows of the same instant. Of several right rows of one instant, the last by
    ``tie`` counts. With a tolerance, an older row than that is none (a row exactly as old still counts). Rows of
    ``left`` without a time, a key or a match keep their place with nulls; right rows without a time or a key are never met.
    The columns may be null themselves: the last row counts, not the last value.
    """
    keys = list(keys)

    def known(ts: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, ts)])

    # At one instant, right rows come after left ones if strict, else before them.
    side = {"left": 0, "right": 1} if strict else {"left": 1, "right": 0}
    payload = F.struct(micros(right_ts).alias("_seen"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    order = F.struct(*[F.col(c) for c in tie]) if tie else F.struct(F.lit(0).alias("none"))
    seen = right.filter(known(right_ts)).select(
        *keys, micros(right_ts).alias("_at"), F.lit(side["right"]).alias("_side"), order.alias("_tie"), payload.alias("_right")
    )
    met = left.filter(known(left_ts))
    asked = met.select(*keys, micros(left_ts).alias("_at"), F.lit(side["left"]).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    line = stage(asked.unionByName(seen, allowMissingColumns=True))
    line = line.withColumn("_chunk", _chunk(line, keys, chunk_rows))

    latest = F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_at", "_tie")))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        line.groupBy(*keys, "_chunk").agg(latest.alias("_latest"))
        .select(*keys, "_chunk", F.last("_latest", ignorenulls=True).over(earlier).alias("_carried"))
    )
    so_far = W.partitionBy(*keys, "_chunk").orderBy("_at", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    found = (
        line.withColumn("_found", F.last("_right", ignorenulls=True).over(so_far))
        .filter(F.col("_left").isNotNull())
        .join(carried, [*keys, "_chunk"])
        .withColumn("_found", F.coalesce("_found", "_carried"))
    )
    if tolerance_seconds is not None:
        young = F.col("_at") - F.col("_found._seen") <= F.lit(int(tolerance_seconds * SECOND_US))
        found = found.withColumn("_found", F.when(young, F.col("_found")))
    out = found.select("_left.*", *[F.col(f"_found.{prefix}{c}") for c in columns])
    return out.unionByName(left.filter(~known(left_ts)), allowMissingColumns=True)


def lookback_totals(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    value: str,
    seconds: dict[str, float],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``left`` with, per name and D of ``seconds``, ``<name>_count`` and ``<name>_sum`` of the right rows in [t - D, t).

    Each is a difference of two running totals. The count is of rows with a value; without any, the sum is null.
    Rows of ``left`` without a key or time get nulls.
    """
    keys = list(keys)
    names = list(seconds)
    back = {"now": 0, **{n: int(seconds[n] * SECOND_US) for n in names}}
    seen = right.filter(F.col(value).isNotNull()).select(
        *keys, micros(right_ts).alias("_at"), F.lit(1).cast("long").alias("_n"), F.col(value).cast("double").alias("_v")
    ).na.drop()
    instants = left.select(*keys, micros(left_ts).alias("_asked")).na.drop().distinct()
    points = instants.select(
        *keys, "_asked", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).cast("long").alias("by")) for n, b in back.items()])).alias("_point")
    ).select(*keys, "_asked", F.col("_point.name").alias("_name"), (F.col("_asked") - F.col("_point.by")).alias("_at"))
    line = stage(seen.unionByName(points, allowMissingColumns=True).na.fill(0, ["_n", "_v"]))
    line = line.withColumn("_chunk", _chunk(line, keys, chunk_rows))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = line.groupBy(*keys, "_chunk").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v")).select(
        *keys, "_chunk", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_base") for c in ("_n", "_v")]
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    running = (
        line.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_in") for c in ("_n", "_v")])
        .filter(F.col("_name").isNotNull())
        .join(bases, [*keys, "_chunk"])
    )
    total = lambda c, name: F.max(F.when(F.col("_name") == name, F.col(f"{c}_in") + F.col(f"{c}_base")))
    counts = {n: total("_n", "now") - total("_n", n) for n in names}
    wide = running.groupBy(*keys, "_asked").agg(
        *[counts[n].alias(f"{n}_count") for n in names],
        *[F.when(counts[n] > 0, total("_v", "now") - total("_v", n)).alias(f"{n}_sum") for n in names],
    )
    at = micros(left_ts)
    keyed = left.withColumn("_asked", at).join(wide, [*keys, "_asked"], "left")
    cells = [F.col(f"{n}_{c}") for n in names for c in ("count", "sum")]
    return keyed.select(*[F.col(f"`{c}`") for c in left.columns], *cells)
