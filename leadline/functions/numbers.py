"""Arithmetic with the rounding and zero rules the reports need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(num: Column, den: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(den > 0, num / den)


def percent(rate: Column, digits: int = 2) -> Column:
    return F.bround(rate * F.lit(100.0), digits)


def to_number(c: Column | str) -> Column:
    """Double, or null where the text is no number."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def clip_low(c: Column, low: float = 0.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def finite_or_null(c: Column) -> Column:
    """Null for NaN and both infinities."""
    bad = F.isnan(c) | (c == F.lit(float("inf"))) | (c == F.lit(float("-inf")))
    return F.when(~bad, c)


def flag(condition: Column) -> Column:
    """A predicate that is false, not null, when its input is null."""
    return F.coalesce(condition, F.lit(False))


def any_of(*flags: Column) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | flag(f)
    return out


def rate(condition: Column) -> Column:
    """Share of true among non-null values (an aggregate)."""
    return F.avg(condition.cast("double"))


def count_if(condition: Column) -> Column:
    """Number of rows where the condition holds (an aggregate, 0 on no rows)."""
    return F.count(F.when(condition, 1))
