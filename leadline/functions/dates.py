"""Calendar expressions (Monday = 0, ISO weeks, English names)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text timestamp format and calendar names of the order-line data.
TEXT_TIMESTAMP = "M/d/yyyy H:mm"
FIXED_HOLIDAYS = ["01-01", "05-01", "12-25"]
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(c: Column | str, fmt: str = TEXT_TIMESTAMP) -> Column:
    """Text to timestamp; text that does not fit the format gives null."""
    return F.try_to_timestamp(_col(c), F.lit(fmt))


def parse_timestamp_any(c: Column | str, formats: Sequence[str]) -> Column:
    """First format that fits, in the given order."""
    return F.coalesce(*[parse_timestamp(c, fmt) for fmt in formats])


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch, for range frames and differences."""
    return F.unix_micros(_col(c).cast("timestamp"))


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole hours from earlier to later, half-even rounding."""
    return F.bround((micros(later) - micros(earlier)) / F.lit(3.6e9), 0).cast("long")


def exact_days(hours: Column | str) -> Column:
    return F.bround(_col(hours) / F.lit(24.0), 3)


def floor_days(hours: Column | str) -> Column:
    return F.floor(_col(hours) / F.lit(24.0)).cast("long")


def month_label(c: Column | str) -> Column:
    """``yyyy-MM``; sorts in time order."""
    return F.date_format(_col(c), "yyyy-MM")


def weekday(c: Column | str) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(_col(c))


def is_weekend(c: Column | str) -> Column:
    return F.weekday(_col(c)) >= 5


def iso_week(c: Column | str) -> Column:
    return F.weekofyear(_col(c))


def month_name(c: Column | str) -> Column:
    return F.date_format(_col(c), "MMMM")


def day_name(c: Column | str) -> Column:
    return F.date_format(_col(c), "EEEE")


def quarter_label(c: Column | str) -> Column:
    return F.concat(F.lit("Q"), F.quarter(_col(c)).cast("string"))


def cyclic_sin(part: Column, period: int) -> Column:
    return F.sin(F.lit(2 * math.pi) * part / F.lit(float(period)))


def cyclic_cos(part: Column, period: int) -> Column:
    return F.cos(F.lit(2 * math.pi) * part / F.lit(float(period)))


def is_fixed_holiday(c: Column | str) -> Column:
    return F.date_format(_col(c), "MM-dd").isin(FIXED_HOLIDAYS)


def calendar_period(c: Column | str) -> Column:
    """Commercial period of a date; the first rule that holds wins."""
    c = _col(c)
    month, day = F.month(c), F.dayofmonth(c)
    return (
        F.when(is_fixed_holiday(c), "Generic fixed holiday")
        .when((month == 9) & day.between(1, 15), "Back to school period")
        .when((month == 11) & day.between(20, 30), "Black Friday period")
        .when(month == 12, "Christmas season")
        .otherwise("Normal")
    )


def calendar_columns(c: Column | str, hour: bool = True) -> dict[str, Column]:
    """The calendar features of an order time, ready for ``withColumns``."""
    c = _col(c)
    parts = {
        "order_year": F.year(c),
        "order_month": F.month(c),
        "order_day": F.dayofmonth(c),
        "order_dayofweek": weekday(c),
        "order_dayofyear": F.dayofyear(c),
        "order_weekofyear": iso_week(c),
        "order_quarter": F.quarter(c),
        "order_is_weekend": is_weekend(c).cast("int"),
        "order_month_sin": cyclic_sin(F.month(c), 12),
        "order_month_cos": cyclic_cos(F.month(c), 12),
        "order_dayofweek_sin": cyclic_sin(weekday(c), 7),
        "order_dayofweek_cos": cyclic_cos(weekday(c), 7),
    }
    if hour:
        parts["order_hour"] = F.hour(c)
    return parts


def days_since(c: Column | str, first: Column | str) -> Column:
    """Days from ``first`` to ``c``, never below zero."""
    return F.greatest(F.datediff(_col(c), _col(first)), F.lit(0))
