"""Raw exports to typed tables with derived times and problem flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.functions import dates, labels, numbers
from leadline.operators.profile import hour_matches

# Codes of the order-line export.
PAYMENT_PROBLEMS = ["PENDING_PAYMENT", "PAYMENT_REVIEW"]
PROBLEM_FLAGS = [
    "is_late_delivery", "is_shipping_canceled", "is_order_canceled", "is_suspected_fraud", "is_payment_problem",
]
ACCESS_FORMATS = ["M/d/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


def categories_of(df: DataFrame, column: str) -> list[str]:
    """Sorted values of a column that becomes one-hot columns, so it must have few."""
    return [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def add_payment_flags(df: DataFrame, column: str, categories: Sequence[str] | None = None, prefix: str = "payment_type") -> DataFrame:
    values = categories if categories is not None else categories_of(df, column)
    return df.withColumns(labels.one_hot(F.col(column), values, prefix))


def add_shipping_times(df: DataFrame, order_text: str, shipping_text: str, stated_days: str) -> DataFrame:
    """Parsed order and shipping times, their distance in hours and days, and calendar parts."""
    df = df.withColumns(
        {
            "order_datetime": dates.parse_timestamp(order_text),
            "shipping_datetime": dates.parse_timestamp(shipping_text),
        }
    )
    df = df.withColumn("shipping_hours_from_dates", dates.hours_between("shipping_datetime", "order_datetime"))
    df = df.withColumns(
        {
            "shipping_days_from_dates_exact": dates.exact_days("shipping_hours_from_dates"),
            "shipping_days_from_dates_floor": dates.floor_days("shipping_hours_from_dates"),
        }
    )
    parts = {}
    for what in ("order", "shipping"):
        ts = f"{what}_datetime"
        parts |= {
            f"{what}_year": F.year(ts),
            f"{what}_month": F.month(ts),
            f"{what}_dayofweek": dates.weekday(ts),
            f"{what}_hour": F.hour(ts),
        }
    return df.withColumns(
        parts
        | {"shipping_days_floor_matches_original": numbers.flag(F.col("shipping_days_from_dates_floor") == F.col(stated_days))}
    )


def add_problem_flags(df: DataFrame, late_risk: str, delivery_status: str, order_status: str) -> DataFrame:
    status = F.col(order_status)
    df = df.withColumns(
        {
            "is_late_delivery": numbers.flag(F.col(late_risk) == 1),
            "is_shipping_canceled": numbers.flag(F.col(delivery_status) == "Shipping canceled"),
            "is_order_canceled": numbers.flag(status == "CANCELED"),
            "is_suspected_fraud": numbers.flag(status == "SUSPECTED_FRAUD"),
            "is_payment_problem": numbers.flag(status.isin(PAYMENT_PROBLEMS)),
        }
    )
    return df.withColumn("is_order_problem", numbers.any_of(*[F.col(f) for f in PROBLEM_FLAGS]))


def clean_order_lines(raw: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """The raw order-line export with every derived column."""
    df = add_payment_flags(raw, "Type", categories)
    df = add_shipping_times(
        df, "order date (DateOrders)", "shipping date (DateOrders)", "Days for shipping (real)"
    )
    return add_problem_flags(df, "Late_delivery_risk", "Delivery Status", "Order Status")


def clean_access_log(raw: DataFrame, text: str = "Date", hour: str = "Hour") -> DataFrame:
    """The raw access log with parsed time, its parts, and whether the stated hour agrees."""
    df = raw.withColumn("access_datetime", dates.parse_timestamp_any(text, ACCESS_FORMATS))
    ts = F.col("access_datetime")
    return df.withColumns(
        {
            "access_year": F.year(ts),
            "access_month_number": F.month(ts),
            "access_dayofweek": dates.weekday(ts),
            "access_hour_from_datetime": F.hour(ts),
            "hour_matches_datetime": hour_matches(ts, F.col(hour)),
        }
    )
