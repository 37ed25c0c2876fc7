"""Queries over the cleaned order lines and access log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadline.catalog.registry import query, rounded, with_lines
from leadline.operators import profile as p
from leadline.plans import cleaning
from leadline.session import staging_dir
from leadline.sources import csv, sinks
from leadline.sources.tables import order_lines, read_table, web_events

FLAGS = [*cleaning.PROBLEM_FLAGS, "is_order_problem"]

# The raw export said in SQL: texts for times, half a day more on odd lines, some unreadable.
_RAW = """, raw AS (
  SELECT *, CASE WHEN tax = 0.08 THEN NULL ELSE order_ts END AS o,
    order_ts + to_days(actual_days) + to_hours(CAST(12 * (line_no % 2) AS INTEGER)) AS s FROM lines
), cleaned AS (
  SELECT *, CAST(date_diff('minute', o, s) / 60 AS BIGINT) AS hours FROM raw
), timed AS (
  SELECT *, round_even(hours / 24.0, 3) AS exact, CAST(floor(hours / 24.0) AS BIGINT) AS whole FROM cleaned
)"""

_FLAG_SQL = {
    "is_late_delivery": "official_late",
    "is_shipping_canceled": "delivery_status = 'Shipping canceled'",
    "is_order_canceled": "order_status = 'CANCELED'",
    "is_suspected_fraud": "order_status = 'SUSPECTED_FRAUD'",
    "is_payment_problem": "order_status IN ('PENDING_PAYMENT', 'PAYMENT_REVIEW')",
}
_FLAG_SQL["is_order_problem"] = " OR ".join(f"({v})" for v in list(_FLAG_SQL.values()))


def raw_export(spark, folder):
    """The order lines in the shape of the raw export: text times, text codes."""
    lines = order_lines(
        spark, folder,
        ["order_id", "line_no", "order_ts", "shipping_ts", "actual_days", "promised_days", "official_late",
         "delivery_status", "order_status", "payment_type", "tax", "sales"],
    )
    shipped = F.col("shipping_ts") + F.expr("make_dt_interval(0, 12 * (line_no % 2))")
    return lines.select(
        F.col("order_id").alias("Order Id"),
        "line_no",
        F.when(F.col("tax") == 0.08, "n/a").otherwise(F.date_format("order_ts", "M/d/yyyy H:mm")).alias("order date (DateOrders)"),
        F.date_format(shipped, "M/d/yyyy H:mm").alias("shipping date (DateOrders)"),
        F.col("actual_days").cast("long").alias("Days for shipping (real)"),
        F.col("official_late").cast("int").alias("Late_delivery_risk"),
        F.col("delivery_status").alias("Delivery Status"),
        F.col("order_status").alias("Order Status"),
        F.col("payment_type").alias("Type"),
        F.col("sales").alias("Sales"),
    )


@query(
    "clean_durations",
    with_lines(
        _RAW + " SELECT hours AS shipping_hours_from_dates, exact AS shipping_days_from_dates_exact,"
        " whole AS shipping_days_from_dates_floor, coalesce(whole = actual_days, false) AS shipping_days_floor_matches_original,"
        " count(*) AS n FROM timed GROUP BY 1, 2, 3, 4"
    ),
)
def clean_durations(spark, folder):
    cleaned = cleaning.clean_order_lines(raw_export(spark, folder), ["A", "N", "R"])
    keys = [
        "shipping_hours_from_dates", "shipping_days_from_dates_exact", "shipping_days_from_dates_floor",
        "shipping_days_floor_matches_original",
    ]
    return cleaned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "clean_calendar_parts",
    with_lines(
        _RAW + " SELECT CAST(year(o) AS INTEGER) AS order_year, CAST(month(o) AS INTEGER) AS order_month,"
        " CAST(isodow(o) - 1 AS INTEGER) AS order_dayofweek, CAST(hour(o) AS INTEGER) AS order_hour,"
        " CAST(year(s) AS INTEGER) AS shipping_year, CAST(month(s) AS INTEGER) AS shipping_month,"
        " CAST(isodow(s) - 1 AS INTEGER) AS shipping_dayofweek, CAST(hour(s) AS INTEGER) AS shipping_hour, count(*) AS n"
        " FROM timed GROUP BY ALL"
    ),
)
def clean_calendar_parts(spark, folder):
    cleaned = cleaning.clean_order_lines(raw_export(spark, folder), ["A", "N", "R"])
    keys = [f"{w}_{p}" for w in ("order", "shipping") for p in ("year", "month", "dayofweek", "hour")]
    return cleaned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "clean_problem_flags",
    with_lines(
        " SELECT " + ", ".join(f"{v} AS {k}" for k, v in _FLAG_SQL.items()) + ", count(*) AS n FROM lines GROUP BY ALL"
    ),
)
def clean_problem_flags(spark, folder):
    cleaned = cleaning.clean_order_lines(raw_export(spark, folder), ["A", "N", "R"])
    return cleaned.groupBy(*FLAGS).agg(F.count(F.lit(1)).alias("n"))


@query(
    "target_prevalence",
    with_lines(
        " UNION ALL ".join(
            f"SELECT '{k}' AS column_name, count(*) FILTER (WHERE {v}) AS positive_count,"
            f" round(count(*) FILTER (WHERE {v}) * 100.0 / count(*), 2) AS positive_pct FROM lines"
            for k, v in _FLAG_SQL.items()
        )
    ),
)
def target_prevalence(spark, folder):
    cleaned = cleaning.clean_order_lines(raw_export(spark, folder), ["A", "N", "R"])
    return rounded(p.prevalence(cleaned, FLAGS), 2)


@query(
    "timestamp_parse_failures",
    with_lines(
        "SELECT 'order date (DateOrders)' AS column_name, count(*) FILTER (WHERE tax = 0.08) AS unparsed FROM lines"
        " UNION ALL SELECT 'shipping date (DateOrders)', 0 "
    ),
)
def timestamp_parse_failures(spark, folder):
    return p.parse_failures(raw_export(spark, folder), ["order date (DateOrders)", "shipping date (DateOrders)"])


@query(
    "day_consistency",
    with_lines(
        _RAW + " SELECT count(*) FILTER (WHERE NOT coalesce(whole = actual_days, false)) AS mismatches,"
        " count(*) FILTER (WHERE whole IS NULL) AS missing_delta FROM timed"
    ),
)
def day_consistency(spark, folder):
    cleaned = cleaning.clean_order_lines(raw_export(spark, folder), ["A", "N", "R"])
    return p.day_consistency(cleaned, "shipping_days_from_dates_floor", "Days for shipping (real)")


@query(
    "stated_days_at_half_day",
    with_lines(_RAW + " SELECT CAST(actual_days AS BIGINT) AS stated_days, count(*) AS n FROM timed WHERE exact = 0.5 GROUP BY 1"),
)
def stated_days_at_half_day(spark, folder):
    cleaned = cleaning.clean_order_lines(raw_export(spark, folder), ["A", "N", "R"])
    out = p.stated_days_at(cleaned, "shipping_days_from_dates_exact", "Days for shipping (real)")
    return out.withColumnRenamed("Days for shipping (real)", "stated_days")


@query(
    "clean_access_log",
    "SELECT CAST(year(ts) AS INTEGER) AS access_year, CAST(month(ts) AS INTEGER) AS access_month_number,"
    " CAST(isodow(ts) - 1 AS INTEGER) AS access_dayofweek, CAST(hour(ts) AS INTEGER) AS access_hour_from_datetime,"
    " hour(ts) = user_id % 24 AS hour_matches_datetime, count(*) AS n FROM events GROUP BY ALL",
)
def clean_access_log(spark, folder):
    raw = web_events(spark, folder).select(
        F.date_format("access_ts", "M/d/yyyy H:mm").alias("Date"), F.col("claimed_hour").alias("Hour")
    )
    cleaned = cleaning.clean_access_log(raw)
    keys = ["access_year", "access_month_number", "access_dayofweek", "access_hour_from_datetime", "hour_matches_datetime"]
    return cleaned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "csv_round_trip",
    "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_ts FROM orders GROUP BY 1",
)
def csv_round_trip(spark, folder):
    """Orders written as CSV and scanned back with declared types."""
    path = f"{staging_dir(spark)}/csv-{uuid.uuid4().hex}"
    orders = read_table(spark, folder, "orders")
    sinks.write_table(orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), path, "csv")
    types = {"o_orderkey": "long", "o_totalprice": "double", "o_orderdate": "timestamp_ntz"}
    back = csv.read_csv(spark, path, types)
    return rounded(
        back.groupBy(F.col("o_orderstatus").alias("status")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_orderdate").alias("first_ts")
        ),
        2,
    )


@query(
    "ensured_table",
    "SELECT l_returnflag, round_even(avg(l_tax), 4) AS avg_tax, count(*) AS n FROM lineitem GROUP BY 1",
)
def ensured_table(spark, folder):
    """A summary that is written rounded on first use and read back after that."""
    path = f"{staging_dir(spark)}/ensured-{uuid.uuid4().hex}"

    def build():
        lines = read_table(spark, folder, "lineitem")
        means = lines.groupBy("l_returnflag").agg(F.avg("l_tax").alias("avg_tax"), F.count(F.lit(1)).alias("n"))
        return sinks.round_doubles(means, 4)

    sinks.ensure_table(spark, path, build)
    return sinks.ensure_table(spark, path, build)
