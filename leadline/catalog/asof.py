"""Queries that look another table up as of a row's time."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadline.catalog.registry import query, rounded, with_lines
from leadline.operators.asof import asof_join, lookback_totals
from leadline.sources.tables import LINE_KEY, order_lines, read_table

HOURS = 6
BACK = {"day": 86_400, "week": 7 * 86_400}


@query(
    "events_last_click",
    "WITH c AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click'),"
    " e AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'click')"
    f" SELECT e.event_id, e.user_id, CASE WHEN e.ts - c.ts <= INTERVAL {HOURS} HOUR THEN c.event_id END AS click_event_id,"
    f" CASE WHEN e.ts - c.ts <= INTERVAL {HOURS} HOUR THEN c.value END AS click_value"
    " FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts > c.ts",
)
def events_last_click(spark, folder):
    """Every other event with its user's last click before it, if that is at most six hours old."""
    events = read_table(spark, folder, "events").select("event_id", "user_id", "ts", "value", "event_type")
    clicks = events.filter(F.col("event_type") == "click")
    others = events.filter(F.col("event_type") != "click").select("event_id", "user_id", "ts")
    out = asof_join(
        others, clicks, ["user_id"], "ts", "ts", ["event_id", "value"], ["event_id"], tolerance_seconds=HOURS * 3600, prefix="click_"
    )
    return out.drop("ts")


_TIE_DESC = ", ".join(f"{c} DESC" for c in LINE_KEY)


@query(
    "orders_last_delivery",
    with_lines(
        ", d AS (SELECT customer_id, shipping_ts, order_id, actual_days FROM lines"
        f" QUALIFY row_number() OVER (PARTITION BY customer_id, shipping_ts ORDER BY {_TIE_DESC}) = 1)"
        " SELECT o_orderkey AS order_id, o_custkey AS customer_id, d.order_id AS last_order_id, d.actual_days AS last_actual_days,"
        " d.shipping_ts AS last_shipping_ts FROM orders ASOF LEFT JOIN d ON o_custkey = d.customer_id AND o_orderdate > d.shipping_ts"
    ),
)
def orders_last_delivery(spark, folder):
    """Every order with its customer's last line that was delivered strictly before it."""
    lines = order_lines(spark, folder, ["customer_id", "shipping_ts", "actual_days", *LINE_KEY])
    orders = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_ts")
    )
    out = asof_join(orders, lines, ["customer_id"], "order_ts", "shipping_ts", ["order_id", "actual_days", "shipping_ts"], LINE_KEY)
    return out.drop("order_ts")


@query(
    "orders_shipped_same_day",
    with_lines(
        ", d AS (SELECT customer_id, shipping_ts, order_id, line_no FROM lines"
        f" QUALIFY row_number() OVER (PARTITION BY customer_id, shipping_ts ORDER BY {_TIE_DESC}) = 1)"
        f" SELECT l.order_id, l.line_no, d.order_id AS seen_order_id, d.line_no AS seen_line_no"
        " FROM lines l ASOF LEFT JOIN d ON l.customer_id = d.customer_id AND l.order_ts >= d.shipping_ts"
    ),
)
def orders_shipped_same_day(spark, folder):
    """The same for lines, with deliveries of the very instant of the order counted as known."""
    lines = order_lines(spark, folder, ["customer_id", "order_ts", "shipping_ts", *LINE_KEY])
    left = lines.select("order_id", "line_no", "customer_id", "order_ts")
    out = asof_join(left, lines, ["customer_id"], "order_ts", "shipping_ts", ["order_id", "line_no"], LINE_KEY, strict=False, prefix="seen_")
    return out.drop("order_ts", "customer_id")


@query(
    "events_lookback",
    "SELECT e.event_id, "
    + ", ".join(
        f"count(b.value) FILTER (b.ts >= e.ts - INTERVAL {s} SECOND) AS {n}_count,"
        f" round(sum(b.value) FILTER (b.ts >= e.ts - INTERVAL {s} SECOND), 4) AS {n}_sum"
        for n, s in BACK.items()
    )
    + " FROM events e LEFT JOIN events b ON e.user_id = b.user_id AND b.ts < e.ts"
    f" AND b.ts >= e.ts - INTERVAL {max(BACK.values())} SECOND GROUP BY e.event_id",
)
def events_lookback(spark, folder):
    """Events of the same user in the day and the week before each event, counted and summed."""
    events = read_table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    out = lookback_totals(events, events, ["user_id"], "ts", "ts", "value", BACK)
    return rounded(out.select("event_id", *[f"{n}_{c}" for n in BACK for c in ("count", "sum")]), 4)
