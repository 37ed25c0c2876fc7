"""Queries on promise against delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadline.catalog.registry import LINE_KEY_SQL, query, rounded, with_lines
from leadline.operators import aggregate as agg
from leadline.operators.joins import keep_top_keys
from leadline.operators.split import share_split
from leadline.plans import promise
from leadline.session import stage
from leadline.sources.tables import LINE_KEY, order_lines

DELAYS = list(range(-4, 7))
MODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CRITICAL = ["1-URGENT", "2-HIGH"]
BASE = ["order_id", "shipping_mode", "promised_days", "actual_days", "official_late"]


@query(
    "promise_recommendation",
    with_lines(
        ", s AS (SELECT shipping_mode, count(*) AS orders, avg(actual_days) AS m, quantile_cont(actual_days, 0.5) AS med,"
        " count(*) FILTER (WHERE delay > 0) AS broken, count(*) FILTER (WHERE official_late) AS late,"
        " CAST(ceil(avg(actual_days)) AS INTEGER) AS rec FROM lines GROUP BY 1),"
        " pm AS (SELECT shipping_mode, promised_days, row_number() OVER (PARTITION BY shipping_mode ORDER BY count(*) DESC, promised_days) AS r"
        " FROM lines GROUP BY 1, 2),"
        " a AS (SELECT l.shipping_mode, count(*) FILTER (WHERE actual_days > rec) AS after FROM lines l JOIN s USING (shipping_mode) GROUP BY 1)"
        " SELECT s.shipping_mode, orders, promised_days AS current_promise_days, round(m, 6) AS actual_mean_days,"
        " round(CAST(med AS DOUBLE), 6) AS actual_median_days, broken AS current_broken_promises, late AS official_late_orders,"
        " rec AS recommended_baseline_days, after AS baseline_broken_promises, broken - after AS promises_fixed,"
        " round(broken / orders, 6) AS current_broken_rate, round(after / orders, 6) AS baseline_broken_rate,"
        " round((broken / orders - after / orders) * 100, 6) AS broken_rate_drop_pp"
        " FROM s JOIN a USING (shipping_mode) JOIN pm ON pm.shipping_mode = s.shipping_mode AND pm.r = 1"
    ),
)
def promise_recommendation(spark, folder):
    return rounded(promise.recommend_promise(order_lines(spark, folder, BASE)))


_RATES = (
    "count(*) AS orders, round(avg(CAST(official_late AS DOUBLE)), 6) AS official_late_rate,"
    " round(avg(actual_days - promised_days), 6) AS mean_error_days,"
    " round(avg(CAST(official_late AS DOUBLE)) * 100, 2) AS official_late_pct"
)


@query(
    "promise_calibration",
    with_lines(
        f"SELECT shipping_mode, {_RATES}, round(avg(promised_days), 6) AS promised_days, round(avg(actual_days), 6) AS actual_days,"
        " round(avg(CAST(delay > 0 AS DOUBLE)), 6) AS underestimated_rate,"
        " round(avg(CAST(delivery_status = 'Shipping canceled' AS DOUBLE)), 6) AS canceled_rate,"
        " round(avg(CAST(delay > 0 AS DOUBLE)) * 100, 2) AS underestimated_rate_pct,"
        " round(avg(CAST(delivery_status = 'Shipping canceled' AS DOUBLE)) * 100, 2) AS canceled_pct FROM lines GROUP BY 1"
    ),
)
def promise_calibration(spark, folder):
    lines = order_lines(spark, folder, [*BASE, "delivery_status"])
    lines = lines.withColumn("is_canceled", F.col("delivery_status") == "Shipping canceled")
    return rounded(promise.mode_calibration(lines))


@query(
    "lateness_by_country",
    with_lines(f"SELECT shipping_mode, country, {_RATES} FROM lines GROUP BY 1, 2 HAVING count(*) >= 300"),
)
def lateness_by_country(spark, folder):
    lines = order_lines(spark, folder, [*BASE, "country"])
    return rounded(promise.lateness_by(lines, ["shipping_mode", "country"], 300))


@query(
    "critical_countries",
    with_lines(
        f", g AS (SELECT shipping_mode, country, {_RATES} FROM lines WHERE shipping_mode IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2 HAVING count(*) >= 300)"
        " SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY shipping_mode ORDER BY official_late_pct DESC, country) <= 8"
    ),
)
def critical_countries(spark, folder):
    lines = order_lines(spark, folder, [*BASE, "country"])
    return rounded(promise.critical_places(lines, "country", 300, 8, CRITICAL))


@query(
    "critical_cities",
    with_lines(
        f", g AS (SELECT shipping_mode, city, {_RATES} FROM lines WHERE shipping_mode IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2 HAVING count(*) >= 150)"
        " SELECT *, shipping_mode || ' | ' || city AS label FROM g ORDER BY official_late_pct DESC, shipping_mode, city LIMIT 12"
    ),
)
def critical_cities(spark, folder):
    lines = order_lines(spark, folder, [*BASE, "city"])
    cities = promise.lateness_by(lines, ["shipping_mode", "city"], 150, CRITICAL)
    top = agg.top(cities, 12, F.desc("official_late_pct"), "shipping_mode", "city")
    return rounded(top.withColumn("label", F.concat_ws(" | ", "shipping_mode", "city")))


@query(
    "critical_months",
    with_lines(
        f"SELECT shipping_mode, CAST(month(order_ts) AS INTEGER) AS order_month, {_RATES} FROM lines"
        " WHERE shipping_mode IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2"
    ),
)
def critical_months(spark, folder):
    lines = order_lines(spark, folder, [*BASE, "order_ts"]).withColumn("order_month", F.month("order_ts"))
    return rounded(promise.lateness_by(lines, ["shipping_mode", "order_month"], 0, CRITICAL))


@query(
    "lateness_month_by_mode",
    with_lines(
        "SELECT CAST(month(order_ts) AS INTEGER) AS order_month,"
        + ",".join(
            f" coalesce(round(avg(CAST(official_late AS DOUBLE)) FILTER (WHERE shipping_mode = '{m}') * 100, 2), 0) AS mode_{i}"
            for i, m in enumerate(MODES, start=1)
        )
        + " FROM lines GROUP BY 1"
    ),
)
def lateness_month_by_mode(spark, folder):
    lines = order_lines(spark, folder, [*BASE, "order_ts"]).withColumn("order_month", F.month("order_ts"))
    monthly = promise.lateness_by(lines, ["shipping_mode", "order_month"])
    return rounded(agg.pivot_measure(monthly, "order_month", "shipping_mode", {f"mode_{i}": m for i, m in enumerate(MODES, 1)}, "official_late_pct"), 2)


def _delay_name(d):
    return f"n_{str(d).replace('-', 'm')}"


@query(
    "delay_crosstab",
    with_lines(
        "SELECT shipping_mode, " + ", ".join(f"count(*) FILTER (WHERE delay = {d}) AS {_delay_name(d)}" for d in DELAYS)
        + " FROM lines GROUP BY 1"
    ),
)
def delay_crosstab(spark, folder):
    lines = promise.with_delay(order_lines(spark, folder, BASE))
    return agg.crosstab(lines, "shipping_mode", "delay_days", DELAYS, MODES)


@query(
    "delay_shares",
    with_lines(
        "SELECT shipping_mode, " + ", ".join(f"round(count(*) FILTER (WHERE delay = {d}) / count(*), 6) AS {_delay_name(d)}" for d in DELAYS)
        + " FROM lines GROUP BY 1"
    ),
)
def delay_shares(spark, folder):
    lines = promise.with_delay(order_lines(spark, folder, BASE))
    return rounded(agg.crosstab(lines, "shipping_mode", "delay_days", DELAYS, MODES, normalise=True))


@query(
    "status_crosstab",
    with_lines(
        "SELECT delivery_status, round(round_even(avg(CAST(NOT delay > 0 AS DOUBLE)), 4) * 100, 2) AS underestimated_false_pct,"
        " round(round_even(avg(CAST(delay > 0 AS DOUBLE)), 4) * 100, 2) AS underestimated_true_pct FROM lines GROUP BY 1"
    ),
)
def status_crosstab(spark, folder):
    return rounded(promise.status_crosstab(order_lines(spark, folder, [*BASE, "delivery_status"])), 2)


@query(
    "promise_compliance_test",
    with_lines(
        f", r AS (SELECT *, row_number() OVER (ORDER BY order_ts, {LINE_KEY_SQL}) AS i, count(*) OVER () AS n FROM lines)"
        " SELECT shipping_mode, count(*) AS orders, round_even(avg(CAST(delay <= 0 AS DOUBLE)) * 100, 2) AS promise_met_pct,"
        " round(avg(promised_days), 2) AS promised_days, round(avg(actual_days), 2) AS actual_days"
        " FROM r WHERE i > CAST(floor(n * 0.8) AS BIGINT) GROUP BY 1"
    ),
)
def promise_compliance_test(spark, folder):
    # The split reads the lines several times, so the join is written once.
    lines = stage(order_lines(spark, folder, ["shipping_mode", "promised_days", "actual_days", "order_ts", *LINE_KEY]))
    test = share_split(lines, ["order_ts", *LINE_KEY]).filter(F.col("split") == "test")
    return promise.promise_compliance(test)


@query(
    "late_rate_busiest_countries",
    with_lines(
        ", b AS (SELECT country FROM lines GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 15)"
        " SELECT country, round(avg(CAST(official_late AS DOUBLE)) * 100, 4) AS late_pct FROM lines JOIN b USING (country) GROUP BY 1"
    ),
)
def late_rate_busiest_countries(spark, folder):
    lines = keep_top_keys(order_lines(spark, folder, ["country", "official_late"]), "country", 15)
    late = F.avg(F.col("official_late").cast("double")) * 100
    return rounded(agg.summarise(lines, ["country"], {"late_pct": late}), 4)


@query(
    "median_days_by_mode",
    with_lines("SELECT shipping_mode, CAST(quantile_cont(actual_days, 0.5) AS DOUBLE) AS median_days FROM lines GROUP BY 1"),
)
def median_days_by_mode(spark, folder):
    return agg.median_by(order_lines(spark, folder, BASE), ["shipping_mode"], "actual_days", "median_days")


@query(
    "usual_category_by_product",
    with_lines(
        ", c AS (SELECT product, category, count(*) AS k FROM lines GROUP BY 1, 2)"
        " SELECT product, category AS usual_category FROM c QUALIFY row_number() OVER (PARTITION BY product ORDER BY k DESC, category) = 1"
    ),
)
def usual_category_by_product(spark, folder):
    lines = order_lines(spark, folder, ["product", "category"])
    return agg.mode_by(lines, ["product"], "category", "usual_category", "Unknown")
