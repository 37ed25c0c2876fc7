"""Queries on who and what sells."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadline.catalog.registry import LINE_KEY_SQL, query, rounded, with_lines
from leadline.functions import dates
from leadline.operators import aggregate as agg
from leadline.operators.order_stats import exact_quantiles
from leadline.operators.ranking import global_rank
from leadline.plans import sales
from leadline.session import stage
from leadline.sources.tables import LINE_KEY, order_lines, read_table, web_events

MEASURES = ["order_id", "sales", "quantity", "discount_rate"]
_SALES_BY = (
    "SELECT '{name}' AS feature, coalesce(CAST({expr} AS VARCHAR), 'Sin dato') AS value, round(sum(sales), 2) AS sales,"
    " count(DISTINCT order_id) AS orders, count(*) AS rows, round(avg(sales) + 3e-7, 4) AS avg_sale, round(avg(quantity) + 3e-7, 4) AS avg_quantity,"
    " round(avg(discount_rate) + 3e-7, 6) AS avg_discount_rate, round(sum(sales) / (SELECT sum(sales) FROM lines), 6) AS sales_share"
    " FROM lines GROUP BY {expr}"
)
MEANS = ["avg_sale", "avg_quantity", "avg_discount_rate"]
DIGITS = {"sales": 2, "avg_sale": 4, "avg_quantity": 4}

# dimension -> (SQL expression, top-n of the report)
PLAIN = {
    "country": ("country", 20), "city": ("city", 20), "market": ("market", None), "segment": ("segment", None),
    "customer_id": ("customer_id", 20), "department": ("department", None), "category": ("category", 20),
    "product": ("product", 20), "payment_type": ("payment_type", None), "shipping_mode": ("shipping_mode", None),
    "order_status": ("order_status", 12),
}


def _sql(name, expr, n=None):
    body = _SALES_BY.format(name=name, expr=expr)
    return with_lines(body + (f" ORDER BY sum(sales) DESC, {expr} LIMIT {n}" if n else ""))


def _register(name, expr, n):
    @query(f"sales_by_{name}", _sql(name, expr, n))
    def run(spark, folder):
        lines = order_lines(spark, folder, [*MEASURES, name])
        return rounded(sales.sales_by(lines, name, n), off_tie=MEANS, **DIGITS)


for _name, (_expr, _n) in PLAIN.items():
    _register(_name, _expr, _n)

_PERIOD = (
    "CASE WHEN strftime(order_ts, '%m-%d') IN ('01-01', '05-01', '12-25') THEN 'Generic fixed holiday'"
    " WHEN month(order_ts) = 9 AND day(order_ts) <= 15 THEN 'Back to school period'"
    " WHEN month(order_ts) = 11 AND day(order_ts) BETWEEN 20 AND 30 THEN 'Black Friday period'"
    " WHEN month(order_ts) = 12 THEN 'Christmas season' ELSE 'Normal' END"
)
DERIVED = {
    "order_year_month": ("strftime(order_ts, '%Y-%m')", None),
    "order_month_name": ("monthname(order_ts)", dates.MONTH_NAMES),
    "order_day_name": ("dayname(order_ts)", dates.DAY_NAMES),
    "order_quarter": ("'Q' || quarter(order_ts)", None),
    "is_weekend": ("isodow(order_ts) >= 6", None),
    "is_generic_fixed_holiday": ("strftime(order_ts, '%m-%d') IN ('01-01', '05-01', '12-25')", None),
    "calendar_period": (_PERIOD, None),
    "has_discount": ("discount > 0", None),
    "quantity_bin": ("CAST(CAST(quantity AS BIGINT) AS VARCHAR)", None),
    "discount_rate_bin": (
        "CASE WHEN discount_rate <= 0 THEN '0%' WHEN discount_rate <= 0.05 THEN '0-5%' WHEN discount_rate <= 0.10 THEN '5-10%'"
        " WHEN discount_rate <= 0.15 THEN '10-15%' WHEN discount_rate <= 0.20 THEN '15-20%' ELSE '>20%' END", None),
    "discount_amount_bin": (
        "CASE WHEN discount <= 0 THEN '0' WHEN discount <= 5 THEN '0-5' WHEN discount <= 10 THEN '5-10'"
        " WHEN discount <= 20 THEN '10-20' WHEN discount <= 50 THEN '20-50' ELSE '>50' END", None),
    "profit_ratio_bin": (
        "CASE WHEN profit_ratio <= -0.2 THEN 'Perdida alta' WHEN profit_ratio <= 0 THEN 'Perdida baja' WHEN profit_ratio <= 0.1"
        " THEN 'Margen bajo' WHEN profit_ratio <= 0.2 THEN 'Margen medio' ELSE 'Margen alto' END", None),
}


def _register_derived(name, expr, order):
    @query(f"sales_by_{name}", _sql(name, expr))
    def run(spark, folder):
        lines = order_lines(spark, folder, [*MEASURES, "order_ts", "discount", "profit_ratio"])
        return rounded(sales.sales_by(sales.add_sales_calendar(lines), name, value_order=order), off_tie=MEANS, **DIGITS)


for _name, (_expr, _order) in DERIVED.items():
    _register_derived(_name, _expr, _order)


def _band_sql(name, value, names, source):
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names, start=1))
    return (
        f", ranked AS (SELECT *, row_number() OVER (ORDER BY {value}, {LINE_KEY_SQL}) AS r, count(*) OVER () AS n FROM {source}),"
        f" banded AS (SELECT *, CASE greatest(1, CAST(ceil(5 * (r - 1)::DOUBLE / (n - 1)) AS INTEGER)) {cases} END AS band FROM ranked) "
        + _SALES_BY.format(name=name, expr="band").replace("FROM lines GROUP", "FROM banded GROUP")
    )


@query("sales_by_product_price_bin", with_lines(_band_sql("product_price_bin", "price", sales.labels.PRICE_BANDS, "lines")))
def sales_by_price_band(spark, folder):
    lines = stage(order_lines(spark, folder, [*MEASURES, "price", *LINE_KEY]))
    return rounded(sales.sales_by(sales.add_price_band(lines, LINE_KEY), "product_price_bin"), off_tie=MEANS, **DIGITS)


@query(
    "sales_by_customer_value_band",
    with_lines(
        _band_sql(
            "customer_value_band", "total", sales.labels.CUSTOMER_BANDS,
            "(SELECT l.*, round(t, 5) AS total FROM lines l JOIN (SELECT customer_id, sum(sales) AS t FROM lines GROUP BY 1) c"
            " ON l.customer_id = c.customer_id)",
        )
    ),
)
def sales_by_customer_band(spark, folder):
    lines = order_lines(spark, folder, [*MEASURES, "customer_id", *LINE_KEY])
    banded = sales.add_customer_band(stage(sales.add_customer_total(lines)), LINE_KEY)
    return rounded(sales.sales_by(banded, "customer_value_band"), off_tie=MEANS, **DIGITS)


@query(
    "price_first_come_rank",
    with_lines(
        f" SELECT {LINE_KEY_SQL}, price, CASE WHEN price IS NOT NULL THEN"
        f" row_number() OVER (ORDER BY price NULLS LAST, {LINE_KEY_SQL}) END AS price_rank FROM lines"
    ),
)
def price_first_come_rank(spark, folder):
    """The rank behind the price bands as data: each line's place by price, ties by the line key."""
    lines = order_lines(spark, folder, ["price", *LINE_KEY])
    return global_rank(lines, ["price", *LINE_KEY], "price_rank", null_rank=False)


# Reports of the stacked table beside PLAIN and DERIVED: name -> (column, SQL expression, top-n). The tables know
# one place per customer, which stands for the order's place and the customer's.
_OTHER = {
    "order_region": ("market", "market", 15), "customer_country": ("country", "country", 15), "customer_city": ("city", "city", 20),
    "product_price_bin": ("product_price_bin", "price_band", None), "customer_value_band": ("customer_value_band", "customer_band", None),
}
STACKED = {
    **{name: (name, expr, n) for name, (expr, n) in PLAIN.items()},
    **{name: (name, expr, None) for name, (expr, _) in DERIVED.items() if name != "order_quarter"},
    **_OTHER,
}


def _stacked_sql():
    def band(rank, names):
        cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names, start=1))
        return f"CASE greatest(1, CAST(ceil(5 * ({rank} - 1)::DOUBLE / (n - 1)) AS INTEGER)) {cases} END"

    reports = []
    for name, (_, expr, n) in STACKED.items():
        body = _SALES_BY.format(name=name, expr=expr).replace("FROM lines GROUP", "FROM banded GROUP")
        reports.append(f"(SELECT * FROM ({body} ORDER BY sum(sales) DESC, {expr} LIMIT {n}))" if n else body)
    return with_lines(
        ", totalled AS (SELECT l.*, round(t, 5) AS total FROM lines l JOIN (SELECT customer_id, sum(sales) AS t FROM lines GROUP BY 1) c"
        " ON l.customer_id = c.customer_id),"
        f" ranked AS (SELECT *, row_number() OVER (ORDER BY price, {LINE_KEY_SQL}) AS by_price,"
        f" row_number() OVER (ORDER BY total, {LINE_KEY_SQL}) AS by_total, count(*) OVER () AS n FROM totalled),"
        f" banded AS MATERIALIZED (SELECT *, {band('by_price', sales.labels.PRICE_BANDS)} AS price_band,"
        f" {band('by_total', sales.labels.CUSTOMER_BANDS)} AS customer_band FROM ranked) " + " UNION ALL ".join(reports)
    )


@query("sales_report_stacked", _stacked_sql())
def sales_report_stacked(spark, folder):
    """All 27 sales reports; the lines are joined and staged once and expanded in one pass.

    Customers' totals join the orders, and calendar labels and bins are worked out where they are counted, so what is
    staged and moved is a line's own columns.
    """
    roles = [*MEASURES, *PLAIN, "order_ts", "discount", "profit_ratio", "price", "customer_id", *LINE_KEY]
    known = ["order_ts", "sales"]
    # The totals are of the same lines, also where a lookup table has a key twice.
    totals = stage(sales.customer_totals(order_lines(spark, folder, roles).na.drop(subset=known)))
    lines = stage(order_lines(spark, folder, roles, totals).na.drop(subset=known))
    banded = sales.add_customer_band(sales.add_price_band(lines, LINE_KEY), LINE_KEY)
    report = sales.sales_report(banded, {name: (column, n) for name, (column, _, n) in STACKED.items()}, derive=sales.add_sales_calendar)
    return rounded(report, off_tie=MEANS, **DIGITS)


@query(
    "sales_versus_views",
    with_lines(
        ", s AS (SELECT part_id % 100 AS product_bucket, sum(sales) AS sales FROM lines GROUP BY 1),"
        " v AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_bucket, count(*) AS views FROM events GROUP BY 1),"
        " j AS (SELECT coalesce(s.product_bucket, v.product_bucket) AS product_bucket, coalesce(sales, 0) AS sales, coalesce(views, 0) AS views"
        " FROM s FULL JOIN v ON s.product_bucket = v.product_bucket)"
        " SELECT product_bucket, round(sales, 2) AS sales, views, round(sales / sum(sales) OVER (), 6) AS sales_share,"
        " round(views / sum(views) OVER (), 6) AS views_share,"
        " round(sales / sum(sales) OVER () - views / sum(views) OVER (), 6) AS share_gap_sales_minus_views FROM j WHERE sales > 0 OR views > 0"
    ),
)
def sales_versus_views(spark, folder):
    lines = order_lines(spark, folder, ["part_id", "sales"])
    sold = lines.select(F.pmod("part_id", F.lit(100)).alias("product_bucket"), "sales")
    return rounded(sales.sales_versus_views(sold, web_events(spark, folder), "product_bucket"), sales=2)


@query(
    "customer_total_on_lines",
    with_lines(
        " SELECT order_id, line_no, customer_id, round(sum(sales) OVER (PARTITION BY customer_id), 2) AS customer_total_sales FROM lines"
    ),
)
def customer_total_on_lines(spark, folder):
    lines = order_lines(spark, folder, ["order_id", "line_no", "customer_id", "sales"])
    out = sales.add_customer_total(lines).select("order_id", "line_no", "customer_id", "customer_total_sales")
    return rounded(out, 2)


_PAYMENT_FLAGS = ", ".join(
    f"corr(CASE WHEN payment_type = '{v}' THEN 1.0 ELSE 0.0 END, {{t}}) AS payment_type_{v.lower()}" for v in "ANR"
)
_CORR = (
    ", c AS (SELECT corr(promised_days, {t}) AS promised_days, corr(discount_rate, {t}) AS discount_rate, corr(price, {t}) AS price,"
    " corr(quantity, {t}) AS quantity, corr(month(order_ts), {t}) AS order_month, corr(isodow(order_ts) - 1, {t}) AS order_dayofweek, "
    + _PAYMENT_FLAGS
    + " FROM lines) SELECT feature, round(correlation, 6) AS correlation FROM (UNPIVOT c ON COLUMNS(*) INTO NAME feature VALUE correlation)"
)
NUMERIC = [
    "promised_days", "discount_rate", "price", "quantity", "order_month", "order_dayofweek",
    "payment_type_a", "payment_type_n", "payment_type_r",
]


def _numeric_lines(spark, folder):
    lines = order_lines(
        spark, folder,
        ["promised_days", "discount_rate", "price", "quantity", "order_ts", "payment_type", "sales", "official_late"],
    )
    flags = sales.labels.one_hot(F.col("payment_type"), ["A", "N", "R"], "payment_type")
    return lines.withColumns({"order_month": F.month("order_ts"), "order_dayofweek": dates.weekday("order_ts"), **flags})


@query("correlation_with_sales", with_lines(_CORR.format(t="sales")))
def correlation_with_sales(spark, folder):
    return rounded(agg.correlations(_numeric_lines(spark, folder), NUMERIC, "sales"))


@query("correlation_with_lateness", with_lines(_CORR.format(t="CAST(official_late AS DOUBLE)")))
def correlation_with_lateness(spark, folder):
    return rounded(agg.correlations(_numeric_lines(spark, folder), NUMERIC, "official_late"))


@query(
    "sales_histogram_p99",
    ", ".join(
        [
            "WITH u AS (SELECT quantile_cont(l_extendedprice, 0.99) AS u FROM lineitem)",
            "v AS (SELECT l_extendedprice AS x FROM lineitem, u WHERE l_extendedprice <= u)",
            "e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)",
        ]
    )
    + " SELECT CAST(least(floor((x - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin, count(*) AS n,"
    " round(any_value(lo) + least(floor((any_value(x) - any_value(lo)) / ((any_value(hi) - any_value(lo)) / 40)), 39)"
    " * ((any_value(hi) - any_value(lo)) / 40), 4) AS bin_low FROM v, e GROUP BY 1",
)
def sales_histogram_p99(spark, folder):
    return rounded(agg.histogram(read_table(spark, folder, "lineitem"), "l_extendedprice", 40, clip_at=0.99), 4)


@query("sales_sample")
def sales_sample(spark, folder):
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_extendedprice")
    return agg.seeded_sample(lines, ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"], 12_000)


@query(
    "sales_quantiles_by_market",
    with_lines(
        " SELECT market, round(quantile_cont(sales, 0.25), 4) AS p25, round(quantile_cont(sales, 0.5), 4) AS p50,"
        " round(quantile_cont(sales, 0.99), 4) AS p99 FROM lines GROUP BY 1"
    ),
)
def sales_quantiles_by_market(spark, folder):
    lines = order_lines(spark, folder, ["market", "sales"])
    return rounded(exact_quantiles(lines, ["market"], "sales", {"p25": 0.25, "p50": 0.5, "p99": 0.99}), 4)
