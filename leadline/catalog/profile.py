"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadline.catalog.registry import query, rounded, with_lines
from leadline.operators import profile as p
from leadline.plans.arrival import LEAKAGE
from leadline.sources.tables import order_lines, read_table, web_events

LINEITEM = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
URL_KEYWORDS = ["http", "example", "page", "ref=", "/fr/", "/en/", ".com", "delay", "late", "hold", "cart"]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query("profile_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def profile_shape(spark, folder):
    return p.table_shape(read_table(spark, folder, "lineitem"))


@query(
    "profile_column_info",
    _union([f"SELECT '{c}' AS column_name, count({c}) AS non_null, '{t}' AS data_type FROM lineitem" for c, t in LINEITEM]),
)
def profile_column_info(spark, folder):
    return p.column_info(read_table(spark, folder, "lineitem"))


@query(
    "profile_describe_numeric",
    _union(
        [
            f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,"
            f" round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 4) AS p25,"
            f" round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75 FROM lineitem"
            for c in NUMBERS
        ]
    ),
)
def profile_describe_numeric(spark, folder):
    return rounded(p.describe_numeric(read_table(spark, folder, "lineitem"), NUMBERS), 4)


@query(
    "profile_describe_text",
    _union(
        [
            f"SELECT * FROM (SELECT '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_unique,"
            f" first(v ORDER BY n DESC, v) AS top, max(n) AS freq FROM"
            f" (SELECT {c} AS v, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY 1))"
            for c in ("lang", "source")
        ]
    ),
)
def profile_describe_text(spark, folder):
    return p.describe_text(read_table(spark, folder, "documents"), ["lang", "source"])


def _labelled(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read_table(spark, folder, "labels"), "doc_id", "left")


_LABELLED = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(
    "profile_nulls",
    _union(
        [
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls,"
            f" round_even((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM {_LABELLED}"
            for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")
        ]
    ),
)
def profile_nulls(spark, folder):
    return p.null_report(_labelled(spark, folder))


@query(
    "profile_cardinality",
    _union(
        [
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct,"
            f" round_even(count(DISTINCT {c}) * 100.0 / count(*), 2) AS distinct_pct FROM lineitem"
            for c, _ in LINEITEM
        ]
    ),
)
def profile_cardinality(spark, folder):
    return rounded(p.cardinality(read_table(spark, folder, "lineitem")), 2)


@query("profile_cardinality_approx")
def profile_cardinality_approx(spark, folder):
    return p.cardinality(read_table(spark, folder, "lineitem"), approximate=True)


@query(
    "profile_duplicates",
    "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n) - count(*) AS BIGINT) AS duplicates,"
    " round(CAST(sum(n) - count(*) AS DOUBLE) * 100 / sum(n), 2) AS duplicate_pct FROM"
    " (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
)
def profile_duplicates(spark, folder):
    return p.duplicate_rows(read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"))


@query(
    "profile_duplicate_rows",
    "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n) - count(*) AS BIGINT) AS duplicates,"
    " round(CAST(sum(n) - count(*) AS DOUBLE) * 100 / sum(n), 2) AS duplicate_pct FROM"
    f" (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(c for c, _ in LINEITEM)})",
)
def profile_duplicate_rows(spark, folder):
    return p.duplicate_rows(read_table(spark, folder, "lineitem"))


@query(
    "profile_date_like",
    "SELECT 'order_text' AS column_name, round(avg(CASE WHEN l_tax <> 0.08 THEN 1.0 ELSE 0.0 END), 6) AS success,"
    " min(o_orderdate) FILTER (WHERE l_tax <> 0.08) AS first_ts, max(o_orderdate) FILTER (WHERE l_tax <> 0.08) AS last_ts"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def profile_date_like(spark, folder):
    lines = order_lines(spark, folder, ["order_ts", "tax", "shipping_mode", "payment_type"])
    text = F.when(F.col("tax") == 0.08, "n/a").otherwise(F.date_format("order_ts", "M/d/yyyy H:mm"))
    table = lines.select(text.alias("order_text"), "shipping_mode", "payment_type")
    found = p.date_like_columns(table, table.columns, ["M/d/yyyy H:mm", "yyyy-MM-dd"])
    return rounded(found)


@query(
    "profile_top_values",
    "SELECT column_name, value, n, position, pct FROM ("
    + _union(
        [
            f"SELECT '{c}' AS column_name, v AS value, n, row_number() OVER (ORDER BY n DESC, v NULLS FIRST) AS position,"
            f" round(n * 100.0 / (SELECT count(*) FROM {_LABELLED}), 2) AS pct"
            f" FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {_LABELLED} GROUP BY 1)"
            for c in ("lang", "source", "quality", "toxic")
        ]
    )
    + ") WHERE position <= 10",
)
def profile_top_values(spark, folder):
    top = p.top_values(_labelled(spark, folder), ["lang", "source", "quality", "toxic"])
    return rounded(top.withColumn("position", F.col("position").cast("long")), 2)


@query(
    "profile_keyword_hits",
    _union([f"SELECT '{k}' AS keyword, count(*) FILTER (WHERE contains(lower(url), '{k}')) AS hits FROM pages" for k in URL_KEYWORDS]),
)
def profile_keyword_hits(spark, folder):
    return p.keyword_hits(read_table(spark, folder, "pages"), "url", URL_KEYWORDS)


@query(
    "profile_distribution",
    with_lines(
        "SELECT delivery_status, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM lines), 2) AS pct"
        " FROM lines GROUP BY 1"
    ),
)
def profile_distribution(spark, folder):
    return rounded(p.distribution(order_lines(spark, folder, ["delivery_status"]), "delivery_status"), 2)


AUDIT = ["shipping_mode", "country", "quantity", "discount_rate", "actual_days", "delivery_status", "campaign"]
_AUDIT_SQL = _union(
    [
        f"SELECT '{c}' AS column_name, true AS present, '{k}' AS kind, {str(leak).lower()} AS leakage,"
        f" round(count({c}) * 1.0 / count(*), 6) AS coverage, count(DISTINCT {c}) AS n_distinct,"
        f" '{'excluded: leakage' if leak else 'available'}' AS status FROM lines"
        for c, k, leak in [
            ("shipping_mode", "text", False), ("country", "text", False), ("quantity", "numeric", False),
            ("discount_rate", "numeric", False), ("actual_days", "numeric", True), ("delivery_status", "text", True),
        ]
    ]
    + ["SELECT 'campaign', false, NULL, false, NULL, NULL, 'missing'"]
)


@query("profile_feature_audit", with_lines(_AUDIT_SQL))
def profile_feature_audit(spark, folder):
    lines = order_lines(spark, folder, AUDIT[:-1])
    return rounded(p.feature_audit(lines, AUDIT, LEAKAGE))


@query(
    "profile_kpis",
    with_lines(
        "SELECT count(*) AS n_rows, round(sum(sales), 2) AS total_sales, count(DISTINCT order_id) AS orders,"
        " count(DISTINCT customer_id) AS customers, count(DISTINCT product) AS products,"
        " count(DISTINCT country) AS countries, count(DISTINCT city) AS cities FROM lines"
    ),
)
def profile_kpis(spark, folder):
    lines = order_lines(spark, folder, ["sales", "order_id", "customer_id", "product", "country", "city"])
    distinct = {"orders": "order_id", "customers": "customer_id", "products": "product", "countries": "country", "cities": "city"}
    return rounded(p.kpi_row(lines, "sales", distinct), 2)


@query(
    "profile_hour_check",
    "SELECT hour(ts) = user_id % 24 AS hour_matches, count(*) AS n FROM events GROUP BY 1",
)
def profile_hour_check(spark, folder):
    events = web_events(spark, folder)
    checked = events.select(p.hour_matches(F.col("access_ts"), F.col("claimed_hour")).alias("hour_matches"))
    return checked.groupBy("hour_matches").agg(F.count(F.lit(1)).alias("n"))
