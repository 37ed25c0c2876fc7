"""Queries over column expressions: calendar, numbers, bins, text, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadline.catalog.registry import LINE_KEY_SQL, OFF_TIE, query, rounded, with_lines
from leadline.functions import dates, labels, numbers
from leadline.plans import cleaning
from leadline.plans import sales as sales_plan
from leadline.session import stage
from leadline.sources.tables import LINE_KEY, order_lines, read_table, web_events

_PERIOD_SQL = (
    "CASE WHEN strftime({d}, '%m-%d') IN ('01-01', '05-01', '12-25') THEN 'Generic fixed holiday'"
    " WHEN month({d}) = 9 AND day({d}) <= 15 THEN 'Back to school period'"
    " WHEN month({d}) = 11 AND day({d}) BETWEEN 20 AND 30 THEN 'Black Friday period'"
    " WHEN month({d}) = 12 THEN 'Christmas season' ELSE 'Normal' END"
)


@query(
    "order_calendar",
    "SELECT ts, CAST(year(ts) AS INTEGER) AS order_year, CAST(month(ts) AS INTEGER) AS order_month,"
    " CAST(day(ts) AS INTEGER) AS order_day, CAST(isodow(ts) - 1 AS INTEGER) AS order_dayofweek,"
    " CAST(dayofyear(ts) AS INTEGER) AS order_dayofyear, CAST(weekofyear(ts) AS INTEGER) AS order_weekofyear,"
    " CAST(quarter(ts) AS INTEGER) AS order_quarter, CAST(hour(ts) AS INTEGER) AS order_hour,"
    " CAST(isodow(ts) >= 6 AS INTEGER) AS order_is_weekend,"
    " round(sin(2 * pi() * month(ts) / 12), 6) + 0.0 AS order_month_sin, round(cos(2 * pi() * month(ts) / 12), 6) + 0.0 AS order_month_cos,"
    " round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS order_dayofweek_sin,"
    " round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS order_dayofweek_cos, n"
    " FROM (SELECT o_orderdate AS ts, count(*) AS n FROM orders GROUP BY 1)",
)
def order_calendar(spark, folder):
    days = read_table(spark, folder, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    out = rounded(days.withColumns(dates.calendar_columns("ts")))
    waves = [c for c in out.columns if c.endswith(("_sin", "_cos"))]
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in waves})


@query(
    "calendar_labels",
    "SELECT d, strftime(d, '%Y-%m') AS month_label, monthname(d) AS month_name, dayname(d) AS day_name,"
    " 'Q' || quarter(d) AS quarter_label, strftime(d, '%m-%d') IN ('01-01', '05-01', '12-25') AS is_holiday, "
    + _PERIOD_SQL.format(d="d")
    + " AS calendar_period, CAST(d + INTERVAL 7 DAY AS DATE) AS in_a_week, n"
    " FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)",
)
def calendar_labels(spark, folder):
    days = read_table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumns(
        {
            "month_label": dates.month_label("d"),
            "month_name": dates.month_name("d"),
            "day_name": dates.day_name("d"),
            "quarter_label": dates.quarter_label("d"),
            "is_holiday": dates.is_fixed_holiday("d"),
            "calendar_period": dates.calendar_period("d"),
            "in_a_week": F.date_add("d", 7),
        }
    )


@query(
    "mixed_timestamp_parse",
    "SELECT CASE event_id % 4 WHEN 0 THEN 'minute' WHEN 1 THEN 'second' WHEN 2 THEN 'day' ELSE 'bad' END AS style,"
    " count(*) AS n, count(*) FILTER (WHERE event_id % 4 <> 3) AS parsed,"
    " min(CASE event_id % 4 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('second', ts)"
    " WHEN 2 THEN date_trunc('day', ts) END) AS first_ts FROM events GROUP BY 1",
)
def mixed_timestamp_parse(spark, folder):
    events = read_table(spark, folder, "events").withColumn("_k", F.col("event_id") % 4)
    k = F.col("_k")
    text = (
        F.when(k == 0, F.date_format("ts", "M/d/yyyy H:mm"))
        .when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise("unknown")
    )
    style = F.when(k == 0, "minute").when(k == 1, "second").when(k == 2, "day").otherwise("bad")
    parsed = dates.parse_timestamp_any(text, cleaning.ACCESS_FORMATS)
    return events.select(style.alias("style"), parsed.alias("t")).groupBy("style").agg(
        F.count(F.lit(1)).alias("n"), F.count("t").alias("parsed"), F.min("t").alias("first_ts")
    )


@query(
    "number_rules",
    "SELECT quantity, discount_rate, tax, n, CASE WHEN quantity - 1 > 0 THEN round(sales / (quantity - 1) + 3e-7, 4) END AS per_extra_unit,"
    " round_even(discount_rate * 100, 2) AS discount_pct, CAST(ceil(tax * 100 / 3) AS BIGINT) AS tax_ceiling,"
    " round(greatest(tax * 10 - discount_rate * 5, 0), 6) AS clipped, round_even(quantity / 2, 0) AS half_even,"
    " round(sqrt(abs(tax * 10 - discount_rate * 5)), 6) AS root, round(pow(quantity, 2), 6) AS squared,"
    " CASE WHEN quantity < 25 THEN quantity END AS as_number,"
    " CASE WHEN quantity <> 50 THEN round(1 / (50 - quantity), 6) END AS finite"
    " FROM (SELECT l_quantity AS quantity, l_discount AS discount_rate, l_tax AS tax, count(*) AS n, round(sum(l_extendedprice), 2) AS sales"
    " FROM lineitem GROUP BY 1, 2, 3)",
)
def number_rules(spark, folder):
    lines = order_lines(spark, folder, ["quantity", "discount_rate", "tax", "sales"])
    cells = lines.groupBy("quantity", "discount_rate", "tax").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("sales"), 2).alias("sales")
    )
    q, d, t = F.col("quantity"), F.col("discount_rate"), F.col("tax")
    margin = t * 10 - d * 5
    text = F.when(q < 25, q.cast("string")).otherwise(F.concat(q.cast("string"), F.lit(" units")))
    infinite = F.when(q == 50, F.lit(float("inf"))).otherwise(1 / (50 - q))
    return cells.select(
        "quantity", "discount_rate", "tax", "n",
        F.round(numbers.safe_divide(F.col("sales"), q - 1) + OFF_TIE, 4).alias("per_extra_unit"),
        numbers.percent(d).alias("discount_pct"),
        F.ceil(t * 100 / 3).alias("tax_ceiling"),
        F.round(numbers.clip_low(margin), 6).alias("clipped"),
        F.rint(q / 2).alias("half_even"),
        F.round(F.sqrt(F.abs(margin)), 6).alias("root"),
        F.round(F.pow(q, F.lit(2.0)), 6).alias("squared"),
        numbers.to_number(text).alias("as_number"),
        F.round(numbers.finite_or_null(infinite), 6).alias("finite"),
    )


_BINS = (
    "CASE WHEN discount_rate <= 0 THEN '0%' WHEN discount_rate <= 0.05 THEN '0-5%' WHEN discount_rate <= 0.10 THEN '5-10%'"
    " WHEN discount_rate <= 0.15 THEN '10-15%' WHEN discount_rate <= 0.20 THEN '15-20%' ELSE '>20%' END AS discount_rate_bin,"
    " CASE WHEN discount <= 0 THEN '0' WHEN discount <= 5 THEN '0-5' WHEN discount <= 10 THEN '5-10' WHEN discount <= 20 THEN '10-20'"
    " WHEN discount <= 50 THEN '20-50' ELSE '>50' END AS discount_amount_bin,"
    " CASE WHEN profit_ratio <= -0.2 THEN 'Perdida alta' WHEN profit_ratio <= 0 THEN 'Perdida baja' WHEN profit_ratio <= 0.1 THEN 'Margen bajo'"
    " WHEN profit_ratio <= 0.2 THEN 'Margen medio' ELSE 'Margen alto' END AS profit_ratio_bin"
)


@query(
    "discount_bins",
    with_lines(
        f"SELECT discount_rate_bin, discount_amount_bin, profit_ratio_bin, has_discount, count(*) AS n, round(sum(sales), 2) AS sales"
        f" FROM (SELECT {_BINS}, discount > 0 AS has_discount, sales FROM lines) GROUP BY 1, 2, 3, 4"
    ),
)
def discount_bins(spark, folder):
    lines = order_lines(spark, folder, ["order_ts", "sales", "quantity", "discount", "discount_rate", "profit_ratio"])
    out = sales_plan.add_sales_calendar(lines)
    bins = ["discount_rate_bin", "discount_amount_bin", "profit_ratio_bin", "has_discount"]
    return rounded(out.groupBy(*bins).agg(F.count(F.lit(1)).alias("n"), F.sum("sales").alias("sales")), 2)


@query(
    "quantity_bins",
    "SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity_bin, count(*) AS n FROM lineitem GROUP BY 1",
)
def quantity_bins(spark, folder):
    lines = order_lines(spark, folder, ["order_ts", "sales", "quantity", "discount", "discount_rate", "profit_ratio"])
    return sales_plan.add_sales_calendar(lines).groupBy("quantity_bin").agg(F.count(F.lit(1)).alias("n"))


def _band_sql(value: str, names: list[str], source: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names, start=1))
    return with_lines(
        f", ranked AS (SELECT {value} AS v, row_number() OVER (ORDER BY {value}, {LINE_KEY_SQL}) AS r, count(*) OVER () AS n FROM {source})"
        f" SELECT CASE greatest(1, CAST(ceil(5 * (r - 1)::DOUBLE / (n - 1)) AS INTEGER)) {cases} END AS band, count(*) AS n,"
        f" round(min(v), 2) AS low, round(max(v), 2) AS high FROM ranked GROUP BY 1"
    )


def _band_report(df, band, value):
    return rounded(
        df.groupBy(F.col(band).alias("band")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
        ),
        2,
    )


@query("price_bands", _band_sql("price", labels.PRICE_BANDS, "lines"))
def price_bands(spark, folder):
    lines = stage(order_lines(spark, folder, ["price", *LINE_KEY]))
    return _band_report(sales_plan.add_price_band(lines, LINE_KEY), "product_price_bin", "price")


@query(
    "customer_value_bands",
    _band_sql(
        "total",
        labels.CUSTOMER_BANDS,
        "(SELECT l.*, round(t, 5) AS total FROM lines l JOIN (SELECT customer_id, sum(sales) AS t FROM lines GROUP BY 1) c"
        " ON l.customer_id = c.customer_id)",
    ),
)
def customer_value_bands(spark, folder):
    lines = order_lines(spark, folder, ["customer_id", *LINE_KEY])
    banded = sales_plan.add_customer_band(stage(sales_plan.add_customer_total(lines)), LINE_KEY)
    return _band_report(banded, "customer_value_band", "customer_total_sales")


@query(
    "customer_value_bands_per_customer",
    with_lines(
        ", totals AS (SELECT customer_id, round(sum(sales), 5) AS v, count(*) AS k FROM lines GROUP BY 1),"
        " ranked AS (SELECT *, row_number() OVER (ORDER BY v, customer_id) AS r, count(*) OVER () AS n FROM totals)"
        " SELECT CASE greatest(1, CAST(ceil(5 * (r - 1)::DOUBLE / (n - 1)) AS INTEGER)) "
        + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(labels.CUSTOMER_BANDS, start=1))
        + " END AS band, CAST(sum(k) AS BIGINT) AS n, round(min(v), 2) AS low, round(max(v), 2) AS high FROM ranked GROUP BY 1"
    ),
)
def customer_value_bands_per_customer(spark, folder):
    lines = stage(order_lines(spark, folder, ["customer_id", "sales"]))
    return _band_report(sales_plan.add_customer_band_per_customer(lines), "customer_value_band", "customer_total_sales")


@query(
    "payment_labels",
    "SELECT CASE l_returnflag WHEN 'N' THEN 'Unknown' ELSE l_returnflag END AS payment_label,"
    " l_returnflag = 'A' AS payment_type_a, l_returnflag = 'R' AS payment_type_r, count(*) AS n FROM lineitem GROUP BY 1, 2, 3",
)
def payment_labels(spark, folder):
    lines = cleaning.add_payment_flags(order_lines(spark, folder, ["payment_type"]), "payment_type", ["A", "R"])
    flags = ["payment_type_a", "payment_type_r"]
    out = lines.withColumn("payment_label", labels.argmax_label(flags, "payment_type_"))
    return out.groupBy("payment_label", *flags).agg(F.count(F.lit(1)).alias("n"))


@query(
    "payment_one_hot",
    "SELECT l_linestatus AS line_status, count(*) FILTER (WHERE l_returnflag = 'A') AS payment_type_a,"
    " count(*) FILTER (WHERE l_returnflag = 'N') AS payment_type_n, count(*) FILTER (WHERE l_returnflag = 'R') AS payment_type_r"
    " FROM lineitem GROUP BY 1",
)
def payment_one_hot(spark, folder):
    lines = cleaning.add_payment_flags(order_lines(spark, folder, ["payment_type", "line_status"]), "payment_type")
    flags = [c for c in lines.columns if c.startswith("payment_type_")]
    return lines.groupBy("line_status").agg(*[numbers.count_if(F.col(c)).alias(c) for c in flags])


@query(
    "text_labels",
    "SELECT page_id, CASE WHEN length(url) > 42 THEN substr(url, 1, 39) || '...' ELSE url END AS short_url,"
    " contains(lower(url), '/fr/') AS is_french, 'page ' || page_id || ' | ' || length(html) AS title FROM pages",
)
def text_labels(spark, folder):
    pages = read_table(spark, folder, "pages")
    title = F.concat(F.lit("page "), F.concat_ws(" | ", F.col("page_id").cast("string"), F.length("html").cast("string")))
    return pages.select(
        "page_id",
        labels.short_label(F.col("url")).alias("short_url"),
        F.lower("url").contains("/fr/").alias("is_french"),
        title.alias("title"),
    )


@query(
    "title_case_labels",
    "SELECT upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS type_label,"
    " CASE p_brand WHEN 'Brand#1' THEN 'House brand' ELSE p_brand END AS brand_label, count(*) AS n FROM part GROUP BY 1, 2",
)
def title_case_labels(spark, folder):
    part = read_table(spark, folder, "part")
    kind = labels.strip_prefix_title(F.concat(F.lit("type_"), F.col("p_type")), "type_")
    brand = labels.relabel(F.col("p_brand"), {"Brand#1": "House brand"})
    return part.select(kind.alias("type_label"), brand.alias("brand_label")).groupBy("type_label", "brand_label").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "row_filters",
    "SELECT event_type, count(*) AS n, count(k) AS with_product, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS browsing,"
    " count(*) FILTER (WHERE value > 20) AS large, count(*) FILTER (WHERE starts_with(event_type, 'p')) AS p_events,"
    " count(*) FILTER (WHERE k < 10 OR value > 90) AS any_flag"
    " FROM (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
)
def row_filters(spark, folder):
    events = read_table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind, value = F.col("event_type"), F.col("value")
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("k").alias("with_product"),
        numbers.count_if(kind.isin(["view", "click"])).alias("browsing"),
        numbers.count_if(value > 20).alias("large"),
        numbers.count_if(kind.startswith("p")).alias("p_events"),
        numbers.count_if(numbers.any_of(F.col("k") < 10, value > 90)).alias("any_flag"),
    )


@query(
    "complete_rows",
    "SELECT lang, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
    " WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1",
)
def complete_rows(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "lang")
    joined = docs.join(read_table(spark, folder, "labels"), "doc_id", "left")
    present = [c for c in ["lang", "quality", "toxic", "reviewer"] if c in joined.columns]
    complete = joined.select(*present).na.drop(subset=["quality", "toxic"])
    return complete.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "web_visits_by_hour",
    "SELECT CAST(hour(ts) AS INTEGER) AS access_hour, count(*) AS visits FROM events GROUP BY 1",
)
def web_visits_by_hour(spark, folder):
    events = web_events(spark, folder)
    return events.groupBy(F.hour("access_ts").alias("access_hour")).agg(F.count(F.lit(1)).alias("visits"))
