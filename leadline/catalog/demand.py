"""Queries on daily demand per product."""

from __future__ import annotations

from leadline.catalog.registry import query, rounded, with_lines
from leadline.operators.metrics import best_gap, evaluate
from leadline.plans import demand
from leadline.session import stage
from leadline.sources.tables import order_lines

TEST_START = "2000-01-01"
ROLES = ["order_ts", "product", "category", "department", "quantity", "sales", "price", "discount", "discount_rate"]


def metric_sql(source: str, by: str, extra: str = "") -> str:
    """One metric row per group from (by, y, p) rows."""
    return (
        f"SELECT {by}, count(*) AS n_rows, round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) * (y - p)), 2) AS mse,"
        " round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,"
        " round(sum(abs(y - p)) / sum(abs(y)), 6) AS wape, round(avg(abs((y - p) / y)) FILTER (WHERE y <> 0), 6) AS mape_nonzero_actual,"
        " round(avg(y - p), 6) AS residual_mean, round(stddev_pop(y - p), 6) AS residual_std,"
        f" round(quantile_cont(y - p, 0.5) + 3e-7, 6) AS residual_median{extra} FROM {source} GROUP BY {by}"
    )


def scores(df):
    return rounded(df, off_tie=["residual_median"], mse=2)


_PANEL = """, facts AS (
  SELECT product, CAST(order_ts AS DATE) AS d, sum(quantity) AS quantity_sold, sum(sales) AS sales_sum, count(*) AS order_lines,
    avg(price) AS avg_price, avg(discount) AS avg_discount, avg(discount_rate) AS avg_discount_rate FROM lines GROUP BY 1, 2
), cat AS (
  SELECT product, category AS category_name FROM (SELECT product, category, count(*) AS k FROM lines GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY product ORDER BY k DESC, category) = 1
), dep AS (
  SELECT product, department AS department_name FROM (SELECT product, department, count(*) AS k FROM lines GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY product ORDER BY k DESC, department) = 1
), seen AS (SELECT product, min(d) AS first_seen FROM facts GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM facts),
panel AS (
  SELECT s.product, c.d AS order_date, category_name, department_name, first_seen, coalesce(quantity_sold, 0) AS quantity_sold,
    coalesce(sales_sum, 0) AS sales_sum, coalesce(order_lines, 0) AS order_lines, avg_price, avg_discount, avg_discount_rate
  FROM seen s CROSS JOIN cal c LEFT JOIN facts f ON f.product = s.product AND f.d = c.d
    JOIN cat ON cat.product = s.product JOIN dep ON dep.product = s.product
)"""


def panel_of(spark, folder):
    return demand.demand_panel(order_lines(spark, folder, ROLES))[0]


@query(
    "demand_panel",
    with_lines(
        _PANEL + " SELECT product, order_date, category_name, department_name, first_seen AS product_first_seen, quantity_sold,"
        " round(sales_sum, 2) AS sales_sum, order_lines, round(avg_price + 3e-7, 4) AS avg_price, round(avg_discount + 3e-7, 4) AS avg_discount,"
        " round(avg_discount_rate + 3e-7, 4) AS avg_discount_rate, CAST(order_lines > 0 AS INTEGER) AS had_sale,"
        " CAST(greatest(date_diff('day', first_seen, order_date), 0) AS INTEGER) AS days_since_product_first_seen,"
        " CAST(strftime(order_date, '%m-%d') IN ('01-01', '05-01', '12-25') AS INTEGER) AS is_generic_fixed_holiday,"
        " CASE WHEN strftime(order_date, '%m-%d') IN ('01-01', '05-01', '12-25') THEN 'Generic fixed holiday'"
        " WHEN month(order_date) = 9 AND day(order_date) <= 15 THEN 'Back to school period'"
        " WHEN month(order_date) = 11 AND day(order_date) BETWEEN 20 AND 30 THEN 'Black Friday period'"
        " WHEN month(order_date) = 12 THEN 'Christmas season' ELSE 'Normal' END AS calendar_period,"
        " CAST(weekofyear(order_date) AS INTEGER) AS order_weekofyear FROM panel"
    ),
)
def demand_panel(spark, folder):
    keep = [
        "product", "order_date", "category_name", "department_name", "product_first_seen", "quantity_sold", "sales_sum", "order_lines",
        "avg_price", "avg_discount", "avg_discount_rate", "had_sale", "days_since_product_first_seen", "is_generic_fixed_holiday",
        "calendar_period", "order_weekofyear",
    ]
    return rounded(panel_of(spark, folder).select(keep), 4, off_tie=demand.MEANS, sales_sum=2)


def _window_sql(column: str, by: str, lags: list[int], prefix: str, sums: bool = True, digits: int = 4, day: str = "order_date") -> list[str]:
    part = f"PARTITION BY {by} " if by else ""
    cols = [f"round(lag({column}, {n}) OVER ({part}ORDER BY {day}) + 3e-7, {digits}) AS {prefix}{column}_lag_{n}d" for n in lags]
    for w in demand.WINDOWS:
        frame = f"OVER ({part}ORDER BY {day} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        cols.append(f"round(avg({column}) {frame} + 3e-7, {digits}) AS {prefix}{column}_roll_mean_{w}d")
        if sums:
            cols.append(f"round(sum({column}) {frame} + 3e-7, {digits}) AS {prefix}{column}_roll_sum_{w}d")
    return cols


def _register(column: str):
    cols = _window_sql(column, "product", demand.LAGS, "product_", digits=3)
    if column == "order_lines":
        cols = [c.replace("round(lag(", "(lag(").replace(" + 3e-7, 3)", ")") if "_lag_" in c else c for c in cols]
        cols = [
            f"CAST(sum(order_lines) OVER (PARTITION BY product ORDER BY order_date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS BIGINT)"
            f" AS product_order_lines_roll_sum_{w}d" if f"_roll_sum_{w}d" in c else c
            for c in cols for w in ([7] if "_7d" in c else [30])
        ]

    @query(f"demand_history_{column}", with_lines(_PANEL + f" SELECT product, order_date, {', '.join(cols)} FROM panel"))
    def run(spark, folder):
        panel, features = demand.demand_panel(order_lines(spark, folder, ROLES))
        mine = [f for f in features if f.startswith(f"product_{column}_lag") or f.startswith(f"product_{column}_roll")]
        return rounded(panel.select("product", "order_date", *mine), 3, off_tie=mine)


for _column in demand.SUMS + demand.MEANS:
    _register(_column)

_CATEGORY = _PANEL + (
    ", catday AS (SELECT category_name, order_date, sum(quantity_sold) AS category_quantity_sold, sum(sales_sum) AS category_sales_sum"
    " FROM panel GROUP BY 1, 2)"
)


@query(
    "demand_history_category",
    with_lines(
        _CATEGORY + " SELECT category_name, order_date, "
        + ", ".join(
            _window_sql("category_quantity_sold", "category_name", demand.GROUP_LAGS, "", False, 3)
            + _window_sql("category_sales_sum", "category_name", demand.GROUP_LAGS, "", False, 3)
        )
        + " FROM catday"
    ),
)
def demand_history_category(spark, folder):
    panel, features = demand.demand_panel(order_lines(spark, folder, ROLES))
    mine = [f for f in features if f.startswith("category_")]
    return rounded(panel.select("category_name", "order_date", *mine), 3, off_tie=mine).distinct()


@query(
    "demand_history_global",
    with_lines(
        _PANEL + ", day AS (SELECT order_date, sum(quantity_sold) AS global_quantity_sold FROM panel GROUP BY 1) SELECT order_date, "
        + ", ".join(_window_sql("global_quantity_sold", "", demand.GROUP_LAGS, "", False, 3))
        + " FROM day"
    ),
)
def demand_history_global(spark, folder):
    panel, features = demand.demand_panel(order_lines(spark, folder, ROLES))
    mine = [f for f in features if f.startswith("global_")]
    return rounded(panel.select("order_date", *mine), 3, off_tie=mine).distinct()


_RULES = _PANEL + (
    ", h AS (SELECT product, order_date, quantity_sold, lag(quantity_sold) OVER w AS l1,"
    " avg(quantity_sold) OVER (PARTITION BY product ORDER BY order_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS r7,"
    " avg(quantity_sold) OVER (PARTITION BY product ORDER BY order_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS r30"
    " FROM panel WINDOW w AS (PARTITION BY product ORDER BY order_date)),"
    f" g AS (SELECT avg(quantity_sold) AS gm FROM panel WHERE order_date < DATE '{TEST_START}'),"
    f" pm AS (SELECT product, avg(quantity_sold) AS m FROM panel WHERE order_date < DATE '{TEST_START}' GROUP BY 1),"
    " pred AS (SELECT h.product, order_date, quantity_sold AS actual, gm AS global_mean, coalesce(m, gm) AS product_mean,"
    " coalesce(l1, gm) AS lag_1d, coalesce(r7, gm) AS rolling_7d, coalesce(r30, gm) AS rolling_30d"
    f" FROM h CROSS JOIN g LEFT JOIN pm ON pm.product = h.product WHERE order_date >= DATE '{TEST_START}'),"
    " long AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS model, actual AS y, {col} AS p FROM pred" for name, col in demand.RULES.items())
    + ")"
)


def predictions(spark, folder):
    """Rule predictions; train means and test rows read the same staged slice of the panel."""
    history = [f"product_quantity_sold_{h}" for h in ("lag_1d", "roll_mean_7d", "roll_mean_30d")]
    panel = stage(panel_of(spark, folder).select("product", "order_date", "quantity_sold", *history))
    return demand.rule_predictions(panel, TEST_START)


@query(
    "demand_rule_predictions",
    with_lines(
        _RULES + " SELECT product, order_date, actual, round(global_mean, 6) AS global_mean, round(product_mean, 6) AS product_mean,"
        " round(lag_1d, 6) AS lag_1d, round(rolling_7d, 6) AS rolling_7d, round(rolling_30d, 6) AS rolling_30d FROM pred"
    ),
)
def demand_rule_predictions(spark, folder):
    return rounded(predictions(spark, folder))


@query("demand_rule_scores", with_lines(_RULES + " " + metric_sql("long", "model")))
def demand_rule_scores(spark, folder):
    long = demand.long_rule_predictions(stage(predictions(spark, folder)))
    return scores(evaluate(stage(long), ["model"]))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in demand.RULE_LABELS.items())


@query(
    "demand_ranked_systems",
    with_lines(
        _RULES + f", s AS ({metric_sql('long', 'model')})"
        f" SELECT model, CASE model {_CASES} END AS system, mae, rmse, r2, wape FROM s"
    ),
)
def demand_ranked_systems(spark, folder):
    long = demand.long_rule_predictions(stage(predictions(spark, folder)))
    ranked = demand.rank_systems(evaluate(long, ["model"], median=False))
    return rounded(ranked.select("model", "system", "mae", "rmse", "r2", "wape"))


@query(
    "demand_rule_gap",
    with_lines(
        _RULES + ", s AS (SELECT model, avg(abs(y - p)) AS mae FROM long GROUP BY 1),"
        " r AS (SELECT * FROM s WHERE model LIKE 'Baseline rolling%' ORDER BY mae, model LIMIT 1),"
        " o AS (SELECT * FROM s WHERE model NOT LIKE 'Baseline rolling%' ORDER BY mae, model LIMIT 1)"
        " SELECT r.model AS best_rule, round(r.mae, 6) AS rule_error, o.model AS best_model, round(o.mae, 6) AS model_error,"
        " round(o.mae - r.mae, 6) AS gap, round((o.mae - r.mae) / r.mae, 6) AS gap_pct FROM r, o"
    ),
)
def demand_rule_gap(spark, folder):
    """How far the other rules are behind the best rolling rule."""
    long = demand.long_rule_predictions(stage(predictions(spark, folder)))
    return rounded(best_gap(evaluate(long, ["model"], median=False), prefix="Baseline rolling"))


_MONTHLY = _PANEL + (
    ", h AS (SELECT order_date, quantity_sold, coalesce(avg(quantity_sold) OVER (PARTITION BY product ORDER BY order_date"
    " ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS r7 FROM panel),"
    " monthly AS (SELECT strftime(order_date, '%Y-%m') AS month, sum(quantity_sold) AS actual_quantity, sum(r7) AS predicted_quantity,"
    f" count(*) AS n_rows FROM h WHERE order_date >= DATE '{TEST_START}' GROUP BY 1)"
)


@query(
    "demand_monthly_reference",
    with_lines(
        _MONTHLY + " SELECT month, round(actual_quantity, 4) AS actual_quantity, round(predicted_quantity, 4) AS predicted_quantity, n_rows FROM monthly"
    ),
)
def demand_monthly_reference(spark, folder):
    return rounded(demand.monthly_reference(panel_of(spark, folder), TEST_START), 4)


@query(
    "demand_total_gap",
    with_lines(
        _MONTHLY + " SELECT round(sum(actual_quantity), 4) AS total_actual, round(sum(predicted_quantity), 4) AS total_predicted,"
        " round(sum(predicted_quantity) - sum(actual_quantity), 4) AS total_gap,"
        " round((sum(predicted_quantity) - sum(actual_quantity)) / sum(actual_quantity), 8) AS total_gap_pct FROM monthly"
    ),
)
def demand_total_gap(spark, folder):
    return rounded(demand.total_gap(demand.monthly_reference(panel_of(spark, folder), TEST_START)), 4, total_gap_pct=8)
