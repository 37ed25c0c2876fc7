"""Queries on temporal splits, walk-forward validation and error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadline.catalog.demand import metric_sql, predictions, scores
from leadline.catalog.history import _HISTORY, TIE, history_lines
from leadline.catalog.registry import LINE_KEY_SQL, query, rounded, with_lines
from leadline.functions.dates import month_label
from leadline.operators import aggregate as agg
from leadline.operators import metrics
from leadline.operators.joins import lookup_mean
from leadline.operators.split import date_split, share_split
from leadline.plans import arrival, walk_forward
from leadline.session import stage
from leadline.sources.tables import LINE_KEY, order_lines, read_table

ORDER = ["order_ts", *LINE_KEY]
_SPLIT = (
    f", ranked AS (SELECT *, row_number() OVER (ORDER BY order_ts, {LINE_KEY_SQL}) AS i, count(*) OVER () AS n FROM lines),"
    " sp AS (SELECT *, CASE WHEN i <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ranked)"
)


@query(
    "split_by_share",
    with_lines(
        _SPLIT + " SELECT split, count(*) AS n, min(order_ts) AS first_ts, max(order_ts) AS last_ts, round(sum(sales), 2) AS sales FROM sp GROUP BY 1"
    ),
)
def split_by_share(spark, folder):
    rows = share_split(stage(order_lines(spark, folder, ORDER)), ORDER)
    out = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("order_ts").alias("first_ts"), F.max("order_ts").alias("last_ts"), F.sum("sales").alias("sales")
    )
    return rounded(out, 2)


@query(
    "split_by_date",
    "SELECT CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY 1",
)
def split_by_date(spark, folder):
    rows = date_split(read_table(spark, folder, "orders"), "o_orderdate", F.lit("2000-01-01").cast("timestamp_ntz"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_SALES_RULES = _SPLIT + (
    ", gm AS (SELECT avg(sales) AS g FROM sp WHERE split = 'train'), pm AS (SELECT product, avg(sales) AS m FROM sp WHERE split = 'train' GROUP BY 1),"
    " pred AS (SELECT split, sales AS y, g, coalesce(m, g) AS m FROM sp CROSS JOIN gm LEFT JOIN pm ON pm.product = sp.product),"
    " long AS (SELECT 'Baseline global mean' AS model, split, y, g AS p FROM pred UNION ALL SELECT 'Baseline mean by Product', split, y, m FROM pred)"
)


def sales_rules(spark, folder):
    rows = share_split(stage(order_lines(spark, folder, [*ORDER, "product"])), ORDER)
    train = rows.filter(F.col("split") == "train")
    wide = lookup_mean(rows, train, "product", "sales", walk_forward.PRODUCT_RULE)
    wide = wide.withColumn(walk_forward.GLOBAL_RULE, train.agg(F.avg("sales")).scalar()).withColumn("actual", F.col("sales"))
    return wide.unpivot(
        ["order_id", "split", "actual"], [walk_forward.GLOBAL_RULE, walk_forward.PRODUCT_RULE], "model", "predicted"
    )


@query("sales_rule_scores", with_lines(_SALES_RULES + " " + metric_sql("long", "model, split")))
def sales_rule_scores(spark, folder):
    return scores(metrics.evaluate(stage(sales_rules(spark, folder)), ["model", "split"]))


_MONTH = (
    ", mm AS (SELECT strftime(order_ts, '%Y-%m') AS month, sum(sales) AS s, count(*) AS n FROM lines GROUP BY 1),"
    " mi AS (SELECT month, row_number() OVER (ORDER BY month) AS idx, n FROM mm),"
    " folds AS (SELECT idx - 12 AS fold, month FROM mi WHERE idx > 12)"
)
# A fold's training rows are re-read here: the plain definition of an expanding window.
_WALK = _MONTH + (
    ", byp AS (SELECT strftime(order_ts, '%Y-%m') AS month, product, sum(sales) AS s, count(*) AS n FROM lines GROUP BY 1, 2),"
    " fg AS (SELECT f.fold, sum(m.s) / sum(m.n) AS g FROM folds f JOIN mm m ON m.month < f.month GROUP BY 1),"
    " fp AS (SELECT f.fold, product, sum(b.s) / sum(b.n) AS m FROM folds f JOIN byp b ON b.month < f.month GROUP BY 1, 2),"
    " pred AS (SELECT f.fold, f.month, l.sales AS y, g, coalesce(m, g) AS m FROM lines l JOIN folds f ON f.month = strftime(l.order_ts, '%Y-%m')"
    " JOIN fg ON fg.fold = f.fold LEFT JOIN fp ON fp.fold = f.fold AND fp.product = l.product),"
    " wlong AS (SELECT 'Baseline global mean' AS model, fold, month, y, g AS p FROM pred"
    " UNION ALL SELECT 'Baseline mean by Product', fold, month, y, m FROM pred)"
)
_FROZEN = (
    ", early AS (SELECT * FROM lines WHERE strftime(order_ts, '%Y-%m') IN (SELECT month FROM mi WHERE idx <= 12)),"
    " zg AS (SELECT avg(sales) AS g FROM early), zp AS (SELECT product, avg(sales) AS m FROM early GROUP BY 1),"
    " zpred AS (SELECT f.fold, f.month, l.sales AS y, g, coalesce(m, g) AS m FROM lines l JOIN folds f ON f.month = strftime(l.order_ts, '%Y-%m')"
    " CROSS JOIN zg LEFT JOIN zp ON zp.product = l.product),"
    " zlong AS (SELECT 'Baseline global mean' AS model, fold, month, y, g AS p FROM zpred"
    " UNION ALL SELECT 'Baseline mean by Product', fold, month, y, m FROM zpred)"
)


def month_lines(spark, folder):
    lines = order_lines(spark, folder, ["order_ts", "sales", "product"])
    return stage(lines.select(month_label("order_ts").alias("month"), "sales", "product"))


@query("walk_forward_scores", with_lines(_WALK + " " + metric_sql("wlong", "model, fold, month")))
def walk_forward_scores(spark, folder):
    pred = walk_forward.walk_forward_rules(month_lines(spark, folder), "month", "sales", "product")
    return scores(walk_forward.month_scores(stage(pred), "month").withColumn("fold", F.col("fold").cast("long")))


@query(
    "walk_forward_folds",
    with_lines(
        _MONTH + " SELECT f.fold, min(m.month) AS train_month_start, max(m.month) AS train_month_end, f.month AS test_month,"
        " CAST(sum(m.n) AS BIGINT) AS train_rows, t.n AS test_rows FROM folds f JOIN mi m ON m.month < f.month JOIN mi t ON t.month = f.month"
        " GROUP BY f.fold, f.month, t.n"
    ),
)
def walk_forward_folds(spark, folder):
    lines = order_lines(spark, folder, ["order_ts"]).select(month_label("order_ts").alias("month"))
    return walk_forward.training_rows(lines, "month").withColumn("fold", F.col("fold").cast("long"))


@query(
    "walk_forward_summary",
    with_lines(
        _WALK + ", one AS (SELECT * FROM wlong WHERE model = 'Baseline mean by Product'),"
        " pf AS (SELECT fold, avg(abs(y - p)) AS mae, sum(abs(y - p)) / sum(abs(y)) AS wape FROM one GROUP BY 1)"
        " SELECT count(*) AS test_rows, round(avg(abs(y - p)), 6) AS weighted_mae, round(avg((y - p) * (y - p)), 2) AS weighted_mse,"
        " round(sqrt(avg((y - p) * (y - p))), 6) AS global_rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS global_r2,"
        " round(sum(abs(y - p)) / sum(abs(y)), 6) AS global_wape, round(avg(abs((y - p) / y)), 6) AS global_mape,"
        " (SELECT count(*) FROM pf) AS folds, round((SELECT avg(mae) FROM pf), 6) AS mean_fold_mae,"
        " round((SELECT median(mae) FROM pf), 6) AS median_fold_mae, round((SELECT avg(wape) FROM pf), 6) AS mean_fold_wape FROM one"
    ),
)
def walk_forward_summary(spark, folder):
    pred = walk_forward.walk_forward_rules(month_lines(spark, folder), "month", "sales", "product")
    one = pred.filter(F.col("model") == walk_forward.PRODUCT_RULE)
    return rounded(metrics.fold_summary(one, "fold"), weighted_mse=2)


@query(
    "walk_forward_monthly_totals",
    with_lines(
        _WALK + " SELECT model, month, round(sum(y), 2) AS actual_sales, round(sum(p), 2) AS predicted_sales, count(*) AS n_rows FROM wlong GROUP BY 1, 2"
    ),
)
def walk_forward_monthly_totals(spark, folder):
    pred = walk_forward.walk_forward_rules(month_lines(spark, folder), "month", "sales", "product")
    out = agg.summarise(
        pred, ["model", "month"],
        {"actual_sales": F.sum("actual"), "predicted_sales": F.sum("predicted"), "n_rows": F.count(F.lit(1))},
    )
    return rounded(out, 2)


@query("frozen_rule_scores", with_lines(_MONTH + _FROZEN + " " + metric_sql("zlong", "model, fold, month")))
def frozen_rule_scores(spark, folder):
    pred = walk_forward.frozen_rules(month_lines(spark, folder), "month", "sales", "product")
    return scores(walk_forward.month_scores(stage(pred), "month").withColumn("fold", F.col("fold").cast("long")))


_COMPARE = _WALK + _FROZEN + (
    f", w AS ({metric_sql('wlong', 'model, fold, month')}), z AS ({metric_sql('zlong', 'model, fold, month')}),"
    " ew AS (SELECT model, month, avg(abs(y - p)) AS mae FROM wlong GROUP BY 1, 2), ez AS (SELECT model, fold, month, avg(abs(y - p)) AS mae FROM zlong GROUP BY 1, 2, 3),"
    " cmp AS (SELECT ez.model, ez.month, ez.fold AS month_index_after_train, ez.mae AS static_mae, ew.mae AS walk_forward_mae,"
    " ez.mae - ew.mae AS gap, ez.mae / ew.mae AS ratio FROM ez LEFT JOIN ew ON ez.model = ew.model AND ez.month = ew.month)"
)


def _comparison(spark, folder):
    lines = month_lines(spark, folder)
    both = [
        metrics.evaluate(rules(lines, "month", "sales", "product"), ["model", "fold", "month"], median=False)
        for rules in (walk_forward.frozen_rules, walk_forward.walk_forward_rules)
    ]
    return walk_forward.compare_frozen(both[0], both[1], "month")


@query(
    "frozen_versus_walk_forward",
    with_lines(
        _COMPARE + " SELECT model, month, month_index_after_train, round(static_mae, 6) AS static_mae, round(walk_forward_mae, 6) AS walk_forward_mae,"
        " round(gap, 6) AS mae_gap_static_minus_walk, round(ratio, 6) AS mae_ratio_static_vs_walk, ratio > 1.10 AS degraded_over_10pct,"
        " gap > 2.0 AS degraded_over_abs_threshold, z.rmse AS static_rmse, z.r2 AS static_r2, z.wape AS static_wape,"
        " z.mape_nonzero_actual AS static_mape_nonzero_actual, w.rmse AS walk_forward_rmse, w.r2 AS walk_forward_r2, w.wape AS walk_forward_wape,"
        " w.mape_nonzero_actual AS walk_forward_mape_nonzero_actual FROM cmp JOIN z USING (model, month) JOIN w USING (model, month)"
    ),
)
def frozen_versus_walk_forward(spark, folder):
    return rounded(_comparison(spark, folder)).withColumn("month_index_after_train", F.col("month_index_after_train").cast("long"))


@query(
    "frozen_stable_months",
    with_lines(
        _COMPARE + " SELECT model, min(month_index_after_train) FILTER (WHERE ratio > 1.10) AS degraded_over_10pct_index,"
        " min(month) FILTER (WHERE ratio > 1.10) AS degraded_over_10pct_month,"
        " min(month_index_after_train) FILTER (WHERE gap > 2.0) AS degraded_over_abs_threshold_index,"
        " min(month) FILTER (WHERE gap > 2.0) AS degraded_over_abs_threshold_month,"
        " arg_max(month, gap) AS worst_month, round(max(gap), 6) AS worst_gap,"
        " min(month_index_after_train) FILTER (WHERE gap > 2.0) - 1 AS stable_months FROM cmp GROUP BY 1"
    ),
)
def frozen_stable_months(spark, folder):
    out = walk_forward.stable_months(_comparison(spark, folder), "month")
    index = [c for c in out.columns if c.endswith("_index")] + ["stable_months"]
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in index}))


_ARRIVAL = _HISTORY + _SPLIT + (
    ", tm AS (SELECT shipping_mode, avg(actual_days) AS m FROM sp WHERE split = 'train' GROUP BY 1),"
    " tg AS (SELECT avg(actual_days) AS g FROM sp WHERE split = 'train'),"
    " full_mean AS (SELECT pos.m, pos.t, c0.cv / nullif(c0.r, 0) AS e FROM pos JOIN cum c0 ON c0.m = pos.m AND c0.r = p0),"
    " pred AS (SELECT sp.shipping_mode, split, CAST(actual_days AS DOUBLE) AS y, CAST(promised_days AS DOUBLE) AS cur, coalesce(tm.m, g) AS md,"
    " coalesce(e, g) AS ao FROM sp CROSS JOIN tg LEFT JOIN tm ON tm.shipping_mode = sp.shipping_mode"
    " LEFT JOIN full_mean ON full_mean.m = sp.shipping_mode AND full_mean.t = sp.order_ts),"
    f" long AS (SELECT '{arrival.CURRENT}' AS model, shipping_mode, split, y, cur AS p FROM pred"
    f" UNION ALL SELECT '{arrival.BY_MODE}', shipping_mode, split, y, md FROM pred UNION ALL SELECT '{arrival.AS_OF}', shipping_mode, split, y, ao FROM pred)"
)
_DAYS = (
    ", round(avg(CAST(round_even(greatest(p, 0), 0) = y AS DOUBLE)), 6) AS exact_day_accuracy_rounded,"
    " round(avg(CAST(abs(y - p) <= 1 AS DOUBLE)), 6) AS within_1_day_accuracy"
)


def arrival_wide(spark, folder):
    rows = arrival.arrival_rows(history_lines(spark, folder))
    rows = stage(arrival.with_mode_history(share_split(rows, ORDER), TIE))
    return arrival.arrival_rules(rows, ["order_id", "line_no", "shipping_mode"])


@query("arrival_rule_scores", with_lines(_ARRIVAL + " " + metric_sql("long", "model, split", _DAYS)))
def arrival_rule_scores(spark, folder):
    long = arrival.long_rules(arrival_wide(spark, folder), ["shipping_mode"])
    return scores(arrival.arrival_scores(stage(long)))


def _test_residuals(spark, folder):
    wide = arrival_wide(spark, folder).filter(F.col("split") == "test")
    return metrics.residuals_long(wide, ["order_id", "line_no", "shipping_mode"], [arrival.CURRENT, arrival.BY_MODE, arrival.AS_OF])


@query(
    "arrival_residual_summary",
    with_lines(
        _ARRIVAL + " SELECT model, shipping_mode, count(*) AS n_rows, round(avg(abs(y - p)), 6) AS mae, round(avg(y - p), 6) AS residual_mean,"
        " round(stddev_samp(y - p), 6) AS residual_std_samp, round(stddev_pop(y - p), 6) AS residual_std_pop,"
        " round(quantile_cont(y - p, 0.5), 6) AS residual_median FROM long WHERE split = 'test' GROUP BY 1, 2"
    ),
)
def arrival_residual_summary(spark, folder):
    return rounded(metrics.residual_summary(stage(_test_residuals(spark, folder)), ["model", "shipping_mode"]))


@query(
    "arrival_residual_histogram",
    with_lines(
        _ARRIVAL + f", e AS (SELECT y - p AS x FROM long WHERE split = 'test' AND model = '{arrival.CURRENT}'),"
        " lim AS (SELECT min(x) AS lo, max(x) AS hi FROM e)"
        " SELECT CAST(least(floor((x - lo) / ((hi - lo) / 35)), 34) AS BIGINT) AS bin, count(*) AS n,"
        " round(any_value(lo) + least(floor((any_value(x) - any_value(lo)) / ((any_value(hi) - any_value(lo)) / 35)), 34)"
        " * ((any_value(hi) - any_value(lo)) / 35), 6) AS bin_low FROM e, lim GROUP BY 1"
    ),
)
def arrival_residual_histogram(spark, folder):
    current = _test_residuals(spark, folder).filter(F.col("model") == arrival.CURRENT)
    return rounded(agg.histogram(current, "residual", 35))


@query(
    "arrival_improvement",
    with_lines(
        _ARRIVAL + ", s AS (SELECT model, avg(abs(y - p)) AS mae FROM long WHERE split = 'test' GROUP BY 1)"
        f" SELECT a.model, round(b.mae - a.mae, 6) AS saved, CASE WHEN b.mae - a.mae > 0.02 THEN 'improves'"
        f" WHEN b.mae - a.mae < -0.02 THEN 'worsens' ELSE 'no clear change' END AS verdict FROM s a, s b WHERE b.model = '{arrival.CURRENT}'"
    ),
)
def arrival_improvement(spark, folder):
    """Error saved by each rule against the stated promise."""
    by_model = _test_residuals(spark, folder).groupBy("model").agg(F.avg("absolute_error").alias("mae"))
    base = by_model.filter(F.col("model") == arrival.CURRENT).select("mae").scalar()
    saved = base - F.col("mae")
    return rounded(by_model.select("model", saved.alias("saved"), metrics.improvement_flag(saved).alias("verdict")))


@query("demand_residual_histogram")
def demand_residual_histogram(spark, folder):
    pred = predictions(spark, folder)
    return rounded(agg.histogram(pred.select((F.col("actual") - F.col("rolling_7d")).alias("residual")), "residual", 45))
