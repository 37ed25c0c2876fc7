"""Queries that fit models, and the encodings they learn.

The tree models are those of the specs, in number, depth and rounds, on all rows. Two queries that hold one tree
against other models fit it at depth 6 (``shallow``).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from leadline.catalog.demand import ROLES as DEMAND_ROLES
from leadline.catalog.demand import TEST_START
from leadline.catalog.history import GRAINS, LAGS, TIE, WINDOWS
from leadline.catalog.registry import query, rounded, with_lines
from leadline.catalog.validation import _SPLIT
from leadline.functions import dates
from leadline.functions.labels import has_discount
from leadline.operators import metrics, models
from leadline.operators.cross_products import optimality_gaps
from leadline.operators.expanding_ols import expanding_least_squares
from leadline.operators.extra_trees import ForestParams, fit_extra_trees
from leadline.operators.features import INFREQUENT, Encoding, fit_encoding
from leadline.operators.grain_history import add_daily_history, feature_names
from leadline.operators.hist_boosting import BoostParams, fit_boosting
from leadline.operators.split import date_split, share_split
from leadline.plans import arrival, demand, walk_forward
from leadline.session import stage
from leadline.sources.sinks import stack
from leadline.sources.tables import LINE_KEY, order_lines

CATEGORICAL = ["shipping_mode", "country", "city", "market", "segment", "category", "department", "product", "payment_type"]
ARRIVAL_NUMBERS = ["quantity", "order_month", "order_dayofweek", "order_hour"]
SALES_TEXT = ["country", "city", "market", "segment", "category", "department", "product", "calendar_period"]
SALES_NUMBERS = [
    "price", "quantity", "discount_rate", "order_year", "order_month", "order_day", "order_dayofweek", "order_dayofyear",
    "order_weekofyear", "order_quarter", "order_is_weekend", "order_month_sin", "order_month_cos", "order_dayofweek_sin",
    "order_dayofweek_cos", "is_generic_fixed_holiday", "has_discount",
]
ORDER = ["order_ts", *LINE_KEY]


def shallow(spec: models.ModelSpec) -> models.ModelSpec:
    """A single MLlib tree of depth 6, where a query compares it with others only; its other models stay as they are."""
    p = spec.params
    if "max_depth" not in p:
        return spec
    return replace(spec, family="tree", params={"max_depth": min(p["max_depth"], 6), "min_leaf": p["min_leaf"]})


def _arrival_lines(spark, folder, history=False):
    roles = [*CATEGORICAL, "order_ts", "shipping_ts", "actual_days", "promised_days", *LINE_KEY]
    lines = arrival.arrival_rows(order_lines(spark, folder, roles))
    return arrival.with_mode_history(stage(lines), TIE) if history else lines


def _arrival_scores(spark, folder, specs, history=False):
    pred, _ = arrival.arrival_models(_arrival_lines(spark, folder, history), ORDER, specs, ["order_id"])
    return arrival.arrival_scores(stage(pred))


@query("arrival_linear_scores")
def arrival_linear_scores(spark, folder):
    specs = models.arrival_specs(CATEGORICAL, ARRIVAL_NUMBERS)
    return _arrival_scores(spark, folder, [s for s in specs if s.encoding.kind == "onehot"])


@query("arrival_tree_scores")
def arrival_tree_scores(spark, folder):
    specs = models.arrival_specs(CATEGORICAL, ARRIVAL_NUMBERS)
    return _arrival_scores(spark, folder, [s for s in specs if s.encoding.kind == "ordinal"])


@query("arrival_forest_grid")
def arrival_forest_grid(spark, folder):
    specs = models.forest_grid(CATEGORICAL, ARRIVAL_NUMBERS)
    return _arrival_scores(spark, folder, specs).orderBy("split", "mae")


BOOSTED = ["quantity", "discount_rate", "order_month", "order_dayofweek", "line_no"]
BOOST = BoostParams(iterations=3, rate=0.5, max_leaves=31, max_depth=3, min_leaf=50, l2=1.0)


def _boosting_sql() -> str:
    """The training itself in SQL: per level, gradients summed by node, feature and value, and the best cut of each node."""
    p = BOOST
    steps = [
        ", raw AS (SELECT *, month(order_ts)::DOUBLE AS order_month, (isodow(order_ts) - 1)::DOUBLE AS order_dayofweek FROM sp)",
        "rows AS MATERIALIZED (SELECT row_number() OVER () AS id, split, sales AS y, order_id, line_no AS line,"
        + ", ".join(f"{f}::DOUBLE AS {f}" for f in BOOSTED)
        + " FROM raw)",
        "p0 AS MATERIALIZED (SELECT *, (SELECT avg(y) FROM rows WHERE split = 'train') AS p FROM rows)",
    ]
    for t in range(p.iterations):
        steps.append(f"t{t}_0 AS MATERIALIZED (SELECT *, 0 AS node FROM p{t})")
        for d in range(p.max_depth):
            at = f"{t}_{d}"
            cells = " UNION ALL ".join(
                f"SELECT node, {k} AS f, {f} AS v, sum(p - y) AS g, count(*) AS n FROM t{at} WHERE split = 'train' GROUP BY node, {f}"
                for k, f in enumerate(BOOSTED)
            )
            steps.append(
                f"c{at} AS MATERIALIZED (SELECT *, sum(g) OVER w AS lg, sum(n) OVER w AS ln, sum(g) OVER (PARTITION BY node, f) AS ag,"
                f" sum(n) OVER (PARTITION BY node, f) AS an FROM ({cells}) WINDOW w AS (PARTITION BY node, f ORDER BY v))"
            )
            # Gains within a billionth of each other count as equal, whatever the order of the sums.
            steps.append(
                f"b{at} AS MATERIALIZED (SELECT node, f, v FROM (SELECT *, lg * lg / (ln + {p.l2}) + (ag - lg) * (ag - lg) / (an - ln + {p.l2})"
                f" - ag * ag / (an + {p.l2}) AS gain FROM c{at} WHERE ln >= {p.min_leaf} AND an - ln >= {p.min_leaf}) WHERE gain > 0"
                " QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1)"
            )
            value = "CASE b.f " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(BOOSTED)) + " END"
            steps.append(
                f"t{t}_{d + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN r.node WHEN {value} <= b.v"
                f" THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node FROM t{at} r LEFT JOIN b{at} b ON r.node = b.node)"
            )
        last = f"t{t}_{p.max_depth}"
        steps.append(
            f"l{t} AS MATERIALIZED (SELECT node, -{p.rate} * sum(p - y) / (count(*) + {p.l2}) AS step FROM {last} WHERE split = 'train' GROUP BY node)"
        )
        steps.append(f"p{t + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node, p), p + step AS p FROM {last} r JOIN l{t} ON r.node = l{t}.node)")
    return _SPLIT + ", ".join(steps) + f" SELECT split, order_id, line AS line_no, round(y, 2) AS actual, round(p, 4) AS predicted FROM p{p.iterations}"


@query("hist_boosting_predictions", with_lines(_boosting_sql()))
def hist_boosting_predictions(spark, folder):
    """Three rounds of histogram boosting on all train lines; the SQL trains the same trees by itself."""
    rows = _boosted_lines(spark, folder)
    return _predicted_sales(fit_boosting(rows.filter(F.col("split") == "train"), BOOSTED, "sales", BOOST), rows)


def _boosted_lines(spark, folder):
    lines = order_lines(spark, folder, ["sales", *ORDER]).withColumns(
        {"order_month": F.month("order_ts"), "order_dayofweek": dates.weekday("order_ts")}
    )
    return share_split(stage(lines), ORDER)


def _predicted_sales(model, rows):
    scored = model.predict(rows.select("split", "order_id", "sales", *BOOSTED))
    return rounded(scored.select("split", "order_id", "line_no", F.col("sales").alias("actual"), "predicted"), 4, actual=2)


FOREST = ForestParams(trees=4, max_depth=4, min_leaf=60)


def _forest_sql() -> str:
    """Randomised trees in SQL: per level the ranges, the hashed draws between them, and the best feature of each node."""
    p = FOREST
    steps = [
        ", raw AS (SELECT *, month(order_ts)::DOUBLE AS order_month, (isodow(order_ts) - 1)::DOUBLE AS order_dayofweek FROM sp)",
        "t0 AS MATERIALIZED (SELECT tree, 0::BIGINT AS node, i AS id, split, sales AS y, order_id, line_no AS line, "
        + ", ".join(f"{f}::DOUBLE AS {f}" for f in BOOSTED)
        + f" FROM raw, range({p.trees}) AS g(tree))",
    ]
    for d in range(p.max_depth):
        spans = " UNION ALL ".join(
            f"SELECT tree, node, {k} AS f, min({f}) AS lo, max({f}) AS hi, count(*) AS n, sum(y) AS s, max(y) > min(y) AS open"
            f" FROM t{d} WHERE split = 'train' GROUP BY tree, node"
            for k, f in enumerate(BOOSTED)
        )
        draw = f"('0x' || substr(md5('{p.seed}:' || tree || ':' || node || ':' || f), 1, 13))::BIGINT / {1 << 52}::DOUBLE"
        steps.append(f"c{d} AS MATERIALIZED (SELECT *, lo + {draw} * (hi - lo) AS cut FROM ({spans}) WHERE lo < hi AND open)")
        sums = " UNION ALL ".join(
            f"SELECT tree, node, {k} AS f, count(*) AS ln, sum(y) AS ls FROM t{d} r JOIN c{d} c USING (tree, node)"
            f" WHERE f = {k} AND split = 'train' AND {f} <= cut GROUP BY tree, node"
            for k, f in enumerate(BOOSTED)
        )
        steps.append(
            f"b{d} AS MATERIALIZED (SELECT tree, node, f, cut FROM c{d} JOIN ({sums}) USING (tree, node, f)"
            f" WHERE ln >= {p.min_leaf} AND n - ln >= {p.min_leaf} QUALIFY row_number() OVER ("
            "PARTITION BY tree, node ORDER BY ls * ls / ln + (s - ls) * (s - ls) / (n - ln) DESC, f) = 1)"
        )
        value = "CASE b.f " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(BOOSTED)) + " END"
        steps.append(
            f"t{d + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN r.node WHEN {value} <= b.cut"
            f" THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node FROM t{d} r LEFT JOIN b{d} b ON r.tree = b.tree AND r.node = b.node)"
        )
    last = f"t{p.max_depth}"
    return (
        _SPLIT + ", ".join(steps) + f" SELECT split, order_id, line AS line_no, round(y, 2) AS actual, round(avg(mean), 4) AS predicted"
        f" FROM {last} JOIN (SELECT tree, node, avg(y) AS mean FROM {last} WHERE split = 'train' GROUP BY tree, node) USING (tree, node)"
        " GROUP BY id, split, order_id, line, y"
    )


@query("extra_trees_predictions", with_lines(_forest_sql()))
def extra_trees_predictions(spark, folder):
    """Randomised trees on all train lines; the SQL grows the same trees from the same hashed draws."""
    rows = _boosted_lines(spark, folder)
    model = fit_extra_trees(rows.filter(F.col("split") == "train"), BOOSTED, "sales", FOREST)
    return _predicted_sales(model, rows)


def _history_forest():
    return models.forest_grid(CATEGORICAL, ARRIVAL_NUMBERS + arrival.HISTORY)[0]


@query("arrival_history_forest_scores")
def arrival_history_forest_scores(spark, folder):
    return _arrival_scores(spark, folder, [_history_forest()], history=True)


@query("arrival_history_importance")
def arrival_history_importance(spark, folder):
    spec = _history_forest()
    _, fitted = arrival.arrival_models(_arrival_lines(spark, folder, True), ORDER, [spec], ["order_id"])
    return models.only_features(models.tree_importance(fitted[spec.name]), arrival.HISTORY)


@query("arrival_predictions_wide")
def arrival_predictions_wide(spark, folder):
    """One row per test line, one column per model."""
    specs = [s for s in models.arrival_specs(CATEGORICAL, ARRIVAL_NUMBERS) if s.family in ("linear", "ridge")]
    pred, _ = arrival.arrival_models(_arrival_lines(spark, folder), ORDER, specs, [*LINE_KEY, "shipping_mode"])
    cells = [F.max(F.when(F.col("model") == s.name, F.col("predicted"))).alias(s.name) for s in specs]
    test = pred.filter(F.col("split") == "test")
    return test.groupBy(*LINE_KEY, "shipping_mode", "actual").agg(*cells)


def _sales_lines(spark, folder):
    roles = ["country", "city", "market", "segment", "category", "department", "product", "customer_id", "price", "discount", *ORDER]
    lines = order_lines(spark, folder, roles)
    return lines.withColumns(
        {
            "order_date": F.to_date("order_ts"),
            "month": dates.month_label("order_ts"),
            **dates.calendar_columns("order_ts"),
            "calendar_period": dates.calendar_period("order_ts"),
            "is_generic_fixed_holiday": dates.is_fixed_holiday("order_ts").cast("int"),
            "has_discount": has_discount(F.col("discount")).cast("int"),
        }
    )


@query("sales_model_scores")
def sales_model_scores(spark, folder):
    rows = share_split(stage(_sales_lines(spark, folder)), ORDER)
    pred, _ = models.fit_and_score(rows, "sales", models.sales_specs(SALES_TEXT, SALES_NUMBERS), ["order_id"])
    return metrics.evaluate(stage(pred), ["model", "split"])


@query("sales_model_coefficients")
def sales_model_coefficients(spark, folder):
    rows = share_split(stage(_sales_lines(spark, folder)), ORDER)
    spec = models.sales_specs(SALES_TEXT, SALES_NUMBERS)[0]
    _, fitted = models.fit_and_score(rows, "sales", [spec], ["order_id"])
    return models.coefficient_table(fitted[spec.name])


@query("sales_history_model_scores")
def sales_history_model_scores(spark, folder):
    grains = list(GRAINS.values())
    lines = add_daily_history(stage(_sales_lines(spark, folder)), grains, "order_date", "sales", LAGS, WINDOWS)
    rows = share_split(stage(lines), ORDER)
    numbers = SALES_NUMBERS + feature_names(grains, LAGS, WINDOWS)
    wanted = ("Linear Regression with lags", "Decision Tree with lags")
    specs = [shallow(s) for s in models.sales_specs(SALES_TEXT, numbers, " with lags") if s.name in wanted]
    pred, _ = models.fit_and_score(rows, "sales", specs, ["order_id"])
    return metrics.evaluate(stage(pred), ["model", "split"])


DEMAND_TEXT = ["product", "category_name", "department_name", "calendar_period"]
DEMAND_NUMBERS = [
    "order_year", "order_month", "order_day", "order_dayofweek", "order_dayofyear", "order_weekofyear", "order_quarter",
    "order_is_weekend", "order_month_sin", "order_month_cos", "order_dayofweek_sin", "order_dayofweek_cos",
    "is_generic_fixed_holiday", "days_since_product_first_seen",
]


@query("demand_model_gap")
def demand_model_gap(spark, folder):
    """Best simple rule against the best model on the test days."""
    panel, history = demand.demand_panel(stage(order_lines(spark, folder, DEMAND_ROLES)))
    panel = stage(panel)
    rows = date_split(panel, "order_date", F.lit(TEST_START).cast("date"))
    specs = [shallow(s) for s in models.demand_specs(DEMAND_TEXT, DEMAND_NUMBERS + history) if s.family in ("linear", "tree")]
    pred, _ = models.fit_and_score(rows, "quantity_sold", specs, ["product", "order_date"])
    rules = demand.long_rule_predictions(demand.rule_predictions(panel, TEST_START))
    both = pred.filter(F.col("split") == "test").drop("split").unionByName(rules)
    return metrics.best_gap(metrics.evaluate(stage(both), ["model"], median=False))


def _monthly_spec():
    encoding = models.onehot(["market", "segment", "category", "product", "calendar_period"], SALES_NUMBERS, scale="center", unknown_to_pool=True)
    return models.ModelSpec("Linear Regression walk-forward", "linear", encoding)


@query("walk_forward_model_scores")
def walk_forward_model_scores(spark, folder):
    """Every month predicted by a regression on all months before it, in two passes over the lines."""
    rows = stage(_sales_lines(spark, folder))
    pred = expanding_least_squares(rows, "month", "sales", _monthly_spec().encoding, ["order_id"])
    return walk_forward.month_scores(stage(pred), "month")


@query("walk_forward_model_refit_yearly")
def walk_forward_model_refit_yearly(spark, folder):
    """The general form: one pipeline fit per fold, here with twelve test months in each."""
    rows = stage(_sales_lines(spark, folder), "month")
    pred = walk_forward.walk_forward_models(rows, "month", "sales", _monthly_spec(), ["order_id"], step=12, parallelism=4)
    return metrics.evaluate(stage(pred), ["model", "fold"])


@query("frozen_model_versus_walk_forward")
def frozen_model_versus_walk_forward(spark, folder):
    """The regression trained once against the one retrained every month."""
    rows = stage(_sales_lines(spark, folder), "month")
    spec = _monthly_spec()
    walking = expanding_least_squares(rows, "month", "sales", spec.encoding, ["order_id"], name=spec.name)
    frozen = walk_forward.frozen_model(rows, "month", "sales", spec, ["order_id"])
    scores = [metrics.evaluate(stage(p), ["model", "fold", "month"], median=False) for p in (frozen, walking)]
    return walk_forward.compare_frozen(*scores, "month")


@query("frozen_model_scores")
def frozen_model_scores(spark, folder):
    rows = stage(_sales_lines(spark, folder), "month")
    pred = walk_forward.frozen_model(rows, "month", "sales", _monthly_spec(), ["order_id"])
    return walk_forward.month_scores(stage(pred), "month")


# --- optimality of the linear fits ------------------------------------------------------

FIT_TEXT, FIT_NUMBERS = ["shipping_mode", "country", "product"], ["quantity", "discount_rate", "order_month"]


def _optimality_sql() -> str:
    """Every slot of the encoding with its train rows; a fit is optimal if no slot has a gap."""
    sql = _SPLIT + ", train AS (SELECT * FROM sp WHERE split = 'train')"
    slots = [f"SELECT '{c}' AS feature, count(*) AS rows FROM train" for c in FIT_NUMBERS]
    for c in FIT_TEXT:
        slots.append(
            f"SELECT '{c}=' || CASE WHEN k < 20 THEN '{INFREQUENT}' ELSE v END AS feature, sum(k)::BIGINT AS rows"
            f" FROM (SELECT {c} AS v, count(*) AS k FROM train GROUP BY 1) GROUP BY 1"
        )
    models_ = ", ".join(f"('{name}')" for name in ("Linear Regression", "Ridge Regression", "Lasso Regression"))
    return sql + f" SELECT model, feature, rows, 0.0::DOUBLE AS gap FROM (VALUES {models_}) AS m(model), ({' UNION ALL '.join(slots)})"


@query("linear_fit_optimality", with_lines(_optimality_sql()))
def linear_fit_optimality(spark, folder):
    """How far linear, ridge and lasso fits of the delivery time are from their optimum, slot by slot: nowhere."""
    roles = [*FIT_TEXT, "discount_rate", "actual_days", *ORDER]
    lines = order_lines(spark, folder, roles).withColumn("order_month", F.month("order_ts"))
    train = share_split(stage(lines), ORDER).filter(F.col("split") == "train")
    out, encodings, sums = [], {}, {}
    for spec in models.arrival_specs(FIT_TEXT, FIT_NUMBERS):
        if spec.family in ("linear", "ridge", "lasso"):
            encodings.setdefault(spec.encoding, fit_encoding(train, spec.encoding))
            fitted = models.fit_model(train, "actual_days", spec, encodings[spec.encoding], sums)
            # Rounded to a millionth of a day; no negative zeros.
            gaps = optimality_gaps(fitted.model, train, "actual_days").withColumn("gap", F.round("gap", 6) + F.lit(0.0))
            out.append(gaps.select(F.lit(spec.name).alias("model"), "feature", "rows", "gap"))
    return stack(out)


@query(
    "encode_medians",
    with_lines(
        _SPLIT + " SELECT 'quantity' AS feature, median(quantity)::DOUBLE AS fill, 0::BIGINT AS filled FROM sp WHERE split = 'train'"
        " UNION ALL SELECT 'discount', median(CASE WHEN discount_rate > 0.03 THEN discount_rate END),"
        " count(*) FILTER (discount_rate <= 0.03) FROM sp WHERE split = 'train'"
        " UNION ALL SELECT 'price', median(price), count(*) FILTER (price IS NULL) FROM sp WHERE split = 'train'"
    ),
)
def encode_medians(spark, folder):
    """What nulls of the train rows are filled with, and how many there are."""
    lines = order_lines(spark, folder, ["price", *ORDER]).withColumn("discount", F.when(F.col("discount_rate") > 0.03, F.col("discount_rate")))
    names = ["quantity", "discount", "price"]
    train = share_split(stage(lines), ORDER).filter(F.col("split") == "train")
    fills = fit_encoding(train, Encoding((), tuple(names), "ordinal")).medians
    empty = train.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names]).first()
    return spark.createDataFrame([(c, fills[c], empty[c]) for c in names], "feature string, fill double, filled long")


# --- what the encodings learn ----------------------------------------------------------

_TRAIN_CITY = _SPLIT + ", tc AS (SELECT {c} AS v, count(*) AS k FROM sp WHERE split = 'train' GROUP BY 1)"


@query(
    "encode_ordinal",
    with_lines(
        _TRAIN_CITY.format(c="part_id % 700")
        + ", code AS (SELECT v, row_number() OVER (ORDER BY CAST(v AS VARCHAR)) - 1 AS c FROM tc)"
        " SELECT CAST(part_id % 700 AS VARCHAR) AS category, coalesce(CAST(c AS DOUBLE), -1.0) AS code, count(*) AS n"
        " FROM sp LEFT JOIN code ON code.v = part_id % 700 GROUP BY 1, 2"
    ),
)
def encode_ordinal(spark, folder):
    """Alphabetical codes learnt on the train rows; categories they lack become -1."""
    lines = order_lines(spark, folder, ORDER).withColumn("category", (F.col("part_id") % 700).cast("string"))
    rows = share_split(stage(lines), ORDER)
    fitted = fit_encoding(rows.filter(F.col("split") == "train"), Encoding(("category",), ("quantity",), "ordinal"))
    coded = fitted.codes(rows)
    return coded.groupBy("category", F.col("_o_category").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "encode_pooled",
    with_lines(
        _TRAIN_CITY.format(c="part_id")
        + f" SELECT CASE WHEN k < 20 THEN '{INFREQUENT}' ELSE CAST(part_id AS VARCHAR) END AS label, split, count(*) AS n"
        " FROM sp LEFT JOIN tc ON tc.v = part_id GROUP BY 1, 2"
    ),
)
def encode_pooled(spark, folder):
    """Parts with under 20 train rows share one label."""
    lines = order_lines(spark, folder, ORDER).withColumn("label", F.col("part_id").cast("string"))
    rows = share_split(stage(lines), ORDER)
    fitted = fit_encoding(rows.filter(F.col("split") == "train"), Encoding(("label",), ("quantity",), "onehot"))
    pooled = fitted.prepare(rows)
    return pooled.groupBy(F.col("_c_label").alias("label"), "split").agg(F.count(F.lit(1)).alias("n"))
