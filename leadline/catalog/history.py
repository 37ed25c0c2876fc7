"""Queries on leak-free history of shipping modes and of sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadline.catalog.registry import query, rounded, with_lines
from leadline.operators.grain_history import Grain, add_daily_history, daily_history, feature_names
from leadline.operators.profile import coverage
from leadline.plans import arrival
from leadline.session import stage
from leadline.sources.tables import LINE_KEY, order_lines

TIE = LINE_KEY

_HISTORY = """, ev AS (
  SELECT shipping_mode AS m, shipping_ts AS s, actual_days AS v, CAST(delay > 0 AS INTEGER) AS late,
    row_number() OVER (PARTITION BY shipping_mode ORDER BY shipping_ts, order_id, line_no, part_id, supplier_id, quantity, sales, discount_rate, tax) AS r
  FROM lines
), cum AS (
  SELECT m, r, v, sum(v) OVER w AS cv, sum(v * v) OVER w AS cq, sum(late) OVER w AS cl FROM ev WINDOW w AS (PARTITION BY m ORDER BY r)
  UNION ALL SELECT DISTINCT m, 0, NULL, 0, 0, 0 FROM ev
), g AS (SELECT m, s, count(*) AS n FROM ev GROUP BY 1, 2),
og AS (SELECT shipping_mode AS m, order_ts AS t, count(*) AS n FROM lines GROUP BY 1, 2),
pos AS (
  SELECT og.m, og.t, coalesce(sum(g.n) FILTER (WHERE g.s < og.t), 0) AS p0,
    coalesce(sum(g.n) FILTER (WHERE g.s < og.t - INTERVAL 7 DAY), 0) AS p7, coalesce(sum(g.n) FILTER (WHERE g.s < og.t - INTERVAL 30 DAY), 0) AS p30
  FROM og JOIN g ON g.m = og.m GROUP BY 1, 2
), oc AS (
  SELECT a.m, a.t, coalesce(sum(b.n) FILTER (WHERE b.t >= a.t - INTERVAL 7 DAY), 0) AS o7,
    coalesce(sum(b.n) FILTER (WHERE b.t >= a.t - INTERVAL 30 DAY), 0) AS o30, coalesce(sum(b.n) FILTER (WHERE b.t >= a.t - INTERVAL 90 DAY), 0) AS o90
  FROM og a LEFT JOIN og b ON a.m = b.m AND b.t < a.t GROUP BY 1, 2
), feats AS (
  SELECT pos.m, pos.t, CAST(c0.v AS DOUBLE) AS mode_completed_lag1_days,
    round((c0.cv - c7.cv) / nullif(c0.r - c7.r, 0), 6) AS mode_completed_mean_last_7,
    round((c0.cv - c30.cv) / nullif(c0.r - c30.r, 0), 6) AS mode_completed_mean_last_30,
    round((c0.cv - c100.cv) / nullif(c0.r - c100.r, 0), 6) AS mode_completed_mean_last_100,
    round(sqrt(greatest((c0.cq - c30.cq) / nullif(c0.r - c30.r, 0) - pow((c0.cv - c30.cv) / nullif(c0.r - c30.r, 0), 2), 0)
      + CASE WHEN c0.r = c30.r THEN NULL ELSE 0 END), 6) AS mode_completed_std_last_30,
    round((c0.cl - c30.cl) / nullif(c0.r - c30.r, 0), 6) AS mode_completed_late_rate_last_30,
    round(c0.cv / nullif(c0.r, 0), 6) AS mode_completed_expanding_mean,
    round((c0.cv - d7.cv) / nullif(p0 - p7, 0), 6) AS mode_completed_mean_prev_7d,
    round((c0.cv - d30.cv) / nullif(p0 - p30, 0), 6) AS mode_completed_mean_prev_30d,
    round((c0.cl - d30.cl) / nullif(p0 - p30, 0), 6) AS mode_completed_late_rate_prev_30d,
    CAST(p0 - p7 AS BIGINT) AS mode_completed_count_prev_7d, CAST(p0 - p30 AS BIGINT) AS mode_completed_count_prev_30d,
    CAST(o7 AS BIGINT) AS mode_order_count_prev_7d, CAST(o30 AS BIGINT) AS mode_order_count_prev_30d, CAST(o90 AS BIGINT) AS mode_order_count_prev_90d
  FROM pos JOIN oc ON pos.m = oc.m AND pos.t = oc.t JOIN cum c0 ON c0.m = pos.m AND c0.r = p0
    JOIN cum c7 ON c7.m = pos.m AND c7.r = greatest(p0 - 7, 0) JOIN cum c30 ON c30.m = pos.m AND c30.r = greatest(p0 - 30, 0)
    JOIN cum c100 ON c100.m = pos.m AND c100.r = greatest(p0 - 100, 0)
    JOIN cum d7 ON d7.m = pos.m AND d7.r = p7 JOIN cum d30 ON d30.m = pos.m AND d30.r = p30
)"""


def history_lines(spark, folder):
    roles = ["order_ts", "shipping_ts", "shipping_mode", "actual_days", "promised_days", *LINE_KEY]
    return stage(order_lines(spark, folder, roles))


@query(
    "arrival_history_on_lines",
    with_lines(
        _HISTORY + " SELECT order_id, line_no, part_id, " + ", ".join(arrival.HISTORY)
        + " FROM lines LEFT JOIN feats ON lines.shipping_mode = feats.m AND lines.order_ts = feats.t"
    ),
)
def arrival_history_on_lines(spark, folder):
    out = arrival.with_mode_history(history_lines(spark, folder), TIE)
    return rounded(out.select("order_id", "line_no", "part_id", *arrival.HISTORY))


@query(
    "arrival_history_coverage",
    with_lines(
        _HISTORY + ", j AS (SELECT feats.* FROM lines LEFT JOIN feats ON lines.shipping_mode = feats.m AND lines.order_ts = feats.t) "
        + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(count({c}) / count(*), 6) AS coverage FROM j" for c in arrival.HISTORY)
    ),
)
def arrival_history_coverage(spark, folder):
    return rounded(coverage(arrival.with_mode_history(history_lines(spark, folder), TIE), arrival.HISTORY))


LAGS, WINDOWS = [1, 7, 30, 365], [7, 30]
GRAINS = {
    "global": Grain("global"),
    "product": Grain("product", ("product",)),
    "category": Grain("category", ("category",)),
    "country": Grain("country", ("country",)),
    "customer": Grain("customer", ("customer_id",), rolling=False),
}


def _grain_sql(g: Grain, number: str = "") -> str:
    """Daily totals, a generated calendar, shifted self-joins: the long way round, as common tables."""
    keys = list(g.keys)
    sel = "".join(f"{k}, " for k in keys)
    same = lambda a, b: " AND ".join([f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys] + ["true"])
    n = number
    parts = [f", day{n} AS (SELECT {sel}CAST(order_ts AS DATE) AS d, sum(sales) AS s FROM lines GROUP BY ALL)"]
    columns, joins = [], []
    for lag in LAGS:
        joins.append(f" LEFT JOIN day{n} l{lag} ON {same('x', f'l{lag}')} AND l{lag}.d = x.d - {lag}")
        columns.append(f"round(l{lag}.s, 2) AS {g.prefix}_sales_lag_{lag}d")
    if g.rolling:
        by = f"PARTITION BY {', '.join('k.' + k for k in keys)} " if keys else ""
        part = ", ".join(
            f"sum(coalesce(q.s, 0)) OVER ({by}ORDER BY c.d ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS s{w},"
            f" avg(coalesce(q.s, 0)) OVER ({by}ORDER BY c.d ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS m{w}"
            for w in WINDOWS
        )
        ks = ", ".join(keys) or "1 AS one"
        kk = "".join(f"k.{k}, " for k in keys)
        match = " AND ".join([f"k.{k} IS NOT DISTINCT FROM q.{k}" for k in keys] + ["c.d = q.d"])
        parts.append(
            f", roll{n} AS (SELECT {kk}c.d, {part} FROM (SELECT DISTINCT {ks} FROM day{n}) k CROSS JOIN"
            f" (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM day{n}) c LEFT JOIN day{n} q ON {match})"
        )
        joins.append(f" LEFT JOIN roll{n} r ON {same('x', 'r')} AND r.d = x.d")
        for w in WINDOWS:
            columns += [f"round(r.s{w}, 2) AS {g.prefix}_sales_roll_sum_{w}d", f"round(r.m{w} + 3e-7, 4) AS {g.prefix}_sales_roll_mean_{w}d"]
    xs = "".join(f"x.{k}, " for k in keys)
    parts.append(f", grain{n} AS (SELECT {xs}x.d AS order_date, {', '.join(columns)} FROM day{n} x{''.join(joins)})")
    return "".join(parts)


_GRAIN_DIGITS = {f"{p}_sales_roll_mean_{w}d": 4 for p in GRAINS for w in WINDOWS}


def _register(name: str, grain: Grain):
    @query(f"sales_history_{name}", with_lines(_grain_sql(grain) + " SELECT * FROM grain"))
    def run(spark, folder):
        lines = order_lines(spark, folder, ["order_ts", "sales", *grain.keys]).withColumn("order_date", F.to_date("order_ts"))
        return rounded(daily_history(lines, grain, "order_date", "sales", LAGS, WINDOWS), 2, off_tie=list(_GRAIN_DIGITS), **_GRAIN_DIGITS)


for _name, _grain in GRAINS.items():
    _register(_name, _grain)

_ALL = feature_names(list(GRAINS.values()), LAGS, WINDOWS)


@query(
    "sales_history_on_lines",
    with_lines(
        "".join(_grain_sql(g, f"_{name}") for name, g in GRAINS.items())
        + f" SELECT order_id, line_no, part_id, {', '.join(_ALL)} FROM lines "
        + " ".join(
            f"LEFT JOIN grain_{name} AS g_{name} ON CAST(lines.order_ts AS DATE) = g_{name}.order_date"
            + "".join(f" AND lines.{k} IS NOT DISTINCT FROM g_{name}.{k}" for k in g.keys)
            for name, g in GRAINS.items()
        )
    ),
)
def sales_history_on_lines(spark, folder):
    roles = ["order_id", "line_no", "part_id", "order_ts", "sales", "product", "category", "country", "customer_id"]
    lines = stage(order_lines(spark, folder, roles).withColumn("order_date", F.to_date("order_ts")))
    out = add_daily_history(lines, list(GRAINS.values()), "order_date", "sales", LAGS, WINDOWS)
    return rounded(out.select("order_id", "line_no", "part_id", *_ALL), 2, off_tie=list(_GRAIN_DIGITS), **_GRAIN_DIGITS)
