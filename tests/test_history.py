"""History features against a plain reading of their definition, row by row."""

import datetime as dt
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadline.operators.grain_history import Grain, add_daily_history
from leadline.operators.history import history_columns
from leadline.operators.panel import densify, lag_columns, rolling_columns
from leadline.plans.arrival import with_mode_history

T0 = dt.datetime(2020, 1, 1)
SCHEMA = "order_id int, shipping_mode string, order_ts timestamp, shipping_ts timestamp, actual_days int, promised_days int"


def make_lines(n=260, seed=3):
    """Mode A holds most rows; many equal times; mode C never completes."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        mode = "C" if i % 40 == 0 else None if i % 61 == 0 else "B" if i % 5 == 0 else "A"
        order = T0 + dt.timedelta(days=rnd.randrange(120), hours=rnd.choice([0, 0, 0, 6]))
        days = rnd.randrange(7)
        done = None if mode == "C" or i % 23 == 0 else order + dt.timedelta(days=days)
        rows.append((i, mode, order, done, days, rnd.choice([1, 2, 4])))
    return rows


def by_definition(rows):
    out = {}
    for oid, mode, t, _, _, _ in rows:
        done = sorted((s, o, d, d > p) for o, m, _, s, d, p in rows if m == mode and s is not None) if mode else []
        f = dict.fromkeys(history_columns("mode"))
        if done:
            past = [x for x in done if x[0] < t]
            days = [x[2] for x in past]
            mean = lambda v: sum(v) / len(v) if v else None
            f["mode_completed_lag1_days"] = float(days[-1]) if days else None
            for n in (7, 30, 100):
                f[f"mode_completed_mean_last_{n}"] = mean(days[-n:])
            f["mode_completed_std_last_30"] = statistics.pstdev(days[-30:]) if days else None
            f["mode_completed_late_rate_last_30"] = mean([x[3] for x in past[-30:]])
            f["mode_completed_expanding_mean"] = mean(days)
            for d in (7, 30):
                near = [x for x in past if x[0] >= t - dt.timedelta(days=d)]
                f[f"mode_completed_mean_prev_{d}d"] = mean([x[2] for x in near])
                f[f"mode_completed_count_prev_{d}d"] = len(near)
            f["mode_completed_late_rate_prev_30d"] = mean([x[3] for x in near])
            for d in (7, 30, 90):
                f[f"mode_order_count_prev_{d}d"] = sum(
                    1 for _, m, u, *_ in rows if m == mode and t - dt.timedelta(days=d) <= u < t)
        out[oid] = f
    return out


def features(spark, rows, **sizes):
    df = with_mode_history(spark.createDataFrame(rows, SCHEMA), ["order_id"], **sizes)
    return {r["order_id"]: {c: r[c] for c in history_columns("mode")} for r in df.collect()}


@pytest.mark.parametrize("sizes", [{}, {"chunk_days": 3}])
def test_mode_history_follows_its_definition(spark, sizes):
    rows = make_lines()
    got, expected = features(spark, rows, **sizes), by_definition(rows)
    assert got.keys() == expected.keys()
    for oid in expected:
        for name, value in expected[oid].items():
            assert got[oid][name] == (pytest.approx(value, abs=1e-9) if value is not None else None), (oid, name)


def test_later_rows_never_change_earlier_features(spark):
    rows, t = make_lines(), T0 + dt.timedelta(days=60)
    changed = [
        (o, m, u, s if s is None or s < t else s + dt.timedelta(days=9), d if s is None or s < t else 6 - d, p)
        for o, m, u, s, d, p in rows
    ]
    a, b = features(spark, rows), features(spark, changed)
    early = [o for o, _, u, *_ in rows if u <= t]
    assert early and all(a[o] == b[o] for o in early)


def test_no_window_of_the_history_runs_over_a_whole_mode(spark):
    df = with_mode_history(spark.createDataFrame(make_lines(), SCHEMA), ["order_id"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    whole = [line for line in plan.splitlines() if "Window [" in line and "], [shipping_mode" in line and "_chunk" not in line and "_block" not in line and "_at" not in line]
    # The only windows by mode alone run over the table with one row per mode and chunk.
    assert all("_base" in line or "_completed" in line for line in whole)


def test_sparse_daily_history_equals_the_dense_one(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a", "a", "b", None]), dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randrange(70)), float(rnd.randrange(100))) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, k string, d date, s double")
    grains = [Grain("all"), Grain("key", ("k",))]
    got = add_daily_history(df, grains, "d", "s", (1, 7), (7, 30)).orderBy("i").toPandas()
    pdf = pd.DataFrame(rows, columns=["i", "k", "d", "s"]).assign(d=lambda x: pd.to_datetime(x.d))
    dates = pd.date_range(pdf.d.min(), pdf.d.max())
    for name, part in [("all", [pdf]), ("key", [g for _, g in pdf.groupby("k", dropna=False)])]:
        for g in part:
            daily = g.groupby("d").s.sum()
            dense = daily.reindex(dates).fillna(0)
            mine = got[got.i.isin(g.i)].set_index("i")
            for i, d in zip(g.i, g.d):
                for w in (7, 30):
                    past = dense.shift(1).rolling(w, min_periods=1)
                    for col, want in ((f"roll_sum_{w}d", past.sum()[d]), (f"roll_mean_{w}d", past.mean()[d])):
                        value = mine.loc[i, f"{name}_sales_{col}"]
                        assert (pd.isna(value) and pd.isna(want)) or value == pytest.approx(want)
                for lag in (1, 7):
                    want, value = daily.get(d - pd.Timedelta(days=lag)), mine.loc[i, f"{name}_sales_lag_{lag}d"]
                    assert (want is None and pd.isna(value)) or value == pytest.approx(want)


def test_panel_fills_every_day_before_between_and_after(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    facts = spark.createDataFrame([("a", day(1), 2.0, 9.0), ("a", day(4), 3.0, 7.0), ("b", day(0), 1.0, None), ("b", day(5), 1.0, 5.0)],
                                  "k string, d date, q double, p double")
    panel = densify(facts, ["k"], "d", ["q"], ["p"])
    columns = {**lag_columns(["k"], "d", "q", [1]), **rolling_columns(["k"], "d", "p", [3])}
    got = panel.select("*", *[c.alias(n) for n, c in columns.items()]).orderBy("k", "d").collect()
    assert [(r["k"], r["d"], r["q"]) for r in got] == [("a", day(n), {1: 2.0, 4: 3.0}.get(n, 0.0)) for n in range(6)] + [
        ("b", day(n), {0: 1.0, 5: 1.0}.get(n, 0.0)) for n in range(6)]
    a = got[:6]
    assert [r["q_lag_1d"] for r in a] == [None, 0.0, 2.0, 0.0, 0.0, 3.0]
    assert [r["p_roll_mean_3d"] for r in a] == [None, None, 9.0, 9.0, 9.0, 7.0]
    assert panel.filter(F.col("p").isNotNull()).count() == 3
