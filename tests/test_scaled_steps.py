"""Steps that were rewritten to scale: against brute force, and queries against their SQL on the smallest tables."""

import math
import pathlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from leadline.catalog import columns, promise
from leadline.operators import cross_products, features, grain_history, hist_boosting, models, order_stats
from leadline.operators.features import INFREQUENT, Encoding, exact_medians, fit_encoding
from leadline.plans import sales
from leadline.sources.tables import order_lines

FOLDER = "/root/testdata/sf0.001"


def test_pooling_takes_any_number_of_categories(spark, monkeypatch):
    rows = [("a",)] * 30 + [(f"r{k}",) for k in range(40)] + [(None,)] * 3
    df = spark.createDataFrame([(c, 1.0) for (c,) in rows], "c string, x double")
    found = []
    for listed in (1000, 0):
        monkeypatch.setattr(features, "MAX_LISTED", listed)
        monkeypatch.setattr(features, "MAX_CATEGORIES", 5)
        fitted = fit_encoding(df, Encoding(("c",), ("x",)))
        new = df.union(spark.createDataFrame([("new", 2.0)], df.schema))
        found.append(sorted((r["_c_c"], r["count"]) for r in fitted.prepare(new).groupBy("_c_c").count().collect()))
        with pytest.raises(ValueError):
            fitted.slots
    assert found[0] == found[1] == sorted([(INFREQUENT, 40), ("a", 33), ("new", 1)])


@pytest.mark.parametrize("n", [1, 2, 3001, 3002])
def test_medians_of_many_values_take_no_search(spark, monkeypatch, n):
    monkeypatch.setattr(features, "DISTINCT_LIMIT", 0)
    monkeypatch.setattr(features, "exact_quantiles", None)
    draw = random.Random(n)
    rows = [(draw.random(), float(draw.randrange(5)), float(k**3), None if k % 3 else draw.gauss(0, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    got = exact_medians(df, ["a", "b", "c", "d"])
    for k, c in enumerate("abcd"):
        assert got[c] == pytest.approx(float(np.median([r[k] for r in rows if r[k] is not None])), abs=1e-12)


def test_a_search_makes_no_copy_of_staged_rows(spark, monkeypatch):
    sizes, real = [], order_stats.stage
    monkeypatch.setattr(order_stats, "stage", lambda df: sizes.append(df.count()) or real(df))
    df = spark.range(5000).selectExpr("id % 2 as k", "cast(hash(id) as double) as v")
    got = {r["k"]: r["m"] for r in order_stats.exact_quantiles(df, ["k"], "v", {"m": 0.5}, distinct_limit=10, buckets=8, staged=True).collect()}
    plain = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()}
    assert got == plain and max(sizes) <= 4


def test_products_equal_a_dense_matrix():
    draw = np.random.default_rng(3)
    for a, b in ((3, 4), (300, 200)):
        one, two, x = draw.integers(-1, a, 50), draw.integers(-1, b, 50), draw.normal(size=(50, 2))
        dense = np.column_stack([*(one == k for k in range(a)), *(two == k for k in range(b)), *x.T]).astype(float)
        sums = np.zeros((a + b + 2, a + b + 2))
        cross_products.add_products(sums, [one, np.where(two < 0, -1, two + a)], [(0, a), (a, a + b)], x, a + b)
        assert np.allclose(sums, np.triu(dense.T @ dense))


def test_places_join_the_orders_before_the_lines(spark):
    plan = order_lines(spark, FOLDER, ["sales", "city", "market", "product"])._jdf.queryExecution().analyzed().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    depth = {key: line.index("Join") for line in joins for key in ("l_orderkey", "o_custkey") if f"({key}#" in line}
    assert depth["o_custkey"] > depth["l_orderkey"]


def test_history_is_the_same_whichever_grains_are_broadcast(spark, monkeypatch):
    df = spark.range(400).selectExpr(
        "id", "if(id % 7 = 0, null, id % 5) as k", "date_add(date'2020-01-01', cast(hash(id) % 40 as int)) as d", "cast(id as double) as s"
    )
    grains, found = [grain_history.Grain("all"), grain_history.Grain("key", ("k",))], []
    for limit in (grain_history.SMALL_ROWS, 100, 0):
        monkeypatch.setattr(grain_history, "SMALL_ROWS", limit)
        got = grain_history.add_daily_history(df, grains, "d", "s", (1, 7), (7,))
        assert got.columns == [*df.columns, *grain_history.feature_names(grains, (1, 7), (7,))]
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 400


def test_orders_are_counted_once_per_value(spark):
    draw = random.Random(4)
    rows = [(draw.choice([None, 1, 2, 3, 4, 5]), draw.choice(["a", "b", None]), str(draw.randrange(40)), draw.choice([None, 2.0]), 1.0, 0.5) for _ in range(400)]
    df = spark.createDataFrame(rows, "order_id long, kind string, place string, sales double, quantity double, discount_rate double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # orders go over several batches
    try:
        got = {(r["feature"], r["value"]): r for r in sales._folded(df.repartition(3), {"kind": "kind", "place": "place"}, sales.SalesColumns()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for at, name in ((1, "kind"), (2, "place")):
        for value in {r[at] for r in rows}:
            mine = [r for r in rows if r[at] == value]
            sold, row = [r[3] for r in mine if r[3] is not None], got[name, value]
            assert (row["rows"], row["orders"]) == (len(mine), len({r[0] for r in mine} - {None}))
            assert row["sales"] == (sum(sold) if sold else None) and row["avg_quantity"] == 1.0
    assert len(got) == len({r[1] for r in rows}) + len({r[2] for r in rows})


def test_trees_are_the_same_in_blocks_of_any_size(spark, monkeypatch):
    df = spark.range(3000).selectExpr("cast(hash(id) % 900 as double) as a", "if(id % 9 = 0, null, cast(id % 300 as double)) as b", "cast(id % 17 as double) as y")
    found = []
    for size, bins in ((1 << 16, 255), (100, 255), (100, 800)):
        monkeypatch.setattr(hist_boosting, "BLOCK_ROWS", size)
        monkeypatch.setattr(hist_boosting, "STAGE_ROUNDS", 2)
        model = hist_boosting.fit_boosting(df.repartition(2), ["a", "b"], "y", hist_boosting.BoostParams(iterations=5, max_bins=bins))
        found.append(sorted(r["predicted"] for r in model.predict(df).collect()))
    assert found[0] == pytest.approx(found[1], abs=1e-9) and len(found[2]) == 3000


def test_tree_models_of_one_encoding_share_their_inputs(spark, monkeypatch):
    made = []
    for kind in (features.FittedEncoding, features._FittedOrdinal):
        own = kind.transform
        monkeypatch.setattr(kind, "transform", lambda self, df, own=own: made.append(df.columns) or own(self, df))
    df = spark.range(300).selectExpr("id", "cast(id % 3 as string) as c", "cast(id as double) as x", "cast(id % 3 as double) as y", "if(id < 200, 'train', 'test') as split")
    codes = models.ordinal(["c"], ["x"])
    specs = [models.ModelSpec(n, "forest", codes, {"trees": 2, "max_depth": 3}) for n in ("one", "two")]
    pred, _ = models.fit_and_score(df, "y", specs, ["id"])
    assert len(made) == 1 and pred.columns == ["id", "split", "actual", "model", "predicted"] and pred.count() == 600


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize(
    "name",
    ["promise_compliance_test", "customer_value_bands_per_customer", "sales_by_quantity_bin", "sales_history_on_lines",
     "linear_fit_optimality", "arrival_rule_scores"],
)
def test_query_equals_its_sql(spark, name):
    assert promise.stage and columns.stage
    con = duckdb.connect()
    for path in pathlib.Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = driver.queries()[name](spark, FOLDER)
    cursor = con.execute(driver.oracle_sql()[name])
    shown = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(c) for c in shown]
    key = lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r]
    got = sorted((tuple(r[c] for c in shown) for r in df.collect()), key=key)
    expected = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=key)
    assert shown == sorted(df.columns) and len(got) == len(expected)
    same = lambda a, b: math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) if isinstance(a, float) and isinstance(b, float) else a == b
    assert all(same(a, b) for x, y in zip(got, expected) for a, b in zip(x, y))
