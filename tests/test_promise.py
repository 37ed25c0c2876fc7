"""Published totals of the promise reports, rebuilt from their delay counts."""

import pytest
from pyspark.sql import functions as F

from leadline.operators.aggregate import crosstab, mode_by
from leadline.plans import promise

# Lines per (mode, delay), and the promise of each mode.
COUNTS = {
    ("Standard Class", 4): {-2: 21666, -1: 21700, 0: 21535, 1: 21111, 2: 21740},
    ("Same Day", 0): {0: 5080, 1: 4657},
    ("Second Class", 2): {0: 7138, 1: 7065, 2: 6978, 3: 7052, 4: 6983},
    ("First Class", 1): {1: 27814},
}


@pytest.fixture(scope="module")
def lines(spark):
    cells = [(m, p, p + d, n) for (m, p), by in COUNTS.items() for d, n in by.items()]
    df = spark.createDataFrame(cells, "shipping_mode string, promised_days int, actual_days int, n int")
    return df.select("shipping_mode", "promised_days", "actual_days", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("order_id")).withColumn(
        "official_late", F.col("actual_days") > F.col("promised_days")
    )


def test_recommendation_gives_the_published_totals(lines):
    rows = {r["shipping_mode"]: r for r in promise.recommend_promise(lines).collect()}
    assert {m: r["recommended_baseline_days"] for m, r in rows.items()} == {
        "Standard Class": 4, "Same Day": 1, "Second Class": 4, "First Class": 2}
    assert {m: r["baseline_broken_promises"] for m, r in rows.items()} == {
        "Standard Class": 42851, "Same Day": 0, "Second Class": 14035, "First Class": 0}
    assert sum(r["orders"] for r in rows.values()) == 180519
    assert sum(r["current_broken_promises"] for r in rows.values()) == 103400
    assert sum(r["baseline_broken_promises"] for r in rows.values()) == 56886
    assert sum(r["promises_fixed"] for r in rows.values()) == 46514
    assert rows["First Class"]["current_promise_days"] == 1


def test_crosstab_restores_the_counts(lines):
    wide = crosstab(promise.with_delay(lines), "shipping_mode", "delay_days", list(range(-2, 5)), list(m for m, _ in COUNTS))
    rows = wide.collect()
    assert [r["shipping_mode"] for r in rows] == [m for m, _ in COUNTS]
    assert rows[0]["n_m2"] == 21666 and rows[1]["n_m1"] == 0 and rows[2]["n_4"] == 6983


def test_mode_takes_the_smallest_on_ties_and_unknown_without_values(spark):
    df = spark.createDataFrame(
        [("a", "y"), ("a", "x"), ("a", None), ("a", None), ("a", None), ("b", None)], "k string, v string")
    got = {r["k"]: r["m"] for r in mode_by(df, ["k"], "v", "m", "Unknown").collect()}
    assert got == {"a": "x", "b": "Unknown"}
