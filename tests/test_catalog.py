"""Registered queries against their SQL on the smallest tables."""

import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")

CHECKED = [
    "promise_recommendation", "promise_calibration", "delay_crosstab", "profile_cardinality", "profile_top_values", "clean_durations",
    "price_bands", "sales_by_country", "sales_versus_views", "arrival_history_on_lines", "sales_history_product", "demand_history_avg_price",
    "demand_rule_scores", "walk_forward_scores", "frozen_stable_months", "split_by_share", "encode_pooled",
    "price_first_come_rank", "sales_report_stacked", "events_last_click", "events_lookback", "hist_boosting_predictions",
    "extra_trees_predictions",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in pathlib.Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    df = driver.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = ordered(tuple(r[c] for c in columns) for r in df.collect())
    cursor = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = ordered(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert len(got) == len(expected)
    assert all(close(a, b) for x, y in zip(got, expected) for a, b in zip(x, y))


def test_every_sql_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_runs(spark):
    assert driver.entry(spark).count() == 5
