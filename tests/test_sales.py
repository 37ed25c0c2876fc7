"""The stacked sales report against the reports one by one."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from leadline.plans import sales
from leadline.sources.tables import order_lines


def test_report_equals_single_reports(spark):
    draw = random.Random(2)
    rows = [
        (draw.randrange(40), draw.choice(["a", "b", None]), draw.choice("uvwxyz"), draw.choice([None, 5.0, 7.5]), float(draw.randrange(4)), 0.1)
        for _ in range(300)
    ]
    df = spark.createDataFrame(rows, "order_id long, kind string, place string, sales double, quantity double, discount_rate double")
    report = sales.sales_report(df, {"kind": ("kind", None), "place": ("place", 2), "again": ("place", None)})
    columns = ["value", "sales", "orders", "rows", "avg_sale", "avg_quantity", "avg_discount_rate", "sales_share"]
    for name, column, n in (("kind", "kind", None), ("place", "place", 2), ("again", "place", None)):
        got = sorted(map(tuple, report.where(f"feature = '{name}'").select(*columns).collect()))
        expected = sorted(map(tuple, sales.sales_by(df, column, n).select(*columns).collect()))
        assert [r[0] for r in got] == [r[0] for r in expected]
        assert all(g[1:] == pytest.approx(e[1:]) for g, e in zip(got, expected))
    assert sales.sales_report(df.limit(0), {"kind": ("kind", 3)}).count() == 0


def test_derived_dimensions_are_worked_out_after_the_move(spark):
    rows = [(i // 3, "abc"[i % 3], "x" * (i % 4), float(i), 1.0, 0.1) for i in range(60)]
    df = spark.createDataFrame(rows, "order_id long, kind string, place string, sales double, quantity double, discount_rate double")
    derive = lambda lines: lines.withColumn("length", F.length("place"))
    dimensions = {"kind": ("kind", None), "length": ("length", None)}
    late = sales.sales_report(df, dimensions, derive=derive)
    early = sales.sales_report(derive(df), dimensions)
    ordered = lambda t: sorted(map(tuple, t.select(*sorted(t.columns)).collect()))
    got, expected = ordered(late), ordered(early)
    assert len(got) == 7 and all(g == pytest.approx(e) for g, e in zip(got, expected))


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_customer_columns_join_the_orders(spark):
    folder = "/root/testdata/sf0.001"
    totals = sales.customer_totals(order_lines(spark, folder, ["sales", "customer_id"]))
    got = order_lines(spark, folder, ["order_id", "line_no", "sales", "customer_id"], totals)
    expected = sales.add_customer_total(order_lines(spark, folder, ["order_id", "line_no", "sales", "customer_id"]))
    both = [sorted(map(tuple, t.select("order_id", "line_no", "sales", "customer_total_sales").collect())) for t in (got, expected)]
    assert len(both[0]) == len(both[1]) and all(a == pytest.approx(b) for a, b in zip(*both))
