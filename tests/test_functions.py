import datetime as dt
import math

from pyspark.sql import functions as F

from leadline.functions import dates, labels, numbers
from leadline.plans import cleaning
from leadline.sources import csv, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_bins_are_closed_on_the_right(spark):
    def band(v):
        return one(spark, labels.cut(F.lit(v).cast("double"), labels.DISCOUNT_RATE_EDGES, labels.DISCOUNT_RATE_LABELS))

    assert [band(v) for v in (-0.001, 0.0, 0.05, 0.0501, 0.2, 0.9)] == [None, "0%", "0-5%", "5-10%", "15-20%", ">20%"]
    assert band(None) is None
    margin = labels.cut(F.lit(-9.0), labels.PROFIT_RATIO_EDGES, labels.PROFIT_RATIO_LABELS)
    assert one(spark, margin) == "Perdida alta"


def test_calendar_rules(spark):
    day = lambda y, m, d: F.lit(dt.date(y, m, d))
    assert one(spark, dates.calendar_period(day(2017, 12, 25))) == "Generic fixed holiday"
    assert one(spark, dates.calendar_period(day(2017, 12, 24))) == "Christmas season"
    assert one(spark, dates.calendar_period(day(2017, 11, 20))) == "Black Friday period"
    assert one(spark, dates.calendar_period(day(2017, 11, 19))) == "Normal"
    assert one(spark, dates.calendar_period(day(2017, 9, 15))) == "Back to school period"
    assert one(spark, dates.weekday(day(2024, 1, 1))) == 0
    assert one(spark, dates.iso_week(day(2017, 1, 1))) == 52
    assert one(spark, dates.days_since(day(2017, 1, 1), day(2017, 2, 1))) == 0


def test_hours_round_half_to_even_and_days_floor(spark):
    ts = lambda text: F.lit(text).cast("timestamp")
    assert one(spark, dates.hours_between(ts("2020-01-01 02:30:00"), ts("2020-01-01 00:00:00"))) == 2
    assert one(spark, dates.hours_between(ts("2020-01-01 03:30:00"), ts("2020-01-01 00:00:00"))) == 4
    assert one(spark, dates.floor_days(F.lit(-1))) == -1
    assert one(spark, dates.parse_timestamp(F.lit("13/45/2020 1:00"))) is None


def test_number_edges(spark):
    assert one(spark, numbers.safe_divide(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numbers.finite_or_null(F.lit(math.inf))) is None
    assert one(spark, numbers.to_number(F.lit("12,5"))) is None
    assert one(spark, numbers.any_of(F.lit(None).cast("boolean"), F.lit(False))) is False
    assert one(spark, labels.short_label(F.lit("x" * 50))) == "x" * 39 + "..."
    assert one(spark, labels.short_label(F.lit(None))) == "Sin dato"


def test_csv_falls_back_to_latin1_and_drops_the_byte_order_mark(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("Order Id,Order City\n1,M\xe9xico\nx,Quito\n".encode("latin-1"))
    (tmp_path / "bom.csv").write_bytes("Order Id,Order City\n7,México\n".encode("utf-8-sig"))
    latin = csv.read_csv(spark, str(tmp_path / "latin.csv"), csv.ORDER_LINE_TYPES).orderBy("Order City").collect()
    assert [tuple(r) for r in latin] == [(1, "México"), (None, "Quito")]
    bom = csv.read_csv(spark, str(tmp_path / "bom.csv"), csv.ORDER_LINE_TYPES)
    assert bom.columns == ["Order Id", "Order City"] and tuple(bom.first()) == (7, "México")


def test_tables_are_built_once_and_rounded(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return sinks.round_doubles(spark.createDataFrame([(1, 0.12345675)], "k int, x double"), 6)

    path = str(tmp_path / "t")
    sinks.ensure_table(spark, path, build)
    row = sinks.ensure_table(spark, path, build).first()
    assert calls == [1] and row["x"] == 0.123457
    both = sinks.stack([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "z")], "a int, b string")])
    assert sorted(map(tuple, both.collect())) == [(1, None), (2, "z")]


def test_raw_export_is_cleaned(spark):
    schema = (
        "Type string, `order date (DateOrders)` string, `shipping date (DateOrders)` string, `Days for shipping (real)` bigint,"
        " Late_delivery_risk int, `Delivery Status` string, `Order Status` string"
    )
    rows = [
        ("CASH", "1/31/2018 22:56", "2/3/2018 22:56", 3, 0, "Advance shipping", "COMPLETE"),
        ("DEBIT", "bad", "2/3/2018 10:00", 2, 1, None, "PAYMENT_REVIEW"),
    ]
    a, b = cleaning.clean_order_lines(spark.createDataFrame(rows, schema)).collect()
    assert (a["shipping_hours_from_dates"], a["shipping_days_from_dates_exact"], a["shipping_days_from_dates_floor"]) == (72, 3.0, 3)
    assert a["shipping_days_floor_matches_original"] and not a["is_order_problem"] and a["payment_type_cash"]
    assert b["order_datetime"] is None and not b["shipping_days_floor_matches_original"]
    assert b["is_payment_problem"] and b["is_order_problem"] and not b["is_shipping_canceled"]
    log = cleaning.clean_access_log(spark.createDataFrame([("9/14/2017 20:34", 20), ("x", 3)], "Date string, Hour bigint")).collect()
    assert log[0]["access_hour_from_datetime"] == 20 and log[0]["hour_matches_datetime"] and not log[1]["hour_matches_datetime"]
