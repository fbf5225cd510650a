"""Scalar edge cases (FIXTURES.md section 4) on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlens.functions import scalars as S
from spendlens.functions import text as X


def one(spark, col, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]


def test_extract_quantity(spark):
    texts = ["Cant. 12", "Cantidad: 7", "caja PZA 3", "UN:4 Cant 9", "atun 8", "cant 0", "sin dato", None]
    got = one(spark, S.extract_quantity("t"), [(t,) for t in texts], "t string")
    assert got == [12, 7, 3, 9, 8, 0, 1, 1]


def test_calendar_flags(spark):
    rows = [(25, 6), (24, 6), (5, 1), (6, 1), (None, None)]
    df = spark.createDataFrame(rows, "d int, m int")
    f = S.calendar_flags("d", "m")
    got = [tuple(r) for r in df.select(f["is_month_end"], f["is_month_start"], f["is_quarter_end"]).collect()]
    assert got == [(1, 0, 1), (0, 0, 1), (0, 1, 0), (0, 0, 0), (0, 0, 0)]


def test_weekday_and_iso_week(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 12, 30),)], "d timestamp_ntz")
    f = S.calendar_features("d")
    got = [tuple(r) for r in df.select(f["weekday"], f["iso_week"]).collect()]
    assert got == [(0, 1), (0, 1)]


@pytest.mark.parametrize("rows,nulls,neg,dates,unk,expected", [
    (0, 0, 0, 0, 0, 0.0),
    (100, 1000, 1000, 1000, 1000, 10.0),
    (100, 1, 0, 0, 0, 99.0),
    (100, 2, 0, 0, 0, 98.0),      # one null order date counts twice
])
def test_quality_score(spark, rows, nulls, neg, dates, unk, expected):
    got = one(spark, S.quality_score("n", "a", "b", "c", "d"), [(rows, nulls, neg, dates, unk)],
              "n long, a long, b long, c long, d long")
    assert got == [pytest.approx(expected)]


def test_quality_state(spark):
    got = one(spark, S.quality_state("s"), [(90.0,), (89.99,), (75.0,), (60.0,), (59.99,)], "s double")
    assert got == ["excelente", "buena", "buena", "aceptable", "deficiente"]


def test_deviation(spark):
    df = spark.createDataFrame([(0.0, 10.0), (10.0, 0.0), (10.0, 10.0), (12.0, 10.0)], "a double, p double")
    dev, pct = S.deviation("a", "p")
    got = [tuple(r) for r in df.select(dev, pct).collect()]
    assert got == [(None, None), (10.0, None), (None, None), (2.0, pytest.approx(20.0))]


def test_large_number_and_text(spark):
    got = one(spark, X.large_number("v"), [(1.5e9,), (2.34e6,), (999.0,), (-5000.0,)], "v double")
    assert got == ["$1.5B", "$2.3M", "$999", "$-5000"]
    got = one(spark, X.truncate_text("t"), [("x" * 50,), ("y" * 51,)], "t string")
    assert got == ["x" * 50, "y" * 50 + "..."]
    got = one(spark, X.percent_difference("c", "p"), [(5.0, 0.0), (15.0, 10.0)], "c double, p double")
    assert got == [0.0, 50.0]


def test_money_rounds_like_python(spark):
    vals = [1234567.891, 0.125, 2.675, 1e9 + 0.005]
    got = one(spark, X.money("v"), [(v,) for v in vals], "v double")
    assert got == [f"{v:,.2f}" for v in vals]


def test_clamp_keeps_null(spark):
    got = one(spark, S.clamp_non_negative("v"), [(-1.0,), (2.0,), (None,)], "v double")
    assert got == [0.0, 2.0, None]


def test_template_fills_slots(spark):
    got = one(spark, X.template("a {x} b {y}", x=F.col("p"), y=F.lit(3)), [("P",)], "p string")
    assert got == ["a P b 3"]
