from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from starmart.functions.semantics import (
    band,
    display_name,
    growth,
    month_bounds,
    months_between_calendars,
    percent_text,
    whole_mean,
    years_between_calendars,
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("start", "end", "months"),
    [
        ("2013-01-31", "2013-02-01", 1),
        ("2013-01-01", "2013-01-31", 0),
        ("2014-01-28", "2013-12-31", -1),
        ("2012-11-30", "2014-01-01", 14),
    ],
)
def test_month_boundaries(spark, start, end, months):
    a, b = (F.lit(date.fromisoformat(d)) for d in (start, end))
    assert one(spark, months_between_calendars(a, b)) == months


def test_year_boundary(spark):
    a, b = F.lit(date(2012, 12, 31)), F.lit(date(2013, 1, 1))
    assert one(spark, years_between_calendars(a, b)) == 1


@pytest.mark.parametrize(
    ("values", "mean"), [([1, 2, 2], 1), ([1, None, 4], 2), ([-1, -2], -1), ([None], None)]
)
def test_whole_mean_truncates_and_skips_nulls(spark, values, mean):
    rows = spark.createDataFrame([(v,) for v in values], "v int")
    assert rows.agg(whole_mean(F.col("v"))).first()[0] == mean


@pytest.mark.parametrize(
    ("part", "whole", "text"),
    [
        (1, 2, "50%"),
        (1, 3, "33.33%"),
        (0, 7, "0%"),
        (7, 7, "100%"),
        (1, 8, "12.5%"),
        (1, 1000, "0.1%"),
        (141, 2000, "7.05%"),
        (1, 0, "%"),
    ],
)
def test_percent_text(spark, part, whole, text):
    assert one(spark, percent_text(F.lit(part), F.lit(whole))) == text


def test_name_keeps_the_blank(spark):
    nothing = F.lit(None).cast("string")
    assert one(spark, display_name(nothing, nothing)) == " "
    assert one(spark, display_name(F.lit("Ann"), nothing)) == "Ann "
    assert one(spark, display_name(F.lit("Ann"), F.lit("Lee"))) == "Ann Lee"


@pytest.mark.parametrize(
    ("prior", "current", "rate"),
    [(0, 0, 0.0), (0, 5, 1.0), (5, 0, -1.0), (3, 4, 0.3333), (4, 3, -0.25), (8, 8, 0.0)],
)
def test_growth(spark, prior, current, rate):
    assert one(spark, growth(F.lit(prior), F.lit(current))) == rate


def test_band_takes_the_first_bound_and_its_own_missing_label(spark):
    steps = [(1, "a"), (5, "b")]
    labels = [one(spark, band(F.lit(v), steps, "c")) for v in (0, 1, 2, 5, 6)]
    assert labels == ["a", "a", "b", "b", "c"]
    empty = F.lit(None).cast("int")
    assert one(spark, band(empty, steps, "c")) == "c"
    assert one(spark, band(empty, steps, "c", "none")) == "none"


def test_month_bounds_cross_the_year():
    assert month_bounds(2013, 12) == (date(2013, 12, 1), date(2014, 1, 1))
    assert month_bounds(2013, 1) == (date(2013, 1, 1), date(2013, 2, 1))


def test_order_puts_nulls_lowest(spark):
    rows = spark.createDataFrame([(1,), (None,), (2,)], "v int")
    assert [r.v for r in rows.orderBy("v").collect()] == [None, 1, 2]
    assert [r.v for r in rows.orderBy(F.desc("v")).collect()] == [2, 1, None]


def test_rounding_is_half_away_from_zero(spark):
    values = [2.675, 2.5, -2.5, 132.575]
    digits = [2, 0, 0, 2]
    assert [one(spark, F.round(F.lit(v), d)) for v, d in zip(values, digits)] == [
        2.68, 3.0, -3.0, 132.58,
    ]
