"""Column helpers for the arithmetic, date and text rules of the workload.

All of them are compositions of built-in expressions, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.schema import YEAR_COLUMN


def months_between_calendars(start: Column, end: Column) -> Column:
    """Month boundaries crossed from ``start`` to ``end`` (31 Jan to 1 Feb is 1)."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def years_between_calendars(start: Column, end: Column) -> Column:
    """Year boundaries crossed from ``start`` to ``end`` (31 Dec to 1 Jan is 1)."""
    return F.year(end) - F.year(start)


def whole_ratio(total: Column, count: Column) -> Column:
    """Integer quotient, truncated towards zero; NULL when the count is 0."""
    return F.call_function("div", total, F.nullif(count, F.lit(0).cast("bigint")))


def whole_mean(value: Column) -> Column:
    """Integer mean of an integer column (aggregate); NULLs do not count."""
    return whole_ratio(F.sum(value), F.count(value)).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    """Fractional quotient; NULL when ``whole`` is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent_text(part: Column, whole: Column) -> Column:
    """``33.33%``; two decimals at most, no trailing zeros."""
    share = F.round(ratio(part * 100, whole), 2)
    digits = F.call_function("format_number", share, F.lit("0.##"))
    return F.concat(F.coalesce(digits, F.lit("")), F.lit("%"))


def display_name(first: Column, last: Column) -> Column:
    """Both names and the blank between them, whatever is missing."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def growth(prior: Column, current: Column) -> Column:
    """Relative change; 0 if both are 0, +1 for a start, -1 for a stop."""
    return (
        F.when((prior == 0) & (current == 0), F.lit(0.0))
        .when((prior == 0) & (current > 0), F.lit(1.0))
        .when((prior > 0) & (current == 0), F.lit(-1.0))
        .otherwise(F.round(ratio(current - prior, prior), 4))
    )


def band(
    value: Column, steps: Iterable[tuple[int, str]], beyond: str, missing: str | None = None
) -> Column:
    """Label of the first inclusive upper bound that holds ``value``."""
    label = F.when(value.isNull(), F.lit(beyond if missing is None else missing))
    for bound, name in steps:
        label = label.when(value <= bound, F.lit(name))
    return label.otherwise(F.lit(beyond))


def in_year(value: Column, day: Column, year: int) -> Column:
    """``value`` in one calendar year, 0 outside."""
    return F.when(F.year(day) == year, value).otherwise(F.lit(0))


def dated(sales: DataFrame) -> DataFrame:
    """Sales that carry an order date."""
    return sales.where(F.col("order_date").isNotNull())


def within(sales: DataFrame, first: date, after: date) -> DataFrame:
    """Sales ordered from ``first`` up to, not including, ``after``.

    Plain range predicates reach the Parquet statistics; on published sales the
    year folder is restricted as well.
    """
    day = F.col("order_date")
    rows = sales.where((day >= F.lit(first)) & (day < F.lit(after)))
    if YEAR_COLUMN in sales.columns:
        last_year = after.year if (after.month, after.day) > (1, 1) else after.year - 1
        rows = rows.where(F.col(YEAR_COLUMN).between(first.year, last_year))
    return rows


def month_bounds(year: int, month: int) -> tuple[date, date]:
    follows = date(year + 1, 1, 1) if month == 12 else date(year, month + 1, 1)
    return date(year, month, 1), follows


def year_bounds(year: int) -> tuple[date, date]:
    return date(year, 1, 1), date(year + 1, 1, 1)
