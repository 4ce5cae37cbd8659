"""Sales by calendar month, year and single period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.config import Config
from starmart.functions.semantics import dated, month_bounds, whole_ratio, within
from starmart.operators.distincts import Cells
from starmart.schema import Star


def _mean_cost(lines: str) -> Column:
    """Integer mean cost per sales row, from rows already counted per product."""
    known = F.when(F.col("cost").isNotNull(), F.col(lines))
    return whole_ratio(F.sum(F.col("cost") * F.col(lines)), F.sum(known)).cast("int")


def seasonal_mix(star: Star, config: Config) -> DataFrame:
    """Cost, variety and volume per calendar month, all years together.

    Counting per (month, product) first answers all three: every pair is one
    distinct product, and the join sees pairs instead of sales.
    """
    return (
        dated(star.sales)
        .groupBy(F.month("order_date").alias("order_month"), "product_key")
        .agg(F.count(F.lit(1)).alias("lines"))
        .join(star.products.select("product_key", "cost"), "product_key", "left")
        .groupBy("order_month")
        .agg(
            _mean_cost("lines").alias("average_cost"),
            F.count("product_key").alias("total_products"),
            F.sum("lines").alias("total_transactions"),
        )
        .orderBy("order_month")
    )


def period_products(star: Star, config: Config) -> DataFrame:
    """Products sold in one month, and how often."""
    month = within(star.sales, *month_bounds(config.focus_year, config.focus_month))
    known = star.products.select(
        F.col("product_key").alias("known_key"), "product_name", "cost"
    )
    return (
        month.groupBy("product_key")
        .agg(F.count(F.lit(1)).alias("lines"))
        .join(known, F.col("product_key") == F.col("known_key"), "left")
        .groupBy(F.col("known_key").alias("product_key"), "product_name")
        .agg(
            _mean_cost("lines").alias("average_cost"),
            F.sum("lines").alias("total_transactions"),
        )
        .select(
            F.lit(config.focus_month).alias("order_month"),
            F.lit(config.focus_year).alias("order_year"),
            "product_key",
            "product_name",
            "average_cost",
            "total_transactions",
        )
        .orderBy("order_month", "product_name", "product_key")
    )


def _by_calendar(sales: DataFrame, **parts: Column) -> DataFrame:
    """Revenue, buyers and units per calendar part.

    Grouping by part and customer first gives the buyers and the sums in one
    shuffle, and keeps a frequent customer or a busy month combinable.
    """
    return (
        sales.groupBy(*[part.alias(name) for name, part in parts.items()], "customer_key")
        .agg(F.sum("sales_amount").alias("amount"), F.sum("quantity").alias("units"))
        .groupBy(*parts)
        .agg(
            F.sum("amount").alias("total_sales"),
            F.count("customer_key").alias("total_customers"),
            F.sum("units").alias("total_quantity"),
        )
    )


def monthly_sales(star: Star, config: Config) -> DataFrame:
    return (
        dated(star.sales)
        .groupBy(
            F.year("order_date").alias("order_year"), F.month("order_date").alias("order_month")
        )
        .agg(F.sum("sales_amount").alias("total_sales"))
        .orderBy("order_year", "order_month")
    )


def _month_totals(star: Star, month: str, total: str) -> DataFrame:
    """Per calendar month; sales without a date form a month of their own."""
    return star.sales.groupBy(F.month("order_date").alias(month)).agg(
        F.sum("sales_amount").alias(total)
    )


def best_month(star: Star, config: Config) -> DataFrame:
    return (
        _month_totals(star, "best_month", "max_sales")
        .orderBy(F.desc("max_sales"), "best_month")
        .limit(1)
    )


def worst_month(star: Star, config: Config) -> DataFrame:
    return (
        _month_totals(star, "worst_month", "min_sales")
        .orderBy("min_sales", "worst_month")
        .limit(1)
    )


def calendar_cells(**parts: Column) -> Cells:
    """Revenue, units, buyers and products of a calendar part, over dated sales."""
    return Cells(
        by=parts,
        measures={"total_sales": (F.sum, F.col("sales_amount")), "total_quantity": (F.sum, F.col("quantity"))},
        items={"total_customers": F.col("customer_key"), "total_products": F.col("product_key")},
    )


def annual_scorecard(star: Star, config: Config) -> DataFrame:
    """Revenue, buyers, units and products per year: two exact distinct counts."""
    yearly = calendar_cells(order_year=F.year("order_date"))
    return yearly.totals(yearly.of(dated(star.sales))).select(
        "order_year", "total_sales", "total_customers", "total_quantity", "total_products"
    ).orderBy("order_year")


def calendar_month(star: Star, config: Config) -> DataFrame:
    return _by_calendar(dated(star.sales), order_month=F.month("order_date")).orderBy(
        "order_month"
    )


def year_month(star: Star, config: Config) -> DataFrame:
    return _by_calendar(
        dated(star.sales), order_year=F.year("order_date"), order_month=F.month("order_date")
    ).orderBy("order_year", "order_month")


def month_start(star: Star, config: Config) -> DataFrame:
    return _by_calendar(dated(star.sales), order_date=F.trunc("order_date", "MONTH")).orderBy(
        "order_date"
    )


def month_label(star: Star, config: Config) -> DataFrame:
    """As ``month_start`` with a text label, formatted once per month."""
    return month_start(star, config).select(
        F.date_format("order_date", "yyyy-MMM").alias("order_date_label"),
        "total_sales",
        "total_customers",
        "total_quantity",
    )
