"""First look: distinct values, time spans and single measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmart.config import Config
from starmart.functions.semantics import (
    months_between_calendars,
    whole_mean,
    years_between_calendars,
)
from starmart.schema import Star


def countries(star: Star, config: Config) -> DataFrame:
    return star.customers.select("country").distinct().orderBy("country")


def catalog_paths(star: Star, config: Config) -> DataFrame:
    path = ["category", "subcategory", "product_name"]
    return star.products.select(*path).distinct().orderBy(*path)


def _span(rows: DataFrame, column: str, first: str, last: str, months: str) -> DataFrame:
    return rows.agg(F.min(column).alias(first), F.max(column).alias(last)).withColumn(
        months, months_between_calendars(F.col(first), F.col(last))
    )


def product_start_range(star: Star, config: Config) -> DataFrame:
    return _span(
        star.products,
        "start_date",
        "first_product_start_date",
        "last_product_start_date",
        "catalog_expansion_months",
    )


def order_range(star: Star, config: Config) -> DataFrame:
    return _span(
        star.sales, "order_date", "first_order_date", "last_order_date", "order_range_months"
    )


def customer_age_range(star: Star, config: Config) -> DataFrame:
    """Oldest and youngest customer on the snapshot day."""
    anchor = F.lit(config.age_anchor)
    return star.customers.agg(
        F.min("birthdate").alias("oldest_birthdate"), F.max("birthdate").alias("youngest_birthdate")
    ).select(
        "oldest_birthdate",
        years_between_calendars(F.col("oldest_birthdate"), anchor).alias("oldest_current_age"),
        "youngest_birthdate",
        years_between_calendars(F.col("youngest_birthdate"), anchor).alias("youngest_current_age"),
    )


def total_sales(star: Star, config: Config) -> DataFrame:
    return star.sales.agg(F.sum("sales_amount").alias("total_sales"))


def total_quantity(star: Star, config: Config) -> DataFrame:
    return star.sales.agg(F.sum("quantity").alias("total_quantity"))


def average_price(star: Star, config: Config) -> DataFrame:
    return star.sales.agg(whole_mean(F.col("price")).alias("avg_price"))


def order_lines(star: Star, config: Config) -> DataFrame:
    """Sales rows with an order number (not distinct orders)."""
    return star.sales.agg(F.count("order_number").alias("total_orders"))


def unique_orders(star: Star, config: Config) -> DataFrame:
    return star.sales.agg(F.count_distinct("order_number").alias("total_unique_orders"))


def total_products(star: Star, config: Config) -> DataFrame:
    return star.products.agg(F.count("product_id").alias("total_products"))


def total_customers(star: Star, config: Config) -> DataFrame:
    return star.customers.agg(F.count("customer_id").alias("total_customers"))


def active_customers(star: Star, config: Config) -> DataFrame:
    return star.sales.agg(F.count_distinct("customer_key").alias("total_active_customers"))


def _metrics(rows: DataFrame, **metrics) -> DataFrame:
    """One (metric_name, metric_value) row per aggregate, from one pass."""
    totals = rows.agg(*[value.cast("bigint").alias(name) for name, value in metrics.items()])
    lines = [
        F.struct(
            F.lit(name.replace("_", " ")).alias("metric_name"), F.col(name).alias("metric_value")
        )
        for name in metrics
    ]
    return totals.select(F.inline(F.array(*lines)))


def kpi_report(star: Star, config: Config) -> DataFrame:
    """Six headline numbers; each table is scanned once."""
    return (
        _metrics(
            star.sales,
            Total_Sales=F.sum("sales_amount"),
            Total_Quantity=F.sum("quantity"),
            Average_Price=whole_mean(F.col("price")),
            Total_Orders=F.count_distinct("order_number"),
        )
        .unionByName(
            _metrics(star.products, Total_Products=F.count_distinct("product_name"))
        )
        .unionByName(_metrics(star.customers, Total_Customers=F.count("customer_key")))
    )
