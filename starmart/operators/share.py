"""Shares of revenue, orders and buyers per category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starmart.config import Config
from starmart.functions.semantics import percent_text
from starmart.operators.heavy import looked_up
from starmart.operators.magnitude import amount_by_product
from starmart.schema import Star


def _categorised(star: Star) -> DataFrame:
    return star.products.where(F.col("category").isNotNull()).select("product_key", "category")


def sales_by_category(star: Star, config: Config) -> DataFrame:
    """Share of the revenue of all categorised sales."""
    # One row per category reaches the window.
    everything = Window.partitionBy(F.lit(0))
    return (
        amount_by_product(star)
        .join(_categorised(star), "product_key")
        .groupBy("category")
        .agg(F.sum("amount").alias("total_sales"))
        .withColumn("overall_sales", F.sum("total_sales").over(everything))
        .withColumn(
            "percentage_of_total", percent_text(F.col("total_sales"), F.col("overall_sales"))
        )
        .orderBy(F.desc("total_sales"), "category")
    )


def orders_by_category(star: Star, config: Config) -> DataFrame:
    """Share of all orders; an order with several categories counts in each."""
    overall = star.sales.agg(F.count_distinct("order_number")).scalar()
    # One row per product and order meets the join, however many lines there are.
    pairs = star.sales.select("product_key", "order_number").distinct()
    return (
        looked_up(pairs, "product_key", _categorised(star), star.sales, F.col("order_number"), "inner")
        .groupBy("category")
        .agg(F.count_distinct("order_number").alias("total_orders"))
        .withColumn("true_overall_orders", overall)
        .withColumn(
            "percentage_of_total", percent_text(F.col("total_orders"), F.col("true_overall_orders"))
        )
        .orderBy(F.desc("total_orders"), "category")
    )


def customer_penetration(star: Star, config: Config) -> DataFrame:
    """Share of all buyers per category; unsold categories show 0%."""
    overall = star.sales.agg(F.count_distinct("customer_key")).scalar()
    placed = _categorised(star)
    pairs = star.sales.select("product_key", "customer_key").distinct()
    buyers = (
        looked_up(pairs, "product_key", placed, star.sales, F.col("customer_key"), "inner")
        .groupBy("category")
        .agg(F.count_distinct("customer_key").alias("buyers"))
    )
    return (
        placed.select("category")
        .distinct()
        .join(buyers, "category", "left")
        .select(
            "category",
            F.coalesce("buyers", F.lit(0)).alias("unique_category_customers"),
            overall.alias("total_distinct_store_customers"),
        )
        .withColumn(
            "customer_penetration_rate",
            percent_text(
                F.col("unique_category_customers"), F.col("total_distinct_store_customers")
            ),
        )
        .orderBy(F.desc("unique_category_customers"), "category")
    )
