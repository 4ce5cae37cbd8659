"""Ranked lists of customers, products and catalogue groups.

Lists that keep only the first ranks look at distinct values before rows, so
that no number of ties meets in one task. Ranks over every product use
``spread.rank_descending``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starmart.config import Config
from starmart.functions.semantics import within, year_bounds
from starmart.operators.known import orders_by_known_customer
from starmart.operators.magnitude import (
    amount_by_customer,
    amount_by_product,
    per_key,
)
from starmart.operators.spread import rank_descending
from starmart.schema import Star


def _leading(
    rows: DataFrame, by: list[str], value: str, name: str, last: int, dense: bool = False
) -> DataFrame:
    """Rows whose (dense) rank by ``value``, high to low within ``by``, is at most ``last``.

    A rank of at most ``last`` belongs to one of the ``last`` highest distinct
    values. Those few values are ranked by the rows they stand for; the rows are
    then looked up by value. The window and the broadcast hold ``last`` values
    per group, however many rows share them.
    """
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(value))
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    higher_rows = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    highest = (
        rows.groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_place", F.row_number().over(window))
        .where(F.col("_place") <= last)
        .withColumn(name, F.col("_place").cast("bigint") if dense else higher_rows + 1)
        .where(F.col(name) <= last)
        .select(*[F.col(c).alias(f"_{c}") for c in [*by, value]], name)
    )
    matches = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, value]]
    return rows.join(F.broadcast(highest), reduce(and_, matches)).select(*rows.columns, name)


def _customers_in_year(star: Star, config: Config, name: str, dense: bool) -> DataFrame:
    """The leading known customers of one year; names are looked up for these only."""
    # The year is fixed before the ranking, so only its sales are read.
    year = within(star.sales, *year_bounds(config.ranking_year))
    revenue = (
        amount_by_customer(Star(year, star.customers, star.products))
        .join(star.customers.select("customer_key"), "customer_key", "left_semi")
        .select("customer_key", F.col("amount").alias("total_revenue"))
    )
    leading = _leading(revenue, [], "total_revenue", name, config.top_customers, dense)
    person = star.customers.select("customer_key", "first_name", "last_name")
    return leading.join(person, "customer_key").select(
        F.lit(config.ranking_year).alias("sales_year"),
        "customer_key",
        "first_name",
        "last_name",
        "total_revenue",
        name,
    )


def customers_in_year(star: Star, config: Config) -> DataFrame:
    return _customers_in_year(star, config, "rank_customers", dense=False)


def customers_in_year_dense(star: Star, config: Config) -> DataFrame:
    return _customers_in_year(star, config, "dense_rank_customers", dense=True)


def _product_profit_by_year(star: Star) -> DataFrame:
    """Revenue minus cost of the units sold; a NULL year is a year of its own."""
    return (
        star.sales.select(
            F.year("order_date").alias("sales_year"), "product_key", "sales_amount", "quantity"
        )
        .groupBy("sales_year", "product_key")
        .agg(F.sum("sales_amount").alias("amount"), F.sum("quantity").alias("units"))
        .join(star.products.select("product_key", "product_name", "cost"), "product_key")
        .select(
            "sales_year",
            "product_key",
            "product_name",
            (F.col("amount") - F.col("cost") * F.col("units")).alias("total_profit"),
        )
    )


def products_per_year(star: Star, config: Config) -> DataFrame:
    return _leading(
        _product_profit_by_year(star),
        ["sales_year"],
        "total_profit",
        "rank_products",
        config.top_products,
    )


def products_per_year_dense(star: Star, config: Config) -> DataFrame:
    return _leading(
        _product_profit_by_year(star),
        ["sales_year"],
        "total_profit",
        "dense_rank_products",
        config.top_products,
        dense=True,
    )


def products_by_profit(star: Star, config: Config) -> DataFrame:
    """Every product name by profit over all sales."""
    profit = (
        per_key(
            star.sales, "product_key", amount=F.sum("sales_amount"), units=F.sum("quantity")
        )
        .join(star.products.select("product_key", "product_name", "cost"), "product_key")
        .groupBy("product_name")
        .agg((F.sum("amount") - F.sum(F.col("cost") * F.col("units"))).alias("profit"))
    )
    return rank_descending(profit, "profit", "rank_profit")


def products_in_quarter(star: Star, config: Config) -> DataFrame:
    """Every product name by revenue within its calendar quarter, years merged."""
    revenue = (
        star.sales.select(F.quarter("order_date").alias("quarter"), "product_key", "sales_amount")
        .groupBy("quarter", "product_key")
        .agg(F.sum("sales_amount").alias("amount"))
        .join(star.products.select("product_key", "product_name"), "product_key")
        .groupBy("quarter", "product_name")
        .agg(F.sum("amount").alias("total_revenue"))
    )
    return rank_descending(revenue, "total_revenue", "rank_in_quarter", by=["quarter"])


def _ranked_groups(star: Star, attribute: str, name: str) -> DataFrame:
    revenue = (
        amount_by_product(star)
        .join(star.products.select("product_key", attribute), "product_key")
        .groupBy(attribute)
        .agg(F.sum("amount").alias("total_revenue"))
    )
    # One row per catalogue group: the window never holds more than the taxonomy.
    window = Window.partitionBy(F.lit(0)).orderBy(F.desc("total_revenue"))
    return revenue.withColumn(name, F.rank().over(window).cast("bigint"))


def categories(star: Star, config: Config) -> DataFrame:
    return _ranked_groups(star, "category", "rank_category")


def subcategories(star: Star, config: Config) -> DataFrame:
    return _ranked_groups(star, "subcategory", "rank_subcategory")


def product_name_revenue(star: Star) -> DataFrame:
    """Revenue per product name; sales of unknown products have the NULL name."""
    return (
        amount_by_product(star)
        .join(star.products.select("product_key", "product_name"), "product_key", "left")
        .groupBy("product_name")
        .agg(F.sum("amount").alias("total_revenue"))
    )


def top_products(star: Star, config: Config) -> DataFrame:
    return (
        product_name_revenue(star)
        .orderBy(F.desc("total_revenue"), "product_name")
        .limit(config.top_products)
    )


def top_products_ranked(star: Star, config: Config) -> DataFrame:
    return _leading(
        product_name_revenue(star),
        [],
        "total_revenue",
        "rank_products",
        config.top_products,
    )


def bottom_products(star: Star, config: Config) -> DataFrame:
    return (
        product_name_revenue(star)
        .orderBy("total_revenue", "product_name")
        .limit(config.top_products)
    )


def top_customers(star: Star, config: Config) -> DataFrame:
    """Names are looked up after the list is cut; unknown customers are one row."""
    known = star.customers.select(F.col("customer_key").alias("known_key"))
    highest = (
        amount_by_customer(star)
        .join(known, F.col("customer_key") == F.col("known_key"), "left")
        .groupBy("known_key")
        .agg(F.sum("amount").alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "known_key")
        .limit(config.top_customers)
    )
    person = star.customers.select("customer_key", "first_name", "last_name")
    return (
        highest.join(person, F.col("known_key") == F.col("customer_key"), "left")
        .select("customer_key", "first_name", "last_name", "total_revenue")
        .orderBy(F.desc("total_revenue"), "customer_key")
    )


def customers_with_fewest_orders(star: Star, config: Config) -> DataFrame:
    """Names are looked up after the list is cut to its length."""
    fewest = (
        orders_by_known_customer(star.sales, star)
        .groupBy("known_key")
        .agg(F.sum("orders").alias("total_orders"))
        .orderBy("total_orders", "known_key")
        .limit(config.idle_customers)
    )
    person = star.customers.select("customer_key", "first_name", "last_name")
    return (
        fewest.join(person, F.col("known_key") == F.col("customer_key"), "left")
        .select("customer_key", "first_name", "last_name", "total_orders")
        .orderBy("total_orders", "customer_key")
    )
