"""Totals by country, product, category and customer.

Sales are reduced to one row per own key before they meet a dimension. A key
that holds a large part of all sales is then a single row in the join, and the
join moves keys instead of sales. Sorted results end in a unique key: the order
is repeatable, and a long run of equal totals can be cut between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.config import Config
from starmart.functions.semantics import whole_mean
from starmart.operators.heavy import looked_up
from starmart.schema import Star

PATH = ["product_name", "category", "subcategory"]


def per_key(sales: DataFrame, key: str, **measures: Column) -> DataFrame:
    return sales.groupBy(key).agg(*[m.alias(name) for name, m in measures.items()])


def amount_by_customer(star: Star) -> DataFrame:
    return per_key(star.sales, "customer_key", amount=F.sum("sales_amount"))


def amount_by_product(star: Star) -> DataFrame:
    return per_key(star.sales, "product_key", amount=F.sum("sales_amount"))


def sales_rows_by_product(star: Star) -> DataFrame:
    return per_key(star.sales, "product_key", sold=F.count(F.lit(1)))


def customers_by_country(star: Star, config: Config) -> DataFrame:
    return (
        star.customers.groupBy("country")
        .agg(F.count("customer_id").alias("total_customers"))
        .orderBy(F.desc("total_customers"), "country")
    )


def customers_by_gender(star: Star, config: Config) -> DataFrame:
    return (
        star.customers.groupBy("gender")
        .agg(F.count("customer_id").alias("total_customers"))
        .orderBy(F.desc("total_customers"), "gender")
    )


def products_by_subcategory(star: Star, config: Config) -> DataFrame:
    return (
        star.products.groupBy("category", "subcategory")
        .agg(F.count("product_id").alias("unique_products_count"))
        .orderBy("category", F.desc("unique_products_count"), "subcategory")
    )


def orders_by_country(star: Star, config: Config) -> DataFrame:
    """Distinct orders do not add up over customers, so (customer, order) pairs
    meet the dimension; those of a very frequent customer are not brought together.
    """
    pairs = star.sales.select("customer_key", "order_number").distinct()
    country = star.customers.select("customer_key", "country")
    return (
        looked_up(pairs, "customer_key", country, star.sales, F.col("order_number"))
        .groupBy("country")
        .agg(F.count_distinct("order_number").alias("total_orders"))
        .orderBy(F.desc("total_orders"), "country")
    )


def revenue_by_country(star: Star, config: Config) -> DataFrame:
    return (
        amount_by_customer(star)
        .join(star.customers.select("customer_key", "country"), "customer_key", "left")
        .groupBy("country")
        .agg(F.sum("amount").alias("total_sales_amount"))
        .orderBy(F.desc("total_sales_amount"), "country")
    )


def revenue_by_product(star: Star, config: Config) -> DataFrame:
    path = ["product_line", "category", "subcategory", "product_name"]
    return (
        amount_by_product(star)
        .join(star.products.select("product_key", *path), "product_key", "left")
        .groupBy(*path)
        .agg(F.sum("amount").alias("total_sales_amount"))
        .orderBy(F.desc("total_sales_amount"), *path)
    )


def times_sold(star: Star, config: Config) -> DataFrame:
    return (
        sales_rows_by_product(star)
        .join(star.products.select("product_key", *PATH), "product_key")
        .groupBy(*PATH)
        .agg(F.sum("sold").alias("times_sold"))
        .orderBy(F.desc("times_sold"), *PATH)
    )


def _catalog_sales(star: Star) -> DataFrame:
    """Sales rows per catalogue path; products on one path count together."""
    return (
        star.products.select("product_key", *PATH)
        .join(sales_rows_by_product(star), "product_key", "left")
        .groupBy(*PATH)
        .agg(F.coalesce(F.sum("sold"), F.lit(0)).alias("times_sold"))
    )


def never_sold(star: Star, config: Config) -> DataFrame:
    """Catalogue paths none of whose products was ever sold."""
    return (
        _catalog_sales(star)
        .where(F.col("times_sold") == 0)
        .select(*PATH)
        .orderBy("category", "product_name", "subcategory")
    )


def sold_status(star: Star, config: Config) -> DataFrame:
    status = F.when(F.col("times_sold") == 0, "Unsold").otherwise("Sold")
    return (
        _catalog_sales(star)
        .withColumn("product_status", status)
        .orderBy(F.desc("product_status"), F.desc("times_sold"), *PATH)
    )


def average_cost_by_category(star: Star, config: Config) -> DataFrame:
    return (
        star.products.groupBy("category")
        .agg(whole_mean(F.col("cost")).alias("avg_cost"))
        .orderBy(F.desc("avg_cost"), "category")
    )


def revenue_by_category(star: Star, config: Config) -> DataFrame:
    return (
        amount_by_product(star)
        .join(star.products.select("product_key", "category"), "product_key", "left")
        .groupBy("category")
        .agg(F.sum("amount").alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "category")
    )


def customer_revenue(star: Star) -> DataFrame:
    """Revenue per known customer; all other sales make one row without a key."""
    person = ["customer_key", "first_name", "last_name"]
    known = star.customers.select(*person).withColumnRenamed("customer_key", "known_key")
    return (
        amount_by_customer(star)
        .join(known, F.col("customer_key") == F.col("known_key"), "left")
        .groupBy(F.col("known_key").alias("customer_key"), "first_name", "last_name")
        .agg(F.sum("amount").alias("total_revenue"))
    )


def revenue_by_customer(star: Star, config: Config) -> DataFrame:
    return customer_revenue(star).orderBy(F.desc("total_revenue"), "customer_key")


def items_by_country(star: Star, config: Config) -> DataFrame:
    return (
        per_key(star.sales, "customer_key", items=F.sum("quantity"))
        .join(star.customers.select("customer_key", "country"), "customer_key", "left")
        .groupBy("country")
        .agg(F.sum("items").alias("total_sold_items"))
        .orderBy(F.desc("total_sold_items"), "country")
    )
