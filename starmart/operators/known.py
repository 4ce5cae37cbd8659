"""Sales seen from the customer dimension.

Sales whose customer is missing or unknown belong to one common group with a
NULL key. Rows are reduced per own key first and get ``known_key`` by a left
join, so that a frequent customer does not meet the join as many sales.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.operators.heavy import looked_up
from starmart.schema import Star


def resolved(rows: DataFrame, star: Star, source: DataFrame, spread: Column) -> DataFrame:
    """``known_key``: the customer key where the customer exists, else NULL.

    ``spread`` deals the rows of a very frequent customer to many tasks; customers are
    weighed by their rows in ``source``.
    """
    known = star.customers.select("customer_key", F.col("customer_key").alias("known_key"))
    return looked_up(rows, "customer_key", known, source, spread)


def shared_item(item: str) -> Column:
    """Keeps rows of unknown customers apart by item.

    A known customer has one row per item, so those rows are just counted.
    Unknown customers can share an item; it must count once for all of them.
    """
    return F.when(F.col("known_key").isNull(), F.col(item)).alias("shared_item")


def distinct_items(rows: str) -> Column:
    """Distinct items behind ``rows`` counted under ``shared_item``."""
    return F.when(F.col("known_key").isNull(), F.least(rows, F.lit(1))).otherwise(F.col(rows))


def orders_by_known_customer(sales: DataFrame, star: Star) -> DataFrame:
    """Distinct orders per known customer; unknown ones keep a row per order."""
    pairs = sales.select("customer_key", "order_number").distinct()
    return (
        resolved(pairs, star, sales, F.col("order_number"))
        .groupBy("known_key", shared_item("order_number"))
        .agg(F.count("order_number").alias("order_rows"))
        .select("known_key", distinct_items("order_rows").alias("orders"))
    )
