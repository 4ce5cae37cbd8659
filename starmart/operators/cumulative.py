"""Running totals over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmart.config import Config
from starmart.functions.semantics import dated, whole_mean, whole_ratio
from starmart.schema import Star


def _running_mean(value: str, window) -> Column:
    """Integer mean of the period means so far (periods weigh the same)."""
    return whole_ratio(F.sum(value).over(window), F.count(value).over(window)).cast("int")


def _periods(star: Star, unit: str, name: str) -> DataFrame:
    return (
        dated(star.sales)
        .groupBy(F.trunc("order_date", unit).alias(name))
        .agg(F.sum("sales_amount").alias("total_sales"), whole_mean(F.col("price")).alias("mean"))
    )


def _lifetime(star: Star, unit: str, name: str) -> DataFrame:
    # One row per period reaches the window: its size is that of the calendar.
    window = Window.partitionBy(F.lit(0)).orderBy(name)
    return _periods(star, unit, name).select(
        name,
        "total_sales",
        F.sum("total_sales").over(window).alias("running_total_sales"),
        _running_mean("mean", window).alias("rolling_average_price"),
    )


def annual(star: Star, config: Config) -> DataFrame:
    return _lifetime(star, "YEAR", "order_year")


def monthly(star: Star, config: Config) -> DataFrame:
    return _lifetime(star, "MONTH", "order_month")


def year_to_date(star: Star, config: Config) -> DataFrame:
    window = Window.partitionBy(F.year("order_month")).orderBy("order_month")
    return _periods(star, "MONTH", "order_month").select(
        "order_month",
        "total_sales",
        F.sum("total_sales").over(window).alias("ytd_running_sales"),
        _running_mean("mean", window).alias("ytd_rolling_avg_price"),
    )


def spender(rows: DataFrame) -> DataFrame:
    """``rows`` with the customer as two columns without nulls: unknown ones are one group."""
    return rows.withColumn("spender", F.coalesce("customer_key", F.lit(0))).withColumn(
        "known", F.col("customer_key").isNotNull()
    )


def _plus(total: Column, more: Column) -> Column:
    """A sum that is missing only if both parts are."""
    return F.when(total.isNull(), more).otherwise(total + F.coalesce(more, F.lit(0)))


def spend_rows(sales: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Spend up to and including each dated sale of ``spender(sales)``.

    A row's total is what the customer had spent before that day, from a window
    over day totals that the calendar bounds, plus the day's orders so far. No
    task holds more of a customer's sales than one day of them. The two key columns
    let both sides of the join share the shuffle of the window. ``carried`` has the
    balances (spender, known, balance) that the customers had before all of these sales.
    """
    key = ["spender", "known", "order_date"]
    earlier = (
        Window.partitionBy("spender", "known")
        .orderBy("order_date")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    opening = (
        sales.groupBy(*key)
        .agg(F.sum("sales_amount").alias("day_total"))
        .select(*key, F.sum("day_total").over(earlier).alias("opening"))
    )
    if carried is not None:
        opening = opening.join(carried, ["spender", "known"], "left").select(
            *key, _plus(F.col("balance"), F.col("opening")).alias("opening")
        )
    # Rows of one order are peers: the frame ends with the last of them.
    today = F.sum("sales_amount").over(Window.partitionBy(*key).orderBy("order_number"))
    spent = _plus(F.col("opening"), F.col("today"))
    return (
        sales.withColumn("today", today)
        .join(opening, key)
        .select("customer_key", "order_date", "order_number", spent.alias("cumulative_spend"))
    )


def customer_spend(star: Star, config: Config) -> DataFrame:
    """Spend of every customer up to and including each sales row."""
    sales = dated(star.sales).select("customer_key", "order_date", "order_number", "sales_amount")
    return spend_rows(spender(sales))


def product_units(star: Star, config: Config) -> DataFrame:
    """Units of every product per month and up to that month.

    A product has at most one row per month in the window. Cutting the rows by
    ranges of products serves the window and the final order with one shuffle.
    """
    window = Window.partitionBy("product_key").orderBy("order_month")
    return (
        dated(star.sales)
        .groupBy("product_key", F.trunc("order_date", "MONTH").alias("order_month"))
        .agg(F.sum("quantity").alias("monthly_units_sold"))
        .repartitionByRange("product_key")
        .withColumn("cumulative_units_sold", F.sum("monthly_units_sold").over(window))
        .orderBy("product_key", "order_month")
    )
