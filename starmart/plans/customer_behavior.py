"""Customer report: one row per customer with a dated sale.

All sales whose customer is unknown make one more row without a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.config import Config
from starmart.functions import labels
from starmart.functions.semantics import (
    band,
    dated,
    display_name,
    growth,
    in_year,
    months_between_calendars,
    ratio,
    years_between_calendars,
)
from starmart.operators.distincts import Cells
from starmart.operators.heavy import looked_up
from starmart.operators.known import distinct_items, resolved, shared_item
from starmart.operators.segment import inactive_segment, is_core_vip, newcomer_segment
from starmart.schema import Star


def bought_cells(config: Config) -> Cells:
    """Sums per customer and product, and the orders of a customer, over dated sales."""
    day, amount = F.col("order_date"), F.col("sales_amount")
    return Cells(
        by={"customer_key": F.col("customer_key")},
        measures={
            "spend": (F.sum, amount),
            "units": (F.sum, F.col("quantity")),
            "first_order": (F.min, day),
            "last_order": (F.max, day),
            "prior": (F.sum, in_year(amount, day, config.prior_year)),
            "current": (F.sum, in_year(amount, day, config.current_year)),
        },
        items={"product_key": F.col("product_key"), "order_number": F.col("order_number")},
        carrier="product_key",
    )


def spend_by_category(cells: DataFrame, star: Star, source: DataFrame) -> DataFrame:
    """Spend, products and orders per known customer and category.

    Sales come reduced to (customer, product) and (customer, order), so neither a
    frequent customer nor a best-seller reaches a join as many sales. Heavy keys are
    sought in ``source``, the stored rows that the cells come from.
    """
    category = star.products.select("product_key", "category")
    known = resolved(cells, star, source, F.coalesce("order_number", F.col("product_key").cast("string")))
    return (
        looked_up(known, "product_key", category, source, F.struct("customer_key", "order_number"))
        .groupBy(
            "known_key",
            "category",
            shared_item("product_key").alias("shared_product"),
            shared_item("order_number").alias("shared_order"),
        )
        .agg(
            F.sum("spend").alias("spend"),
            F.sum("units").alias("units"),
            F.min("first_order").alias("first_order"),
            F.max("last_order").alias("last_order"),
            F.sum("prior").alias("prior"),
            F.sum("current").alias("current"),
            F.count("product_key").alias("product_rows"),
            F.count("order_number").alias("order_rows"),
        )
        .withColumn("products", distinct_items("product_rows"))
        .withColumn("orders", distinct_items("order_rows"))
    )


def customer_totals(cells: DataFrame, star: Star, source: DataFrame) -> DataFrame:
    """One row per known customer, and one for all unknown ones."""
    # Highest spend first, then the category that sorts first.
    choice = F.struct(F.col("spend").isNull(), -F.col("spend"), F.col("category").alias("name"))
    per_category = spend_by_category(cells, star, source).groupBy("known_key", "category").agg(
        *[F.sum(n).alias(n) for n in ("spend", "units", "prior", "current", "products", "orders")],
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
    )
    return per_category.groupBy("known_key").agg(
        F.sum("spend").alias("total_sales"),
        F.sum("units").alias("total_quantity"),
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order_date"),
        F.sum("prior").alias("prior"),
        F.sum("current").alias("current"),
        F.sum("products").alias("total_products"),
        F.sum("orders").alias("total_orders"),
        F.min(F.when(F.col("category").isNotNull(), choice)).alias("best"),
    )


def report_segment(tenure: Column, idle: Column, spend: Column, config: Config) -> Column:
    """Like ``segment.account_segment`` with the regular base split by spend."""
    young = tenure <= config.new_months
    steady = ~young & (idle < config.slipping_months)
    return F.coalesce(
        F.when(is_core_vip(tenure, idle, spend, config), labels.CORE_VIP),
        F.when(young, newcomer_segment(idle, spend, config, idle > config.active_months)),
        inactive_segment(idle, config),
        F.when(steady & (spend > config.vip_spend), labels.COOLING_VIP),
        F.when(steady & (spend <= config.vip_spend), labels.REGULAR_CORE),
        F.lit(labels.UNSEGMENTED),
    )


def customer_behavior(star: Star, config: Config) -> DataFrame:
    sales = dated(star.sales)
    return report(bought_cells(config).of(sales), star, config, sales)


def report(cells: DataFrame, star: Star, config: Config, source: DataFrame) -> DataFrame:
    """The report from the cells of the dated sales, which come from the rows of ``source``."""
    person = star.customers.select(
        "customer_key", "customer_number", "first_name", "last_name", "birthdate"
    )
    rows = customer_totals(cells, star, source).join(
        person, F.col("known_key") == F.col("customer_key"), "left"
    )

    anchor = F.lit(config.report_anchor)
    age = years_between_calendars(F.col("birthdate"), anchor)
    spend, first, last = F.col("total_sales"), F.col("first_order"), F.col("last_order_date")
    lifespan = months_between_calendars(first, last)
    tenure = months_between_calendars(first, anchor)
    idle = months_between_calendars(last, anchor)

    def known_only(column: Column, default) -> Column:
        """Yearly sales and preference are not reported for unknown customers."""
        known = F.when(F.col("known_key").isNotNull(), column)
        return F.coalesce(known, F.lit(default))

    prior, current = known_only(F.col("prior"), 0), known_only(F.col("current"), 0)
    loyalty = [
        (config.new_months, labels.NEW_RELATIONSHIP),
        (config.mid_stage_months, labels.MID_RELATIONSHIP),
    ]
    return rows.select(
        "customer_key",
        "customer_number",
        display_name(F.col("first_name"), F.col("last_name")).alias("customer_name"),
        age.alias("age"),
        band(age, labels.AGE_GROUPS, labels.AGE_OLDEST, labels.AGE_UNKNOWN).alias("age_groups"),
        "total_sales",
        "total_orders",
        "total_quantity",
        "total_products",
        F.round(F.coalesce(ratio(spend, F.col("total_orders")), F.lit(0.0)), 2).alias(
            "avg_order_value"
        ),
        "last_order_date",
        lifespan.alias("lifespan_months"),
        F.round(F.coalesce(ratio(spend, lifespan + 1), F.lit(0.0)), 2).alias("avg_monthly_spend"),
        prior.alias(f"sales_{config.prior_year}"),
        current.alias(f"sales_{config.current_year}"),
        growth(prior, current).alias("customer_yoy_sales_growth_rate"),
        known_only(F.col("best.name"), labels.NO_CATEGORY).alias("preferred_product_category"),
        band(tenure, loyalty, labels.OLD_RELATIONSHIP).alias("customer_loyalty_tier"),
        report_segment(tenure, idle, spend, config).alias("detailed_customer_segment"),
    )
