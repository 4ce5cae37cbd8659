"""Product report: one row per product of the catalogue or of the sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.config import Config
from starmart.functions import labels
from starmart.functions.semantics import (
    band,
    dated,
    growth,
    in_year,
    months_between_calendars,
    ratio,
)
from starmart.operators.distincts import Cells
from starmart.schema import Star


def sold_cells(config: Config) -> Cells:
    """Sums, orders and customers of a product, over dated sales."""
    day, amount = F.col("order_date"), F.col("sales_amount")
    return Cells(
        by={"product_key": F.col("product_key")},
        measures={
            "first_sale_date": (F.min, day),
            "last_sale_date": (F.max, day),
            "total_sales": (F.sum, amount),
            "total_quantity": (F.sum, F.col("quantity")),
            "prior_sales": (F.sum, in_year(amount, day, config.prior_year)),
            "current_sales": (F.sum, in_year(amount, day, config.current_year)),
        },
        items={"total_orders": F.col("order_number"), "total_customers": F.col("customer_key")},
    )


def sales_summary(sales: DataFrame, config: Config) -> DataFrame:
    """One row per product key of the dated sales.

    What moves are sums, combined on the map side, and narrow (product, order) and
    (product, customer) pairs, hashed by both columns, so a best-seller is spread over
    tasks.
    """
    sold = sold_cells(config)
    return sold.totals(sold.of(dated(sales)))


def _obsolescence(config: Config) -> Column:
    steps = [
        (config.recency_active, labels.FAST_MOVING),
        (config.recency_slow, labels.SLOW_MOVING),
        (config.recency_at_risk, labels.NEAR_OBSOLETE),
    ]
    by_recency = band(F.col("recency"), steps, labels.OBSOLETE, labels.UNMAPPED_SALE)
    unsold = F.col("in_catalog") & (F.col("total_sales") == 0)
    return F.when(unsold, labels.DEAD_STOCK).otherwise(by_recency)


def _lifetime_tier(config: Config) -> Column:
    steps = [
        (config.sales_mid_from - 1, labels.SALES_LOW),
        (config.sales_high_above, labels.SALES_MID),
    ]
    return band(F.col("total_sales"), steps, labels.SALES_HIGH)


def _lifespan_tier(config: Config) -> Column:
    steps = [
        (config.lifespan_short, labels.SHORT_RUN),
        (config.lifespan_standard, labels.STANDARD_RUN),
    ]
    burst = (F.coalesce("lifespan", F.lit(0)) == 0) & (F.col("total_orders") > 1)
    return (
        F.when(F.col("total_sales") == 0, labels.UNSOLD_ITEM)
        .when(burst, labels.SINGLE_MONTH)
        .otherwise(band(F.col("lifespan"), steps, labels.EXTENDED_RUN))
    )


def _margin_segment(config: Config) -> Column:
    margin = ratio(F.col("profit"), F.col("total_sales"))
    return (
        F.when(F.col("total_sales") == 0, labels.MARGIN_NONE)
        .when(~F.col("in_catalog"), labels.COST_MISSING)
        .when(margin > config.margin_high_above, labels.MARGIN_HIGH)
        .when(margin >= config.margin_stable_from, labels.MARGIN_STABLE)
        .when(margin > 0, labels.MARGIN_LOW)
        .otherwise(labels.MARGIN_LOSS)
    )


def _profit_segment(config: Config) -> Column:
    steps = [
        (-1, labels.PROFIT_DRAIN),
        (config.profit_steady_from - 1, labels.PROFIT_MINOR),
        (config.profit_massive_above, labels.PROFIT_STEADY),
    ]
    return F.when(~F.col("in_catalog"), labels.COST_MISSING).otherwise(
        band(F.col("profit"), steps, labels.PROFIT_MASSIVE)
    )


def _frequency_tier(config: Config) -> Column:
    steps = [
        (0, labels.NEVER_BOUGHT),
        (1, labels.BOUGHT_ONCE),
        (config.occasional_orders, labels.BOUGHT_SOMETIMES),
    ]
    return band(F.col("total_orders"), steps, labels.BOUGHT_OFTEN)


def product_performance(star: Star, config: Config) -> DataFrame:
    return report(sales_summary(star.sales, config), star.products, config)


def report(summary: DataFrame, products: DataFrame, config: Config) -> DataFrame:
    """The report from one row of totals per sold product key."""
    summary = summary.withColumnRenamed("product_key", "sold_key")
    catalog = products.select("product_key", "product_name", "category", "subcategory", "cost")
    joined = catalog.join(summary, F.col("product_key") == F.col("sold_key"), "full")

    def or_zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).alias(name)

    first, last = F.col("first_sale_date"), F.col("last_sale_date")
    cost_of_sales = F.coalesce(F.col("cost") * F.col("total_quantity"), F.lit(0))
    facts = joined.select(
        F.coalesce("product_key", "sold_key").alias("product_key"),
        F.coalesce("product_name", F.lit(labels.UNKNOWN_PRODUCT)).alias("product_name"),
        F.coalesce("category", F.lit(labels.UNASSIGNED)).alias("category"),
        F.coalesce("subcategory", F.lit(labels.UNASSIGNED)).alias("subcategory"),
        or_zero("cost"),
        *map(
            or_zero,
            [
                "total_sales",
                "total_quantity",
                "total_orders",
                "total_customers",
                "prior_sales",
                "current_sales",
            ],
        ),
        last,
        (F.coalesce("total_sales", F.lit(0)) - cost_of_sales).alias("profit"),
        months_between_calendars(first, last).alias("lifespan"),
        months_between_calendars(last, F.lit(config.report_anchor)).alias("recency"),
        F.col("product_key").isNotNull().alias("in_catalog"),
    )

    sales, orders = F.col("total_sales"), F.col("total_orders")
    months = F.coalesce("lifespan", F.lit(0)) + 1
    prior, current = F.col("prior_sales"), F.col("current_sales")
    return facts.select(
        "product_key",
        "product_name",
        "category",
        "subcategory",
        "cost",
        "last_sale_date",
        F.col("recency").alias("recency_in_months"),
        _obsolescence(config).alias("product_obsolescence_status"),
        _lifetime_tier(config).alias("lifetime_sales_tier"),
        _lifespan_tier(config).alias("active_lifespan_tier"),
        _margin_segment(config).alias("product_margin_segment"),
        _profit_segment(config).alias("product_profit_volume_segment"),
        _frequency_tier(config).alias("purchase_frequency_tier"),
        "total_sales",
        "total_quantity",
        "total_orders",
        "total_customers",
        F.col("lifespan").alias("lifespan_months"),
        F.round(ratio(sales, F.col("total_quantity")), 1).alias("avg_selling_price"),
        F.round(F.coalesce(ratio(sales, orders), F.lit(0.0)), 2).alias("avg_order_revenue"),
        F.round(ratio(sales, months), 2).alias("avg_monthly_revenue"),
        prior.alias(f"sales_{config.prior_year}"),
        current.alias(f"sales_{config.current_year}"),
        growth(prior, current).alias("product_yoy_sales_growth_rate"),
    )
