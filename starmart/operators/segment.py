"""Counts per cost range and per customer segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.config import Config
from starmart.functions import labels
from starmart.functions.semantics import band, dated, months_between_calendars
from starmart.schema import Star


def cost_ranges(star: Star, config: Config) -> DataFrame:
    """Products per cost range; a missing cost belongs to the last one."""
    steps = [
        (config.cost_low, labels.COST_LOW),
        (config.cost_mid, labels.COST_MID),
        (config.cost_high, labels.COST_HIGH),
    ]
    return (
        star.products.groupBy(band(F.col("cost"), steps, labels.COST_TOP).alias("cost_range"))
        .agg(F.count("product_key").alias("total_products"))
        .orderBy(F.desc("total_products"), "cost_range")
    )


def newcomer_segment(idle: Column, spend: Column, config: Config, cold: Column) -> Column:
    """Segment of a young account; NULL where no rule holds."""
    active = idle <= config.active_months
    return (
        F.when(active & (spend > config.vip_spend), labels.NEW_VIP)
        .when(active & (spend >= config.growth_spend), labels.GROWTH_DRIVER)
        .when(active & (spend < config.growth_spend), labels.STANDARD_NEW)
        .when(cold, labels.COLD_LEAD)
    )


def is_core_vip(tenure: Column, idle: Column, spend: Column, config: Config) -> Column:
    return (
        (tenure >= config.settled_months)
        & (idle <= config.active_months)
        & (spend > config.vip_spend)
    )


def inactive_segment(idle: Column, config: Config) -> Column:
    return F.when(idle >= config.lost_months, labels.LOST).when(
        idle >= config.slipping_months, labels.AT_RISK
    )


def account_segment(tenure: Column, idle: Column, spend: Column, config: Config) -> Column:
    """Segment from months since the first and the last order, and the spend."""
    young = tenure <= config.new_months
    cold = idle == config.active_months + 1
    return F.coalesce(
        F.when(is_core_vip(tenure, idle, spend, config), labels.CORE_VIP),
        F.when(young, newcomer_segment(idle, spend, config, cold)),
        inactive_segment(idle, config),
        F.lit(labels.REGULAR),
    )


def customer_segments(star: Star, config: Config) -> DataFrame:
    """Customers per segment; sales of unknown customers form one uncounted group.

    First order, last order and spend combine over keys, so sales are reduced to
    one row per key before the customers are joined.
    """
    anchor = F.lit(config.segment_anchor)
    known = star.customers.select(F.col("customer_key").alias("known_key"))
    accounts = (
        dated(star.sales)
        .groupBy("customer_key")
        .agg(
            F.min("order_date").alias("first_order"),
            F.max("order_date").alias("last_order"),
            F.sum("sales_amount").alias("spend"),
        )
        .join(known, F.col("customer_key") == F.col("known_key"), "left")
        .groupBy("known_key")
        .agg(
            F.min("first_order").alias("first_order"),
            F.max("last_order").alias("last_order"),
            F.sum("spend").alias("spend"),
        )
    )
    segment = account_segment(
        months_between_calendars(F.col("first_order"), anchor),
        months_between_calendars(F.col("last_order"), anchor),
        F.col("spend"),
        config,
    )
    return (
        accounts.groupBy(segment.alias("detailed_customer_segment"))
        .agg(F.count("known_key").alias("total_customers"))
        .orderBy(F.desc("total_customers"), "detailed_customer_segment")
    )
