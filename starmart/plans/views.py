"""Named relations for SQL users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starmart.config import Config
from starmart.plans.customer_behavior import customer_behavior
from starmart.plans.product_performance import product_performance
from starmart.schema import Star
from starmart.sources import versions

REPORTS = {
    "v_product_performance_report": product_performance,
    "v_customer_behavior_report": customer_behavior,
}


def register(star: Star, config: Config) -> dict[str, DataFrame]:
    """The three tables and the two reports as temporary views.

    A view is a plan, not a result: every query on it reads the current tables.
    """
    named = star.tables() | {name: report(star, config) for name, report in REPORTS.items()}
    for name, rows in named.items():
        rows.createOrReplaceTempView(name)
    return named


def materialise(star: Star, config: Config, root: str) -> None:
    """Replace the stored results of both reports below ``root``, both at once."""
    with versions.replacing(star.sales.sparkSession, root) as folder:
        for name, report in REPORTS.items():
            report(star, config).write.parquet(f"{folder}/{name}")


def stored(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The reports that ``materialise`` stored last, by name."""
    folder = versions.current(spark, root)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in REPORTS}
