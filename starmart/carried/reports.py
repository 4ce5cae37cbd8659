"""The two reports kept up from load to load.

A load adds the cells of its own sales: sums per product and per customer and product,
and the distinct pairs that the reports count. Reports merge the cells of all loads and
read no sales; ``compact`` puts the cells of many loads together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starmart.carried.parts import Parts
from starmart.config import Config
from starmart.functions.semantics import dated
from starmart.operators.distincts import Cells
from starmart.plans import customer_behavior, product_performance
from starmart.schema import SALES, Star


def _kinds(config: Config) -> dict[str, Cells]:
    return {
        "sold": product_performance.sold_cells(config),
        "bought": customer_behavior.bought_cells(config),
    }


def add_load(spark: SparkSession, root: str, sales: DataFrame, config: Config) -> int:
    """Take the sales of one more load; each sale belongs to one load. Its number."""

    def write(folder: str, number: int) -> None:
        for name, cells in _kinds(config).items():
            cells.of(dated(sales)).write.parquet(f"{folder}/{name}")

    return Parts(spark, root).add(write)


def _stored(spark: SparkSession, root: str, name: str, config: Config) -> DataFrame:
    schema = _kinds(config)[name].of(spark.createDataFrame([], SALES)).schema
    return Parts(spark, root).read(name, schema).drop("load")


def _cells(spark: SparkSession, root: str, name: str, config: Config) -> DataFrame:
    return _kinds(config)[name].merged(_stored(spark, root, name, config))


def compact(spark: SparkSession, root: str, config: Config) -> None:
    """The cells of all loads as one part."""

    def write(folder: str, number: int) -> None:
        for name in _kinds(config):
            _cells(spark, root, name, config).write.parquet(f"{folder}/{name}")

    Parts(spark, root).add(write, replace=True)


def product_report(spark: SparkSession, root: str, products: DataFrame, config: Config) -> DataFrame:
    """The product report over all loads; years and dates must be those of the loads' config."""
    sold = _kinds(config)["sold"]
    totals = sold.totals(_cells(spark, root, "sold", config))
    return product_performance.report(totals, products, config)


def customer_report(spark: SparkSession, root: str, star: Star, config: Config) -> DataFrame:
    """The customer report over all loads; of ``star`` the two dimensions are read."""
    cells, source = (read(spark, root, "bought", config) for read in (_cells, _stored))
    return customer_behavior.report(cells, star, config, source)
