"""The star schema of the test data, derived from its order tables.

Every row of ``lineitem``, ``customer`` and ``part`` becomes one row of the
star. The rules below only set column values, so that the tables show what real
stores show: sales without a date or a known customer, products that are never
sold or replaced by a successor, new, lost and low-spending customers.
"""

from __future__ import annotations

from datetime import date
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.config import Config
from starmart.schema import CUSTOMERS, PRODUCTS, SALES, Star
from starmart.sources import storage
from starmart.sources.storage import has_shared_folder, new_folder, open_star, publish

# The test orders run from 1995 to August 2001.
TPCH_CONFIG = Config(
    age_anchor=date(2000, 12, 31),
    segment_anchor=date(2000, 12, 31),
    report_anchor=date(2000, 12, 31),
    prior_year=1999,
    current_year=2000,
    ranking_year=2001,
    focus_year=2000,
    focus_month=12,
)

_TABLES = ("customer", "nation", "part", "orders", "lineitem")
_published: dict[tuple, str] = {}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _day(year: int, month: int, day: int) -> Column:
    return F.lit(date(year, month, day))


def _typed(rows: DataFrame, schema) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def customers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = _read(spark, folder, "customer").join(
        _read(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return _typed(
        rows.select(
            key.alias("customer_key"),
            (key + 10_000).alias("customer_id"),
            F.col("c_name").alias("customer_number"),
            F.when(key % 17 != 0, F.col("c_mktsegment")).alias("first_name"),
            F.col("c_name").alias("last_name"),
            F.col("n_name").alias("country"),
            F.when(key % 2 == 0, "Married").otherwise("Single").alias("marital_status"),
            F.when(key % 5 == 0, F.lit(None))
            .when(key % 5 < 3, "Male")
            .otherwise("Female")
            .alias("gender"),
            F.when(
                key % 13 != 0, F.date_add(_day(1940, 1, 1), (key * 37 % 20_000).cast("int"))
            ).alias("birthdate"),
            _day(1995, 1, 1).alias("create_date"),
        ),
        CUSTOMERS,
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    placed = key % 40 != 3
    return _typed(
        _read(spark, folder, "part").select(
            key.alias("product_key"),
            (key + 200).alias("product_id"),
            F.concat(F.lit("PN-"), key).alias("product_number"),
            F.concat("p_name", F.lit(" "), key % 100).alias("product_name"),
            F.upper(F.substring("p_type", 1, 2)).alias("category_id"),
            F.when(placed, F.col("p_type")).alias("category"),
            F.when(placed, F.col("p_brand")).alias("subcategory"),
            F.when(key % 2 == 0, "Yes").otherwise("No").alias("maintenance"),
            F.when(key % 97 == 5, F.lit(None))
            .when(key % 9 == 0, size * 40)
            .when(key % 5 == 0, size * 8)
            .otherwise(size)
            .alias("cost"),
            F.when(key % 4 == 0, "Road")
            .when(key % 4 == 1, "Mountain")
            .otherwise("Other Sales")
            .alias("product_line"),
            F.date_add(_day(1993, 7, 1), (key % 4 * 365).cast("int")).alias("start_date"),
        ),
        PRODUCTS,
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    order, part, buyer = F.col("o_orderkey"), F.col("l_partkey"), F.col("o_custkey")
    placed = F.col("o_orderdate").cast("date")
    age = F.datediff(placed, _day(1995, 1, 1))
    day = F.col("order_date")
    ordered = (
        F.when(order % 200 == 19, F.lit(None))
        .when(buyer % 100 == 60, F.date_add(_day(2000, 9, 1), age % 30))
        .when(buyer % 20 == 0, F.date_add(_day(2000, 10, 1), age % 300))
        .when(buyer % 20 == 10, F.date_add(_day(2000, 2, 1), age % 330))
        .when((buyer % 10 == 1) & (placed >= _day(1999, 12, 1)), F.date_sub(placed, 730))
        .when((buyer % 10 == 2) & (placed >= _day(2000, 9, 1)), F.date_sub(placed, 365))
        .otherwise(placed)
    )
    replaced = (
        (part % 25 == 4)
        | ((part % 25 == 6) & (day >= _day(1999, 1, 1)))
        | ((part % 25 == 8) & (day >= _day(2000, 4, 1)))
        | ((part % 25 == 14) & (day >= _day(2000, 9, 10)))
    )
    divisor = (
        F.when(buyer % 100 == 40, 10_000)
        .when((buyer % 10 == 3) | (buyer % 100 == 20), 1_000)
        .when(part % 25 == 16, 10)
        .otherwise(100)
        .cast("double")
    )
    amount = F.col("l_extendedprice") / divisor
    rows = (
        _read(spark, folder, "lineitem")
        .join(_read(spark, folder, "orders"), F.col("l_orderkey") == order, "left")
        .withColumn("order_date", ordered)
    )
    return _typed(
        rows.select(
            F.concat(F.lit("SO"), order).alias("order_number"),
            F.when(order % 400 == 29, F.lit(None))
            .when(part % 50 == 11, -part)
            .when(replaced, part + 1)
            .when((part % 25 == 20) & (day < _day(2000, 6, 1)), part - 1)
            .otherwise(part)
            .alias("product_key"),
            F.when(order % 400 == 23, F.lit(None))
            .when(buyer % 50 == 7, -buyer)
            .otherwise(buyer)
            .alias("customer_key"),
            "order_date",
            F.col("l_shipdate").cast("date").alias("shipping_date"),
            placed.alias("due_date"),
            F.floor(amount).alias("sales_amount"),
            F.col("l_quantity").alias("quantity"),
            F.floor(amount / F.col("l_quantity")).alias("price"),
        ),
        SALES,
    )


def derive(spark: SparkSession, folder: str) -> Star:
    """The star as unevaluated DataFrames over the given tables."""
    return Star(sales(spark, folder), customers(spark, folder), products(spark, folder))


def _state(spark: SparkSession, folder: str) -> tuple:
    """Path, time and size of the files of the given tables.

    Listed by the session's Hadoop file systems, without a Spark job and without
    reading content, so any folder that Spark can read will do.
    """
    return tuple(storage.files(spark, [f"{folder}/{name}.parquet" for name in _TABLES]))


def star(spark: SparkSession, folder: str) -> Star:
    """The star of ``folder``, published once per application.

    Later queries read the typed Parquet tables instead of joining orders and
    lines again. Changed tables are published anew. Without a folder that all
    executors reach, the star stays unevaluated.
    """
    if not has_shared_folder(spark):
        return derive(spark, folder)
    key = (spark.sparkContext.applicationId, folder, _state(spark, folder))
    if key not in _published:
        root = new_folder(spark, "star")
        publish(derive(spark, folder), root)
        _published[key] = root
    return open_star(spark, _published[key])
