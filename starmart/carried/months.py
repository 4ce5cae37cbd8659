"""Months as an exact, mergeable state of revenue, units, buyers and products.

Customers and products get dense numbers, and a month keeps the set of each as bitmaps
of 32,768 numbers. Bitmaps merge by OR, so the distinct customers of a year, or of a
calendar month over all years, come from the months without reading a sale again. A
load adds the bitmaps of its own sales and numbers the keys that are new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starmart.carried.parts import Parts
from starmart.functions.semantics import dated
from starmart.operators.distincts import ITEM
from starmart.operators.trend import calendar_cells

MONTH = "month"
IDS = f"{ITEM} int, key bigint, id bigint"
SETS = f"{MONTH} date, {ITEM} int, bucket bigint, bits binary"
SUMS = f"{MONTH} date, total_sales bigint, total_quantity bigint"
#: A row's number inside its partition is in the low bits of Spark's increasing id.
_INSIDE = 33


def numbered(keys: DataFrame, after: DataFrame, folder: str) -> DataFrame:
    """(item, key, id): different keys (item, key), each item from its last id in ``after`` on.

    Keys are written once with a number per partition; the partitions' sizes, one row for
    each, make the numbers dense. No key moves for it.
    """
    keys.withColumn("at", F.monotonically_increasing_id()).write.parquet(folder)
    table = keys.sparkSession.read.schema(f"{ITEM} int, key bigint, at bigint").parquet(folder)
    part = F.shiftrightunsigned("at", _INSIDE).alias("part")
    order = Window.partitionBy(ITEM, "part").orderBy("at")
    placed = table.select("*", part).withColumn("place", F.row_number().over(order))
    before = Window.partitionBy("of").orderBy("in").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        table.groupBy(F.col(ITEM).alias("of"), part.alias("in"))
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    last = after.groupBy(F.col(ITEM).alias("since")).agg(F.max("id").alias("last"))
    return (
        placed.join(sizes, (F.col(ITEM) == F.col("of")) & (F.col("part") == F.col("in")))
        .join(last, F.col(ITEM) == F.col("since"), "left")
        .select(ITEM, "key", (F.coalesce("last", F.lit(0)) + F.col("before") + F.col("place")).alias("id"))
    )


def add_load(spark: SparkSession, root: str, sales: DataFrame) -> int:
    """Take the sales of one more load; each sale belongs to one load. Its number."""
    parts = Parts(spark, root)
    ids = parts.read("ids", IDS).drop("load")
    monthly = calendar_cells(month=F.trunc("order_date", "MONTH"))

    def write(folder: str, number: int) -> None:
        monthly.of(dated(sales)).write.parquet(f"{folder}/cells")
        cells = spark.read.parquet(f"{folder}/cells")
        key = F.coalesce(*monthly.items).alias("key")
        members = cells.where(F.col(ITEM) > 0).select(MONTH, ITEM, key)
        new = members.select(ITEM, "key").distinct().join(ids, [ITEM, "key"], "left_anti")
        numbered(new, ids, f"{folder}/keys").write.parquet(f"{folder}/ids")
        known = ids.unionAll(spark.read.schema(IDS).parquet(f"{folder}/ids"))
        (
            members.join(known, [ITEM, "key"])
            .groupBy(MONTH, ITEM, F.bitmap_bucket_number("id").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
            .write.parquet(f"{folder}/sets")
        )
        cells.where(F.col(ITEM) == 0).select(MONTH, "total_sales", "total_quantity").write.parquet(f"{folder}/sums")

    return parts.add(write)


def scorecard(spark: SparkSession, root: str, **parts: Column) -> DataFrame:
    """Revenue, buyers, units and products per calendar part over all loads.

    ``parts`` are expressions over ``month``, such as ``order_year=F.year("month")``.
    """
    state = Parts(spark, root)
    monthly = calendar_cells(month=F.trunc("order_date", "MONTH"))
    by = [part.alias(name) for name, part in parts.items()]
    merged = state.read("sets", SETS).groupBy(*by, ITEM, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    members = F.bitmap_count("bits")
    counted = merged.groupBy(*parts).agg(
        *[F.sum(F.when(F.col(ITEM) == kind, members)).alias(name) for name, kind in monthly.kinds.items()]
    )
    sums = state.read("sums", SUMS).groupBy(*by).agg(*[F.sum(n).alias(n) for n in monthly.measures])
    # Both sides have one row for each part of the calendar.
    of = [F.col(name).alias(f"of_{name}") for name in parts]
    same = None
    for name in parts:
        match = F.col(name).eqNullSafe(F.col(f"of_{name}"))
        same = match if same is None else same & match
    joined = sums.join(counted.select(*of, *monthly.kinds), same, "left")
    counts = {n: F.coalesce(n, F.lit(0)).cast("bigint") for n in monthly.kinds}
    return joined.select(
        *parts, "total_sales", counts["total_customers"].alias("total_customers"),
        "total_quantity", counts["total_products"].alias("total_products"),
    )
