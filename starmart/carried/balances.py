"""Running spend that is carried from load to load.

A load's rows start from one opening balance for each customer, so only the sales of
the load are read. Sales may come late: a customer with a sale on or before the last
day that was carried is computed anew from the kept sales of that customer, and what
earlier loads said about this customer does not count any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.carried.parts import Parts
from starmart.functions.semantics import dated
from starmart.operators.cumulative import spend_rows, spender

KEY = "spender bigint, known boolean"
BALANCE = f"{KEY}, balance bigint, last_day date"
SALE = "customer_key bigint, order_date date, order_number string, sales_amount int"
SPENT = "customer_key bigint, order_date date, order_number string, cumulative_spend bigint"


def _latest(rows: DataFrame, value: str) -> DataFrame:
    """For each customer, the value of the last load that has one."""
    return rows.groupBy("spender", "known").agg(F.max(value).alias(value))


def balances(spark: SparkSession, root: str) -> DataFrame:
    """(spender, known, balance, last_day) after all loads, one row per customer."""
    state = F.struct("load", "balance", "last_day")
    rows = Parts(spark, root).read("balances", BALANCE).select("spender", "known", state.alias("state"))
    return _latest(rows, "state").select("spender", "known", "state.balance", "state.last_day")


def add_load(spark: SparkSession, root: str, sales: DataFrame) -> int:
    """Take the sales of one more load; each sale belongs to one load. Its number."""
    parts = Parts(spark, root)
    carried = balances(spark, root)
    names = [f.split()[0] for f in SALE.split(", ")]

    def write(folder: str, number: int) -> None:
        dated(sales).select(*names).write.parquet(f"{folder}/sales")
        new = spark.read.schema(SALE).parquet(f"{folder}/sales")
        touched = (
            spender(new)
            .groupBy("spender", "known")
            .agg(F.min("order_date").alias("first_day"), F.max("order_date").alias("day"))
            .join(carried, ["spender", "known"], "left")
            .withColumn("late", F.coalesce(F.col("first_day") <= F.col("last_day"), F.lit(False)))
        )
        touched.select("spender", "known", "late", "balance", "last_day", "day").write.parquet(f"{folder}/touched")
        touched = spark.read.parquet(f"{folder}/touched")
        late = touched.where("late").select("spender", "known")
        on_time = touched.where(~F.col("late")).select("spender", "known", "balance")
        rows = spend_rows(spender(new).join(late, ["spender", "known"], "left_anti"), on_time)
        if not late.isEmpty():
            kept = parts.read("sales", SALE).drop("load").unionAll(new)
            rows = rows.unionAll(spend_rows(spender(kept).join(late, ["spender", "known"])))
        rows.write.parquet(f"{folder}/spent")
        late.write.parquet(f"{folder}/anew")
        added = spender(new).groupBy("spender", "known").agg(F.sum("sales_amount").alias("added"))
        total = F.when(F.col("balance").isNull(), F.col("added")).otherwise(
            F.col("balance") + F.coalesce("added", F.lit(0))
        )
        (
            touched.join(added, ["spender", "known"])
            .select("spender", "known", total.alias("balance"), F.greatest("day", "last_day").alias("last_day"))
            .write.parquet(f"{folder}/balances")
        )

    return parts.add(write)


def customer_spend(spark: SparkSession, root: str) -> DataFrame:
    """The rows of ``cum_customer_spend`` over the sales of all loads."""
    parts = Parts(spark, root)
    anew = _latest(parts.read("anew", KEY), "load").withColumnRenamed("load", "since")
    rows = spender(parts.read("spent", SPENT)).join(anew, ["spender", "known"], "left")
    counts = F.col("since").isNull() | (F.col("load") >= F.col("since"))
    return rows.where(counts).select(*[f.split()[0] for f in SPENT.split(", ")])
