"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starmart.schema import CUSTOMERS, PRODUCTS, SALES, YEAR_COLUMN, YEAR_FIELD, Star
from starmart.sources import versions

_SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def _named_folder(spark: SparkSession) -> str | None:
    context = spark.sparkContext
    named = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING, None)
    return named or context.getCheckpointDir()


def has_shared_folder(spark: SparkSession) -> bool:
    return bool(_named_folder(spark)) or spark.sparkContext.master.startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: on a
    cluster such a folder would be lost with the machine that holds it.
    """
    named = _named_folder(spark)
    if named:
        return named.rstrip("/")
    if not has_shared_folder(spark):
        raise RuntimeError(f"name a folder that all executors reach in {_SETTING}")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="starmart-")
    return _local_folders[application]


def new_folder(spark: SparkSession, label: str) -> str:
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/starmart/{application}/{label}-{uuid.uuid4().hex}"


def files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, time, length) of every file at or below the paths, sorted."""
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        listed = path.getFileSystem(settings).listFiles(path, True)
        while listed.hasNext():
            status = listed.next()
            found.append((status.getPath().toString(), status.getModificationTime(), status.getLen()))
    return sorted(found)


def exists(spark: SparkSession, name: str) -> bool:
    """Whether there is a file or folder of that name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def kept(rows: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``rows`` as a table in the shared folder, evaluated once, and how many they are.

    Without a folder that all executors reach they stay as they are and are counted.
    """
    spark = rows.sparkSession
    if not has_shared_folder(spark):
        return rows, rows.count()
    path = new_folder(spark, label)
    rows.write.parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    return table, table.count()


def write_sales(sales: DataFrame, path: str, extra_folders: tuple[str, ...] = ()) -> None:
    """Replace the whole sales table, one folder per order year.

    ``rebalance`` brings a month together and cuts or merges months to files of
    the advisory size; a period then touches few files, and the sort by date
    makes their row-group statistics selective.
    """
    folders = [*extra_folders, YEAR_COLUMN]
    (
        sales.withColumn(YEAR_COLUMN, F.year("order_date"))
        .withColumn("_month", F.month("order_date"))
        .hint("rebalance", *folders, "_month")
        .drop("_month")
        .sortWithinPartitions(*folders, "order_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*folders)
        .parquet(path)
    )


def publish(star: Star, root: str) -> None:
    """Replace the three tables below ``root``, all at once.

    Readers see the star that was there before until the last table is written.
    """
    with versions.replacing(star.sales.sparkSession, root) as folder:
        write_sales(star.sales, f"{folder}/fact_sales")
        star.customers.write.parquet(f"{folder}/dim_customers")
        star.products.write.parquet(f"{folder}/dim_products")


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """The sales table with its year folder as a column."""
    return spark.read.schema(StructType([*SALES.fields, YEAR_FIELD])).parquet(path)


def open_star(spark: SparkSession, root: str) -> Star:
    """The tables that ``publish`` wrote last."""
    folder = versions.current(spark, root)
    return Star(
        sales=read_sales(spark, f"{folder}/fact_sales"),
        customers=spark.read.schema(CUSTOMERS).parquet(f"{folder}/dim_customers"),
        products=spark.read.schema(PRODUCTS).parquet(f"{folder}/dim_products"),
    )
