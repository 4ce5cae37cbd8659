"""Tables that grow by a part with each load.

A part is written aside. It counts from the moment in which a version of the list of
parts that names it becomes current, so a load that fails leaves nothing behind that
is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starmart.sources import versions

LIST = "number bigint, folder string"


class Parts:
    """The parts of some tables below one folder, oldest first."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def listed(self) -> list[tuple[int, str]]:
        """(number of the load, folder) of the parts that count."""
        if not versions.history(self.spark, self.root):
            return []
        table = self.spark.read.schema(LIST).parquet(f"{versions.current(self.spark, self.root)}/parts")
        return sorted(map(tuple, table.collect()))

    def read(self, table: str, schema: StructType | str) -> DataFrame:
        """All rows of a table, with the ``load`` that brought them."""
        if isinstance(schema, str):
            schema = StructType.fromDDL(schema)
        rows = None
        for number, folder in self.listed():
            part = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/{table}")
            part = part.withColumn("load", F.lit(number).cast("bigint"))
            rows = part if rows is None else rows.unionAll(part)
        if rows is None:
            rows = self.spark.createDataFrame([], schema).withColumn("load", F.lit(0).cast("bigint"))
        return rows

    def add(self, write: Callable[[str, int], None], replace: bool = False) -> int:
        """One more part, written by ``write(folder, number)``; the number of the load.

        With ``replace`` it stands for all parts so far, which are no longer read.
        """
        before = self.listed()
        number = max([n for n, _ in before], default=0) + 1
        folder = f"part-{number:06d}-{uuid.uuid4().hex}"
        write(f"{self.root}/{folder}", number)
        after = [(number, folder)] if replace else [*before, (number, folder)]
        with versions.replacing(self.spark, self.root) as listing:
            self.spark.createDataFrame(after, LIST).coalesce(1).write.parquet(f"{listing}/parts")
        return number
