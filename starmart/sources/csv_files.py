"""Day-first CSV files into typed tables, with rejected rows kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from starmart.carried.parts import Parts
from starmart.schema import QUANTITY_RANGE, TABLES, YEAR_FIELD
from starmart.sources import versions
from starmart.sources.storage import files, write_sales

#: Read with or without leading zeros, written with them.
DAY_FIRST = "d/M/yyyy"
DAY_FIRST_OUT = "dd/MM/yyyy"
_RAW = "_raw_line"
_REJECTED = "rejected"
MANIFEST = "path string, time bigint, length bigint"


def read_csv(spark: SparkSession, path: str | list[str], table: str) -> DataFrame:
    """Typed rows of one table; ``_raw_line`` holds the text of unreadable ones.

    A wrong number of fields, a bad number and a bad date make a row unreadable.
    """
    schema = StructType([*TABLES[table].fields, StructField(_RAW, StringType())])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("dateFormat", DAY_FIRST)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RAW)
        # Field counts are only checked when every column is parsed.
        .option("columnPruning", False)
        .csv(path)
    )


def _unusable(table: str) -> Column:
    unreadable = F.col(_RAW).isNotNull()
    if table != "fact_sales":
        return unreadable
    return unreadable | F.coalesce(~F.col("quantity").between(*QUANTITY_RANGE), F.lit(False))


def _write(rows: DataFrame, table: str, folder: str, most_rejected: float) -> None:
    """Good and rejected rows side by side, in one pass over the text.

    Fails if more than the given share of the rows is rejected.
    """
    rows = rows.withColumn(_REJECTED, _unusable(table))
    if table == "fact_sales":
        write_sales(rows, folder, extra_folders=(_REJECTED,))
    else:
        rows.write.partitionBy(_REJECTED).parquet(folder)
    if most_rejected >= 1:
        return
    # Only the folders' names are read for this.
    split = StructType([*_fields(table), StructField(_REJECTED, BooleanType())])
    written = rows.sparkSession.read.schema(split).parquet(folder)
    total, bad = written.agg(F.count(F.lit(1)), F.count(F.when(F.col(_REJECTED), 1))).first()
    if bad > most_rejected * total:
        raise ValueError(f"{table}: {bad} of {total} rows are rejected")


def ingest(
    spark: SparkSession, csv_path: str, table: str, target: str, most_rejected: float = 1.0
) -> DataFrame:
    """Replace ``target`` with the rows of a CSV file and return the good ones.

    They become the content of ``target`` when all are written and no more than
    ``most_rejected`` of them (a share) are unusable.
    """
    with versions.replacing(spark, target) as folder:
        _write(read_csv(spark, csv_path, table), table, folder, most_rejected)
    return accepted(spark, table, target)


def ingest_new(
    spark: SparkSession, csv_folder: str, table: str, target: str, most_rejected: float = 1.0
) -> list[str]:
    """Add the rows of those files below a folder that ``target`` does not hold yet.

    Path, time and length of every loaded file are kept with its rows, so a repeated
    load reads nothing twice. A loaded file that has changed stops the load: its old
    rows cannot be told from new ones. Returns the paths that were loaded.
    """
    parts = Parts(spark, target)
    known = {r["path"]: (r["time"], r["length"]) for r in loaded_files(spark, target).collect()}
    new = []
    for path, time, length in files(spark, [csv_folder]):
        if path.rpartition("/")[2].startswith(("_", ".")):
            continue
        if path not in known:
            new.append((path, time, length))
        elif known[path] != (time, length):
            raise ValueError(f"{path} has changed since it was loaded")
    if not new:
        return []

    def write(folder: str, number: int) -> None:
        paths = [path for path, _, _ in new]
        _write(read_csv(spark, paths, table), table, f"{folder}/rows", most_rejected)
        spark.createDataFrame(new, MANIFEST).coalesce(1).write.parquet(f"{folder}/files")

    parts.add(write)
    return [path for path, _, _ in new]


def loaded_files(spark: SparkSession, target: str) -> DataFrame:
    """(path, time, length, load) of the files that ``ingest_new`` has loaded."""
    return Parts(spark, target).read("files", MANIFEST)


def added(spark: SparkSession, table: str, target: str) -> DataFrame:
    """The good rows of all loads of ``ingest_new``, with their ``load``."""
    fields = [*_fields(table), StructField(_REJECTED, BooleanType())]
    return Parts(spark, target).read("rows", StructType(fields)).where(~F.col(_REJECTED)).drop(_REJECTED)


def _fields(table: str) -> list[StructField]:
    fields = list(TABLES[table].fields)
    return [*fields, YEAR_FIELD] if table == "fact_sales" else fields


def _stored(spark: SparkSession, target: str, fields: list[StructField]) -> DataFrame:
    split = StructField(_REJECTED, BooleanType())
    return spark.read.schema(StructType([*fields, split])).parquet(versions.current(spark, target))


def accepted(spark: SparkSession, table: str, target: str) -> DataFrame:
    """The good rows that ``ingest`` stored."""
    return _stored(spark, target, _fields(table)).where(~F.col(_REJECTED)).drop(_REJECTED)


def rejected(spark: SparkSession, table: str, target: str) -> DataFrame:
    """What ``ingest`` kept aside: the typed columns and the raw line."""
    fields = [*TABLES[table].fields, StructField(_RAW, StringType())]
    return _stored(spark, target, fields).where(_REJECTED).drop(_REJECTED)


def export_csv(rows: DataFrame, table: str, path: str) -> None:
    """Write a table in the same text form that ``ingest`` reads."""
    (
        rows.select(*TABLES[table].names)
        .write.mode("overwrite")
        .option("header", True)
        .option("dateFormat", DAY_FIRST_OUT)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
