"""Helpers that the text operators share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/conversations.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The runs of other than blank characters; none if the text is null."""
    return F.filter(F.split(whole(text), BLANK_RUN), lambda word: word != "")


def word_count(text: Column) -> Column:
    trimmed = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BLANK_RUN))).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII takes the quick built-in."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(
        F.lower(text)
    )


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; an id of null counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def fresh(rows: DataFrame, stem: str) -> str:
    """A column name that ``rows`` does not use, in any case."""
    taken = {name.lower() for name in rows.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without it gets a temporary one.

    On a cluster such a folder would be on one machine only, so there it is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("name a folder that all executors reach in spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="starmart-llm-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, label: str, *partitions: str) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder; cuts the lineage."""
    path = new_path(rows.sparkSession, label)
    rows.write.partitionBy(*partitions).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def runs_on_executors(module: str) -> None:
    """Send a module's functions with the tasks: executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
