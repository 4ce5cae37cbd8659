"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of rising ``doc_id``. A run is a sorted table of
(key hash, owner): the smallest ``doc_id`` that holds the line. Each batch
merge-anti-joins its line hashes with the runs and adds the new ones as a run of
level 0; as soon as a level has ``fanout`` runs they are merged into one of the
next level. Because batches rise, the first owner stays the smallest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.llm.common import BLANKS, ascii_lower, let, stored, whole

LEAST_CHARS = 10
BATCHES = 4
FANOUT = 2
RUN_TYPE = "key binary, owner bigint"


class Runs:
    """Levelled sorted runs; level i holds fewer than ``fanout`` runs after each add."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame:
        runs = [run for level in self.levels for run in level]
        return reduce(DataFrame.unionAll, runs, self.spark.createDataFrame([], RUN_TYPE))

    def _write(self, rows: DataFrame, level: int) -> None:
        sorted_run = rows.repartition("key").sortWithinPartitions("key")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored(sorted_run, f"run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionAll, self.levels[level])
            self.levels[level] = []
            self._write(merged, level + 1)

    def add(self, lines: DataFrame) -> None:
        """Take the keys of a batch that no run has yet; ``lines`` has key and doc_id."""
        batch = lines.groupBy("key").agg(F.min("doc_id").alias("owner"))
        if any(self.levels):
            batch = batch.hint("merge").join(self.all(), "key", "left_anti")
        self._write(batch, 0)


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(BLANKS))


def lines_of(docs: DataFrame, edges: list[int], least_chars: int = LEAST_CHARS) -> DataFrame:
    """(batch, doc_id, row, place, key) of every line long enough to be compared.

    ``row`` tells apart rows of one id with different texts.
    """
    text = whole(F.col("text"))
    doc_id = F.col("doc_id")
    batch = F.coalesce(
        sum(((doc_id > edge).cast("int") for edge in edges), F.lit(0)), F.lit(len(edges))
    )
    keyed = docs.select(
        batch.alias("batch"),
        doc_id.cast("long").alias("doc_id"),
        F.xxhash64(text).alias("row"),
        F.posexplode(F.split(text, "\n")).alias("place", "line"),
    ).withColumn("line", line_key(F.col("line")))
    return keyed.where(F.length("line") >= least_chars).select(
        "batch", "doc_id", "row", "place", F.unhex(F.md5("line")).alias("key")
    )


def batch_edges(docs: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into batches of about equal numbers."""
    if batches < 2:
        return []
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or []
    return sorted(set(found))


def dedup(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Every row of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` in ``line_dedup``.

    A line is dropped if its key has at least ten code points and a document
    with a smaller id holds it. Rows with one id are one document; those without
    an id are one that comes after all others. A text of null is one empty line.
    If all lines go, the text is empty. Repeated rows stay repeated. The result
    has all columns of ``docs`` and a struct named ``line_dedup`` (a column of
    that name is replaced). Without documents there are no rows.
    """
    docs = docs.drop("line_dedup")
    edges = batch_edges(docs, batches)
    lines = stored(lines_of(docs, edges), "lines", "batch")
    runs = Runs(docs.sparkSession, fanout)
    for i in range(len(edges) + 1):
        runs.add(lines.where(F.col("batch") == i))

    owned = lines.join(runs.all(), "key")
    dropped = (
        owned.where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        .groupBy(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row"))
        .agg(F.collect_set("place").alias("places"))
    )
    text = whole(F.col("text"))
    packed = docs.select(
        F.struct(*docs.columns).alias("doc"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(text).alias("row"),
    )
    found = packed.join(
        dropped,
        F.col("id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")),
        "left",
    )
    text = whole(F.col("doc.text"))

    def without(places: Column, lines_: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), places)
        return F.array_join(F.transform(stay, lambda i: F.get(lines_, i)), "\n")

    kept = F.when(F.col("places").isNull(), text).otherwise(
        let(F.split(text, "\n"), lambda lines_: without(F.col("places"), lines_))
    )
    shaped = found.select(
        "doc",
        F.struct(
            F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
            F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
            kept.alias("kept_text"),
        ).alias("line_dedup"),
    )
    return shaped.select("doc.*", "line_dedup")
