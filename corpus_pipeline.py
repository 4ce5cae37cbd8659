"""The stages that turn ``documents`` into encoded training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.llm import line_dedup, mixing, ngram_join, sentencepiece_fst, toxicity
from starmart.llm.common import documents, labels, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject."""
    return toxicity.without_toxic(docs, labels(spark, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document of smaller id holds; all rows stay."""
    done = line_dedup.dedup(docs)
    kept = F.when(F.col("line_dedup.n_dropped") > 0, F.col("line_dedup.kept_text"))
    return done.withColumn("text", F.coalesce(kept, F.col("text"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id."""
    return ngram_join.first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: not at all, once or more."""
    return mixing.repeated(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    blank = F.translate("text", sentencepiece_fst.SPACE, " ")
    return sentencepiece_fst.encode_documents(docs).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.sha2("ids", 256).alias("ids_sha256"),
        (F.col("decoded") == blank).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("SentencePiece", encode_text),
]

#: The classifier of the first stage has no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each over what the one before it wrote."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
