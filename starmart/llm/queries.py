"""The operators applied to the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.llm import (
    hard_negatives,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    prefix_trie,
    quality_rules,
    rule_ensemble,
    sentencepiece_fst,
    sharding,
    substring_dedup,
    toxicity,
    winnowing,
)
from starmart.llm.common import conversations, documents, embeddings, labels, new_path
from starmart.llm.oracle_sql import ORACLE_SQL  # noqa: F401


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, folder), labels(spark, folder))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "mixing.*")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(documents(spark, folder))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(documents(spark, folder))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    grouped = ngram_join.similar_groups(documents(spark, folder))
    return grouped.select("doc_id", "n_shingles", "component_id")


def op6_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.compare(documents(spark, folder)).select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        winnowing.digest(F.col("prints")).alias("fingerprint"),
        winnowing.digest(F.col("edited_prints")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, folder), folder=new_path(spark, "slot-map"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return rule_ensemble.score_documents(documents(spark, folder), labels(spark, folder))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    blank = F.translate("text", sentencepiece_fst.SPACE, " ")
    return sentencepiece_fst.encode_documents(documents(spark, folder)).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.sha2("ids", 256).alias("ids_sha256"),
        (F.col("decoded") == blank).alias("round_trip"),
    )


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = F.col("line_dedup")
    return line_dedup.dedup(documents(spark, folder).select("doc_id", "text")).select(
        "doc_id",
        done["n_lines"].alias("n_lines"),
        done["n_dropped"].alias("n_dropped"),
        F.sha2(done["kept_text"], 256).alias("kept_sha256"),
    )


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = F.col("substring_dedup")
    return substring_dedup.dedup(documents(spark, folder).select("doc_id", "text")).select(
        "doc_id",
        done["n_words"].alias("n_words"),
        done["n_removed"].alias("n_removed"),
        F.sha2(done["kept_text"], 256).alias("kept_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    relabel = lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(hard_negatives.vectors(embeddings(spark, folder), relabel=relabel))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(conversations(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_ngram_join": op5_ngram_join,
    "op6_winnowing": op6_winnowing,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_line_dedup": op10_line_dedup,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}
