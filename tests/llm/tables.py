"""Small tables for the tests of the text operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tests.conftest import DATA

SMALL = os.environ.get("TEST_TEXT_DIR", f"{DATA}/sf0.001")
MEDIUM = f"{DATA}/sf0.01"
LARGE = f"{DATA}/sf0.1"

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"

_LONG = " ".join(f"word{i % 977} and more{i % 13}" for i in range(20_000))
_LINE = "A line that several documents hold, word for word."
_BASE = [f"plain{i}" for i in range(60)]

ODD_ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\r\n ", "en", None, 5),
    (4, "one", None, "b", 3),
    (5, "Two words", "fr", None, 9),
    (6, _LONG, "en", "b", None),
    (7, f"{_LINE}\nfirst\n{_LINE}", "en", "c", 99),
    (8, f"  {_LINE.upper()}\t\nsecond", "de", "c", 99),
    (9, f"{_LINE}\n{_LINE}", "de", "c", 99),
    (10, " ".join(_BASE), "en", "d", 1),
    (11, " ".join(_BASE), "en", "d", 1),
    (12, " ".join([*_BASE, "tail"]), "en", "d", 1),
    (12, " ".join([*_BASE, "tail"]), "en", "d", 1),
    (13, " ".join(reversed(_BASE)), "es", "d", 1),
    (13, "same id, other text, with some more words to read here", "es", "d", 1),
    (None, "no id at all, but text", "en", "a", 1),
    (None, None, None, None, None),
    (14, "日本語のテキスト 😀 ▁ <0x0A>", "en", "e", 1),
    (15, "ab ab ab ab ab ab ab ab ab", "en", "e", 1),
    (16, "12 34 -- !!", "en", "e", 1),
    (-7, "negative id", "en", "e", 1),
]

CLASHING = (
    "score predicted held_out key row bucket batch place size copies target doc mixing line_dedup "
    "slot shard virtual_slot prints next text_ label lang_pred places of id n words n_words toxicity"
).split()


def odd(spark: SparkSession) -> DataFrame:
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(*row, *(f"x{i}" for i in range(len(CLASHING)))) for row in ODD_ROWS]
    return spark.createDataFrame(rows, ", ".join([DOCUMENT, *(f"{c} string" for c in CLASHING)]))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCUMENT)


def odd_labels(spark: SparkSession) -> DataFrame:
    rows = [(1, 1, 0), (4, 1, 1), (4, 1, 0), (5, 0, None), (7, None, 1), (None, 1, 1), (99, 0, 1)]
    rows += [(i, i % 2, i % 3 == 0) for i in range(10, 17)]
    return spark.createDataFrame(
        [(i, q, None if t is None else int(t)) for i, q, t in rows],
        "doc_id bigint, quality int, toxic int",
    )


def no_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def texts(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(row) for row in rows]
