"""Samples that models are fitted on keep their size and their labels."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from starmart.llm import language_id, sampling


def _first(spark, ids):
    """The id that comes first in the order of the sample."""
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").first()[0]


def _sample(spark, table, **limits):
    docs = spark.createDataFrame(table, "doc_id bigint, label int, text string")
    found = sampling.bounded(docs.select("doc_id", "text"), docs.select("doc_id", "label"), **limits)
    return {row["doc_id"]: row for row in found.collect()}


def test_a_long_text_costs_one_row(spark):
    ids = range(300)
    long = _first(spark, ids)
    rows = [(i, i % 2, "x" * (50_000 if i == long else 100)) for i in ids]
    found = _sample(spark, rows, rows=300, chars=40_000)
    assert set(found) == set(ids) - {long}
    assert sum(len(row["text"]) for row in found.values()) <= 40_000


def test_a_label_of_long_texts_keeps_its_shortest(spark):
    rows = [(i, 0, "x" * 100) for i in range(50)]
    rows += [(50 + i, 1, "y" * (9_000 - i)) for i in range(3)]
    found = _sample(spark, rows, rows=100, chars=6_000)
    assert Counter(row["label"] for row in found.values()) == {0: 50, 1: 1}
    assert len(found[52]["text"]) == 8_998


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 60_000)
    rows = [(i, f"w{i % 4} " * 250, f"l{i % 4}") for i in range(1_200)]
    rows += [(5_000 + i, "rare " * 200, "rare") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = []
    monkeypatch.setattr(language_id, "fit_rows", lambda texts, langs: learned.extend(zip(langs, texts)))
    language_id.fit(docs)
    eligible = {row[0] for row in docs.where("lang = 'rare' and crc32(cast(doc_id as string)) % 3 != 1").collect()}
    of_lang = Counter(lang for lang, _ in learned)
    assert of_lang["rare"] == len(eligible) > 0
    assert min(of_lang[f"l{i}"] for i in range(4)) >= 12
    assert sum(len(text) for _, text in learned) <= 60_000


def test_many_languages_keep_rows(spark):
    rows = [(i, i % 60, "x" * 100) for i in range(600)]
    found = _sample(spark, rows, chars=12_000, per_label=True)
    assert Counter(row["label"] for row in found.values()) == dict.fromkeys(range(60), 2)
