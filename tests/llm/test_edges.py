"""Odd rows: every operator gives each a defined result, none crashes."""

from __future__ import annotations

import corpus_pipeline
import pytest

from starmart.llm import (
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    quality_rules,
    rule_ensemble,
    sentencepiece_fst,
    sharding,
    toxicity,
    winnowing,
)
from tests.llm import tables

OPERATORS = {
    "toxicity": lambda docs, labels: toxicity.score_documents(docs, labels),
    "mixing": lambda docs, labels: mixing.mix(docs),
    "quality_rules": lambda docs, labels: quality_rules.judge(docs),
    "language_id": lambda docs, labels: language_id.identify(docs),
    "ngram_join": lambda docs, labels: ngram_join.similar_groups(docs),
    "winnowing": lambda docs, labels: winnowing.compare(docs),
    "sharding": lambda docs, labels: sharding.shard_documents(docs),
    "rule_ensemble": lambda docs, labels: rule_ensemble.score_documents(docs, labels),
    "sentencepiece": lambda docs, labels: sentencepiece_fst.encode_documents(docs),
    "line_dedup": lambda docs, labels: line_dedup.dedup(docs),
}


@pytest.fixture(scope="module")
def odd(spark):
    return tables.odd(spark)


def by_id(rows):
    found = {}
    for row in rows:
        found.setdefault(row["doc_id"], []).append(row)
    return found


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_every_row(spark, odd, name):
    rows = OPERATORS[name](odd, tables.odd_labels(spark)).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == sorted(r[0] or 0 for r in tables.ODD_ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nothing_from_nothing(spark, name):
    assert OPERATORS[name](tables.empty(spark), tables.no_labels(spark)).collect() == []


def test_scores_without_labels(spark, odd):
    none = tables.no_labels(spark)
    for row in toxicity.score_documents(odd, none).collect():
        assert row["score"] == 0.5
    for row in rule_ensemble.score_documents(odd, none).collect():
        assert row["score"] == 0.5


def test_scores_are_shares_and_equal_for_equal_texts(spark, odd):
    for operator in (toxicity, rule_ensemble):
        rows = by_id(operator.score_documents(odd, tables.odd_labels(spark)).collect())
        assert all(0 <= r["score"] <= 1 for same in rows.values() for r in same)
        assert rows[1][0]["score"] == rows[2][0]["score"]
        assert rows[10][0]["score"] == rows[11][0]["score"]
        assert len({r["score"] for r in rows[12]}) == 1


def test_unknown_language(odd):
    rows = by_id(language_id.identify(odd).collect())
    for doc_id in (1, 2, 3, 16):
        assert (rows[doc_id][0]["lang_pred"], rows[doc_id][0]["score"]) == ("und", 0.0)
    assert rows[6][0]["lang_pred"] in {"en", "fr", "de", "es"}


def test_rules(odd):
    rows = by_id(quality_rules.judge(odd).collect())
    assert [rows[i][0]["n_words"] for i in (1, 2, 3, 4, 15)] == [0, 0, 0, 1, 9]
    assert rows[15][0]["n_repeat_words"] == 9
    assert rows[9][0]["n_dup_lines"] == 1
    assert rows[1][0]["base_failed"] and not rows[1][0]["kept"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", 0),
        ("a a", 0),
        ("a b c", 0),
        ("a a a", 0),
        ("a a a a", 4),
        ("a b a b", 0),
        ("a b a b a", 5),
        ("a b c a b c", 6),
        ("a b c x a b c", 6),
        ("a b c d a b c d", 8),
    ],
)
def test_repeated_words(spark, text, expected):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert quality_rules.judge(docs).first()["n_repeat_words"] == expected


def test_groups(odd):
    rows = by_id(ngram_join.similar_groups(odd).collect())
    assert {rows[i][0]["component_id"] for i in (10, 11, 12)} == {10}
    assert [rows[i][0]["first"] for i in (10, 11)] == [True, False]
    assert [r["component_id"] for r in rows[13]] == [13, 13]
    for doc_id in (1, 2, 3):
        assert (rows[doc_id][0]["n_shingles"], rows[doc_id][0]["component_id"]) == (0, doc_id)
    assert {r["component_id"] for r in rows[None]} == {None}


def test_one_of_each_group_stays(odd):
    kept = ngram_join.first_of_groups(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] or 0 for r in kept.collect())
    assert ids == sorted(i or 0 for i in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 13, None, None, 14, 15, 16, -7])


def test_lines(odd):
    rows = by_id(line_dedup.dedup(odd).collect())
    kept = {i: [r["line_dedup"]["kept_text"] for r in same] for i, same in rows.items()}
    assert kept[7] == [next(r[1] for r in tables.ODD_ROWS if r[0] == 7)]
    assert kept[8] == ["second"]
    assert kept[9] == [""]
    assert kept[1] == [""] and rows[1][0]["line_dedup"]["n_lines"] == 1
    assert kept[11] == [""] and kept[12] == [" ".join([*tables._BASE, "tail"])] * 2


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (2, 2), (7, 2), (7, 3)])
def test_lines_do_not_depend_on_batches(spark, odd, batches, fanout):
    shaped = lambda done: sorted((repr(r["doc_id"]), repr(r["line_dedup"])) for r in done.collect())
    assert shaped(line_dedup.dedup(odd, batches, fanout)) == shaped(line_dedup.dedup(odd))


def test_runs_are_compacted(spark):
    runs = line_dedup.Runs(spark, fanout=2)
    for i in range(5):
        lines = [(bytes([k]), i) for k in range(i, i + 3)]
        runs.add(spark.createDataFrame(lines, "key binary, doc_id bigint"))
        assert all(len(level) < 2 for level in runs.levels)
    owners = {bytes(r["key"])[0]: r["owner"] for r in runs.all().collect()}
    assert owners == {k: max(0, k - 2) for k in range(7)}
    assert runs.all().count() == 7


def test_encoding(odd):
    for row in sentencepiece_fst.encode_documents(odd).collect():
        assert row["decoded"] == row["text"].replace("▁", " ")
        assert bool(row["ids"]) == bool(row["text"])


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages(spark, odd, stage, tmp_path):
    for name, table in (("odd", odd), ("empty", tables.empty(spark))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        tables.odd_labels(spark).write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = stage(spark, docs, folder)
        assert out.count() <= 3 * docs.count()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
