"""The pipeline, stage by stage, against plain code."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import sentencepiece

from starmart.llm import sentencepiece_fst
from tests.llm.tables import MEDIUM
from tests.llm.test_queries import FOLD, components

BLANKS = " \t\n\x0b\x0c\r"


def kept_lines(rows):
    """Texts without the lines that a smaller id holds."""
    key = lambda line: line.translate(FOLD).strip(BLANKS)
    owner: dict[str, int] = {}
    for doc_id, text in sorted(rows):
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                owner.setdefault(key(line), doc_id)
    return {
        i: "\n".join(line for line in text.split("\n") if owner.get(key(line), i) == i)
        for i, text in rows
    }


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, MEDIUM).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs.collect())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    start, clean, lined, single, mixed, encoded = seen

    toxic = {
        r["doc_id"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").where("toxic = 1").collect()
    }
    gone = {r["doc_id"] for r in start} - {r["doc_id"] for r in clean}
    assert gone and len(gone & toxic) > 0.5 * len(toxic)

    expected = kept_lines([(r["doc_id"], r["text"]) for r in clean])
    assert {r["doc_id"]: r["text"] for r in lined} == expected

    root = components(list(expected.items()))
    assert Counter(r["doc_id"] for r in single) == Counter(i for i in root if root[i] == i)

    text = {r["doc_id"]: r["text"] for r in single}
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= set(text) and max(copies.values()) <= 3
    assert all(r["text"] == text[r["doc_id"]] for r in mixed)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in text.items()}
    taken = sum(words[i] * n for i, n in copies.items())
    assert abs(taken / sum(words.values()) - 1) < 0.05

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    assert Counter(r["doc_id"] for r in encoded) == copies
    for row in encoded:
        assert row["n_pieces"] == len(model.encode(text[row["doc_id"]]))
        assert row["round_trip"]


def test_run(spark):
    rows = corpus_pipeline.run(spark, MEDIUM).collect()
    assert rows and all(r["round_trip"] for r in rows)
