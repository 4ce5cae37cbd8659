"""The registered text queries against DuckDB or brute force, on the given tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import sentencepiece

from starmart.llm import sentencepiece_fst
from starmart.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.tables import LARGE, MEDIUM, SMALL, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components(rows: list[tuple[int, str]]) -> dict[int, int]:
    """Smallest id reachable from each, over all pairs that share a shingle."""
    sets = {i: shingles(text) for i, text in rows}
    holders = defaultdict(list)
    for i, grams in sets.items():
        for gram in grams:
            holders[gram].append(i)
    both = Counter()
    for ids in holders.values():
        ids.sort()
        both.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    ours = QUERIES[name](spark, MEDIUM)
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.execute(f"create view {table} as select * from '{MEDIUM}/{table}.parquet'")
    theirs = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    expected = sorted(theirs.fetchall(), key=repr)
    actual = sorted((tuple(row[c] for c in columns) for row in ours.collect()), key=repr)
    assert actual == expected


def test_toxicity_held_out(spark):
    scored = QUERIES["op1_toxicity"](spark, LARGE)
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hits = sum(r["predicted"] == r["toxic"] for r in rows)
    assert len(rows) > 500
    assert hits / len(rows) > 0.97
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(clean) / len(clean) < 0.02


def test_quality_held_out(spark):
    scored = QUERIES["op8_quality"](spark, LARGE)
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_held_out_rows_are_those_of_the_remainder(spark):
    for name, divisor, rest in (("op1_toxicity", 5, 0), ("op4_language_id", 3, 1), ("op8_quality", 5, 0)):
        for row in QUERIES[name](spark, SMALL).select("doc_id", "held_out").collect():
            assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % divisor == rest)


def test_language_held_out(spark):
    found = QUERIES["op4_language_id"](spark, MEDIUM)
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98


def test_mix_meets_targets(spark):
    rows = QUERIES["op2_mixing"](spark, MEDIUM).collect()
    again = QUERIES["op2_mixing"](spark, MEDIUM).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for row in rows:
        doc = docs[row["doc_id"]]
        assert row["size"] == len(WORD.findall(doc["text"]))
        assert row["taken"] <= 3 * row["size"]
        sizes[doc["source"]] += row["size"]
        taken[doc["source"]] += row["taken"]
        target[doc["source"]] = row["target"]
    weights = {source: 1 + i % 3 for i, source in enumerate(sorted(sizes))}
    share, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while True:
        left = sum(sizes.values()) - sum(share[s] for s in sizes if s not in open_)
        for s in open_:
            share[s] = left * weights[s] / sum(weights[t] for t in open_)
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            share[s] = 3.0 * sizes[s]
        open_ -= over
    for source in sizes:
        assert target[source] == pytest.approx(share[source])
        assert taken[source] == pytest.approx(target[source], rel=0.03)


def test_components(spark):
    rows = texts(spark, MEDIUM)
    expected, sets = components(rows), {i: shingles(text) for i, text in rows}
    found = QUERIES["op5_ngram_join"](spark, MEDIUM).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row["n_shingles"] == len(sets[row["doc_id"]])
        assert row["component_id"] == expected[row["doc_id"]]


def test_next_and_edited_texts(spark):
    rows = sorted(texts(spark, SMALL), reverse=True)
    following = dict(zip([i for i, _ in rows], [t for _, t in rows[1:] + rows[:1]], strict=True))
    text = dict(rows)
    prints = {}
    for row in QUERIES["op6_winnowing"](spark, SMALL).collect():
        own = text[row["doc_id"]]
        third = len(own) // 3
        edited = own[: len(own) - third] + following[row["doc_id"]][:third]
        assert row["n_chars"] == len(own)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        assert prints.setdefault(own, row["fingerprint"]) == row["fingerprint"]
        if edited == own:
            assert row["near_edited"] == 1


def test_shards_are_even_and_gapless(spark):
    text = dict(texts(spark, MEDIUM))
    load, places = Counter(), defaultdict(list)
    for row in QUERIES["op7_sharding"](spark, MEDIUM).collect():
        data = text[row["doc_id"]].encode()
        assert (row["size"], row["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        assert row["law"] == "bytes" and row["grown_shard"] is None
        load[row["shard"]] += row["size"]
        places[row["shard"]].append(row["slot"])
    assert set(load) == set(range(40))
    assert max(load.values()) < 1.02 * min(load.values())
    for slots in places.values():
        assert sorted(slots) == list(range(len(slots)))


def test_encoding_is_that_of_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    text = dict(texts(spark, SMALL))
    for row in QUERIES["op9_sentencepiece"](spark, SMALL).collect():
        ids = model.encode(text[row["doc_id"]])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert row["n_pieces"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert row["round_trip"]
