"""Similar groups against all pairs, where pairs are many or lie badly in the order."""

from __future__ import annotations

import random

import numpy as np
import pytest

from starmart.llm import ngram_join


def sets_of(texts):
    data = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(d) for d in data])).astype(np.int64)
    return ngram_join.shingles(np.frombuffer(b"".join(data), np.uint8), offsets)


def all_pairs(texts):
    """Smallest place that links reach, by comparing everything with everything."""
    plain = []
    for text in texts:
        words = text.split()
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        plain.append(set(runs or ([tuple(words)] if words else [])))
    group = list(range(len(texts)))
    for i, a in enumerate(plain):
        for j in range(i):
            both = len(a & plain[j])
            if both and 100 * both >= 75 * (len(a) + len(plain[j]) - both):
                old, new = sorted((group[i], group[j]), reverse=True)
                group = [new if g == old else g for g in group]
    return group


def components(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = ngram_join.similar_groups(docs).collect()
    return [row["component_id"] for row in sorted(found, key=lambda row: row["doc_id"])]


def edited(rng, words, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("length", [60, 300, 700])
def test_families_of_edited_copies(spark, length):
    """Similarities from 0.5 to 0.9: most pairs share shingles, not all are linked."""
    rng = random.Random(length)
    texts = []
    for family in range(3):
        words = [f"w{family}_{rng.randrange(10**6)}" for _ in range(length)]
        texts += [edited(rng, words, rng.choice([0.005, 0.01, 0.03, 0.05])) for _ in range(30)]
    rng.shuffle(texts)
    expected = all_pairs(texts)
    assert 3 < len(set(expected)) < len(texts)
    assert components(spark, texts) == expected


def test_sets_without_a_lower_half(spark):
    """Texts of 400 words, all of whose shingles are in the upper half of the order."""
    rng = random.Random(5)
    words = [f"s{i}" for i in range(4)]
    while len(words) < 400:
        tail = [f"u{rng.randrange(10**9)}" for _ in range(12)]
        made = sets_of([" ".join([*words[-4:], word]) for word in tail])
        words += [w for w, s in zip(tail, made, strict=True) if s[0] >= 1 << 63][:1]
    text = " ".join(words)
    assert sets_of([text])[0].min() >= 1 << 63
    near = " ".join(words[:-1] + ["another"])
    other = " ".join(f"o{i}" for i in range(400))
    assert components(spark, [other, text, near, near + " end"]) == [0, 1, 1, 1]


def test_bits_that_differ_are_shingles_of_one_set():
    rng = np.random.default_rng(3)
    for size in (1, 40, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for keep in (1.0, 0.9, 0.5, 0.0):
            b = np.union1d(a[rng.random(len(a)) < keep], rng.integers(0, 1 << 63, 20).astype(np.uint64))
            differ = sum(
                int(x ^ y).bit_count()
                for x, y in zip(
                    ngram_join.signature(a).view(np.uint64), ngram_join.signature(b).view(np.uint64), strict=True
                )
            )
            assert differ <= len(np.setxor1d(a, b))


def test_the_number_of_fragments_does_not_matter(spark):
    texts = ["a b c d e f g", "a b c d e f g h", "q", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = [
        sorted(tuple(row) for row in ngram_join.catalogue(docs, fragments).collect())
        for fragments in (2, 64, 500)
    ]
    assert found[0] == found[1] == found[2]


def test_edited_copies_meet_in_few_families(spark, monkeypatch):
    """Forty copies of about 0.63: few rows are joined, and bits rule their pairs out."""
    sizes = {"members": [], "candidates": []}

    def counted(rows, label, *partitions, plain=ngram_join.stored):
        table = plain(rows, label, *partitions)
        if label in sizes:
            sizes[label].append(table.count())
        return table

    monkeypatch.setattr(ngram_join, "stored", counted)
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    texts = [edited(rng, words, 0.025) for _ in range(40)]
    assert components(spark, texts) == all_pairs(texts)
    assert 0 < sizes["members"][0] <= 20 * len(texts)
    assert sum(sizes["candidates"]) <= 3 * len(texts)


@pytest.mark.parametrize("length", [120, 280, 330, 500])
def test_two_digests_of_many_texts(spark, length):
    """Shingles with the same first and last class join texts without one in common."""
    rng = random.Random(length)
    parts = [[f"p{i}_{j}" for j in range(length // 6)] for i in range(6)]
    every = [w for part in parts for w in part]
    texts = [" ".join(every), " ".join([*every[: length // 2], "middle", *every[length // 2 :]])]
    for part in parts:
        own = [f"o{rng.randrange(10**9)}" for _ in range(8)]
        texts += [" ".join(part + own[:n]) for n in (0, 1, 2, 8)]
    rng.shuffle(texts)
    expected = all_pairs(texts)
    assert 1 < len(set(expected)) < len(texts)
    assert components(spark, texts) == expected
