"""Substring dedup against plain code."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from starmart.llm import substring_dedup
from starmart.llm.queries import QUERIES
from tests.llm import tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """(id, words, kept words) of each row; a window's owner is the smallest id that has it."""
    split = [(i, WORD.findall(text or "")) for i, text in rows]
    owner = {}
    for i, words in split:
        for p in range(len(words) - 49):
            window = tuple(words[p : p + 50])
            if i is not None:
                owner[window] = min(owner.get(window, i), i)
    done = []
    for i, words in split:
        gone = set()
        for p in range(len(words) - 49):
            first = owner.get(tuple(words[p : p + 50]))
            if first is not None and (i is None or first < i):
                gone.update(range(p, p + 50))
        done.append((i, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return sorted(done, key=repr)


def found(frame):
    done = substring_dedup.dedup(frame)
    assert done.columns == [*[c for c in frame.columns if c != "substring_dedup"], "substring_dedup"]
    return sorted(((r["doc_id"], *r["substring_dedup"]) for r in done.collect()), key=repr)


def generated():
    """Passages of about the window's length at all distances from the blocks of others."""
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (48, 49, 50, 51, 74, 75, 120)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(draw.randrange(4)):
            words += [word() for _ in range(draw.randrange(60))]
            passage = draw.choice(passages)
            cut = draw.randrange(3)
            words += passage[cut:] if draw.random() < 0.8 else passage[:30] + [word()] + passage[31:]
        rows.append((draw.choice([i, i, i, None, 7]), draw.choice([" ", "\n", " \t "]).join(words)))
    # The same passage twice in one text, periodic texts, a copy, and one of 49 words.
    rows += [(200, " ".join(passages[4] * 2)), (201, "ab " * 200), (202, "ab " * 120), (203, "ab cd " * 100)]
    rows += [(204, rows[0][1]), (-5, " ".join(passages[6])), (205, " ".join(passages[1])), (206, " ".join(passages[1]))]
    return rows


def test_generated(spark):
    rows = generated()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(frame) == plain(rows)


def test_full_filters_change_nothing(spark, monkeypatch):
    """With bitmaps that say yes to everything, all windows are compared."""
    monkeypatch.setattr(substring_dedup.Filter, "__call__", lambda self, h: h == h)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 300)
    rows = generated()
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain(rows)


def test_odd_rows(spark):
    frame = tables.odd(spark)
    names = "doc place cut copy spans own_id own_mark moves substring_dedup digest least bytes h bucket".split()
    for name in names:
        if name not in frame.columns:
            frame = frame.selectExpr("*", f"'x' as {name}")
    assert found(frame) == plain([(r["doc_id"], r["text"]) for r in frame.collect()])


def test_no_rows(spark):
    assert found(tables.empty(spark)) == []


def test_long_text(spark):
    """Several megabytes, of which another document holds the end."""
    words = [f"word{i}" for i in range(600_000)]
    rows = [(1, " ".join(words[-70:])), (2, " ".join(words)), (3, "x" * 3_000_000)]
    done = {r[0]: r[1:] for r in found(spark.createDataFrame(rows, "doc_id bigint, text string"))}
    assert done[2] == (600_000, 70, " ".join(words[:-70]))
    assert done[3][:2] == (1, 0) and done[1][:2] == (70, 0)


def test_given_documents(spark):
    rows = tables.texts(spark, tables.SMALL)
    expected = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(rows)}
    result = {r[0]: tuple(r[1:]) for r in QUERIES["op11_substring_dedup"](spark, tables.SMALL).collect()}
    assert result == expected
    assert any(gone for _, gone, _ in expected.values())


@pytest.mark.parametrize("size", [25, 50])
def test_equal_windows_have_equal_hashes(size):
    import numpy as np

    text = " ".join(f"w{i}" for i in range(200))
    data = np.frombuffer((text + " " + text).encode(), np.uint8)
    words = substring_dedup.Words(data, np.array([0, len(text), len(data)]))
    at, hashes = words.windows(size, substring_dedup._BASES[1])
    half = 200 - size + 1
    assert len(at) == 2 * half
    assert (hashes[:half] == hashes[half:]).all() and len(set(hashes.tolist())) == half
