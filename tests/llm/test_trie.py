"""The conversation trie against SQL and plain code."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from starmart.llm import prefix_trie
from starmart.llm.oracle_sql import ORACLE_SQL
from starmart.llm.radix_tree import Node4, Node16, Node48, Node256, Tree
from tests.llm.tables import LARGE

TURN = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """The nodes, from dictionaries of prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(own[c])] for c in own}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        ends[made[c]].append(c)
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        children[node[:-1]] += bool(node)
        own_saving = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own_saving
            leaves[node[:d]] += not children[node]
    return sorted(
        (
            members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), children[n],
            leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest(),
        )
        for n in members
    )


def listed(rows):
    return sorted(map(tuple, rows.collect()))


def odd_turns():
    draw = random.Random(7)
    rows = [(1, None, None, "first"), (1, 0, "user", None), (2, 0, None, None), (3, 5, "user", "héllo")]
    rows += [(None, 0, "user", "no conversation"), (4, 3, "a", "b"), (4, 3, "a", "b"), (4, 3, "a", "c")]
    rows += [(-6, 0, "user", "negative"), (-5, 0, "user", "base"), (-5, 1, "user", "base two")]
    for conv in range(10, 60):
        # Many share a head, and some are prefixes of others.
        for turn in range(draw.randrange(14)):
            rows.append((conv, turn, "ab"[turn % 2], f"t{turn}" if draw.random() < 0.9 else f"x{draw.randrange(3)}"))
    rows += [(100, turn, "user", f"long {turn}") for turn in range(300)]
    rows += [(101, turn, "user", f"long {turn}") for turn in range(200)]
    return rows


@pytest.mark.parametrize("run_rows", [3, 5, 4096])
def test_odd_conversations(spark, monkeypatch, run_rows):
    """Small runs take several levels, and give the same nodes."""
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", run_rows)
    # Ties in turn are ordered by turn id; with equal roles and texts that makes no difference.
    rows = [r for r in odd_turns() if r[3] != "c"]
    assert listed(prefix_trie.trie(spark.createDataFrame(rows, TURN))) == plain(rows)


def test_ties_and_clashing_columns(spark):
    rows = [(*r, "x", "y", "z") for r in odd_turns()]
    frame = spark.createDataFrame(rows, f"{TURN}, key string, digest string, depth string")
    assert len(listed(prefix_trie.trie(frame))) == len(plain(odd_turns()))


def test_no_conversations(spark):
    assert listed(prefix_trie.trie(spark.createDataFrame([], TURN))) == []
    only_unknown = spark.createDataFrame([(None, 1, "user", "text")], TURN)
    assert listed(prefix_trie.trie(only_unknown)) == []


@pytest.mark.parametrize("run_rows", [16, 4096])
def test_against_sql(spark, monkeypatch, run_rows):
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", run_rows)
    found = prefix_trie.trie(spark.read.parquet(f"{LARGE}/conversations.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{LARGE}/conversations.parquet'")
    expected = duck.execute(ORACLE_SQL["op13_prefix_trie"]).fetchall()
    assert sorted(map(repr, found.collect())) == sorted(repr(_row(found.columns, r)) for r in expected)


def _row(columns, values):
    from pyspark.sql import Row

    return Row(**dict(zip(columns, values, strict=True)))


def test_ids_of_a_large_class_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(-3, 500)]
    found = listed(prefix_trie.trie(spark.createDataFrame(rows, TURN)))
    assert found == plain(rows)


@pytest.mark.parametrize(("children", "kind"), [(4, Node4), (5, Node16), (17, Node48), (49, Node256), (256, Node256)])
def test_layouts_grow(children, kind):
    tree = Tree()
    order = list(range(children))
    random.Random(children).shuffle(order)
    for byte in order:
        tree.insert(b"shared" + bytes([byte]) + b"tail")
    node = tree.root.get(ord("s"))
    assert type(node) is kind and node.prefix == b"hared"
    assert [byte for byte, _ in node.items()] == list(range(children))
    assert all(tree.keys[node.get(byte)][6] == byte for byte in range(children))


def test_tree_holds_every_key():
    draw = random.Random(1)
    keys = {bytes(draw.choices(range(4), k=draw.randrange(12))) for _ in range(2000)}
    keys |= {bytes(draw.choices(range(256), k=6)) for _ in range(2000)}
    tree = Tree()
    for key in keys:
        tree.insert(key)
    ends = [(bottom, row) for _, _, bottom, row in tree.upward() if row is not None]
    assert sorted(tree.keys[row] for _, row in ends) == sorted(keys)
    assert all(bottom == len(tree.keys[row]) for bottom, row in ends)
