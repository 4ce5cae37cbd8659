"""Loads that edit the stored slot map, and trees that are grown on half of the rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from starmart.llm import common, rule_ensemble, sharding

ROW = "doc_id bigint, text string"
SLOTS = 512


def texts(spark, numbers):
    return spark.createDataFrame([(i, f"text {i} " * (i % 40)) for i in numbers], ROW)


def placed(frame, folder, shards=8):
    return sharding.shard_documents(frame, shards, SLOTS, folder).collect()


def test_a_second_load_moves_only_the_slots_of_the_edit(spark, tmp_path):
    folder = str(tmp_path / "map")
    first = placed(texts(spark, range(2000)), folder)
    more = placed(texts(spark, range(2400)), folder)
    before, after = (sharding.SlotMap.load(spark, folder, v) for v in (2, 3))
    assert {r["map_version"] for r in first} == {2} and {r["map_version"] for r in more} == {3}
    for rows, slot_map in ((first, before), (more, after)):
        assert all(r["shard"] == slot_map.shard_of[r["virtual_slot"]] for r in rows)
        load = Counter()
        for r in rows:
            load[r["shard"]] += r["size"]
        assert max(load.values()) < 1.1 * min(load.values())
    moved = {s for s in range(SLOTS) if before.shard_of[s] != after.shard_of[s]}
    assert 0 < len(moved) < SLOTS / 4
    was = {r["doc_id"]: r["shard"] for r in first}
    assert all(r["shard"] == was[r["doc_id"]] for r in more if r["doc_id"] in was and r["virtual_slot"] not in moved)


def test_one_more_shard_is_an_edit_too(spark, tmp_path):
    folder = str(tmp_path / "map")
    rows = texts(spark, range(2000))
    was = {r["doc_id"]: r["shard"] for r in placed(rows, folder)}
    grown = {r["doc_id"]: r["shard"] for r in placed(rows, folder, 9)}
    assert set(grown.values()) == set(range(9))
    elsewhere = [i for i in was if grown[i] not in (was[i], 8)]
    assert len(elsewhere) < len(was) / 20
    with pytest.raises(ValueError, match="512 slots"):
        sharding.shard_documents(rows, 8, 100, folder)


def test_every_row_gets_the_value_of_a_tree():
    draw = np.random.default_rng(0)
    x, residual = draw.normal(size=(400, 3)), draw.normal(size=400)
    residual += 3 * (x[:, 0] > 0.2)
    some = np.flatnonzero(draw.random(400) < 0.5)
    paths = []
    values = rule_ensemble._grow(x, residual, rule_ensemble._splits(x), some, np.arange(400), (), paths)
    leaves = [p for p in paths if not any(q[: len(p)] == p and len(q) > len(p) for q in paths)]
    expected = np.full(400, np.nan)
    for leaf in leaves:
        inside = rule_ensemble.holds(leaf, x)
        expected[inside] = residual[some][rule_ensemble.holds(leaf, x[some])].mean()
    assert np.allclose(values, expected)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://somewhere"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)
