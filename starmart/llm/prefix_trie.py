"""Conversation prefix trie over adaptive radix trees.

A turn becomes a turn id of fixed width: 16 bytes that stand for its role and text,
most significant first, so that ids compare like bytes. A conversation is the string of
its turn ids, and a node of the trie is a prefix that ends with a whole turn. Tasks put
runs of the sorted strings into adaptive radix trees; a depth in bytes that is no
multiple of the id's width emits nothing, a compressed path emits each aligned depth.

A node whose strings all lie in one run is finished there. The others are prefixes of
the first or the last string of a run: these two strings go on, with what has been
counted beside them, as the rows of the next level, whose runs are built and finished
in the same way. A level has two rows for each run of the one before, until one run
holds all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.llm import radix_tree
from starmart.llm.common import runs_on_executors, stored, whole

runs_on_executors(__name__)
runs_on_executors(radix_tree.__name__)

WIDTH = 16
GROUP = 5
HEADS = 9
RUN_ROWS = 4096
RUN_BYTES = 16_000_000
PIECE = 4096
NO_ID = (1 << 63) - 1
DIGEST = 32
NOTHING = hashlib.sha256(b"").hexdigest()

#: convs, conv_id, children, leaves, saved_tokens of a depth: what is known of its node so far.
KNOWN = 5
_EMPTY = np.array([0, NO_ID, 0, 0, 0], np.int64)

_ROW = "key binary, sizes binary, convs bigint, conv_id bigint, known binary, ends binary"
_NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint,"
    " n_leaves bigint, saved_tokens bigint, ends binary, prefix binary, parent_prefix binary"
)
_MADE = f"open boolean, key binary, sizes binary, known binary, {_NODE}"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(",")]


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes for a role and a text; the role's length keeps the two apart."""
    sized = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.md5(sized))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (turn, id, size).

    Turns are ordered by ``turn``, null first, then by turn id. A role or text of null is
    empty. Rows without ``conv_id`` belong to no conversation and are left out. ``size``
    is the text's number of bytes. A repeated row is a repeated turn.
    """
    role, text = whole(F.col("role")), whole(F.col("text"))
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"), turn_id(role, text).alias("id"), F.octet_length(text).alias("size")
    )
    conv = F.col("conv_id").cast("bigint")
    turns = conversations.where(conv.isNotNull()).select(conv.alias("conv_id"), turn.alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(own: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(conv_id, turns): conversations that share the head of their group's first one.

    Conversation c takes its first h turns from conversation c - c % ``group`` (all if it
    has fewer, none if there is none), then its own turns after its first h; h is the
    unsigned crc32 of the decimal c, modulo ``heads``.
    """
    conv = F.col("conv_id")
    h = (F.crc32(conv.cast("string").cast("binary")) % heads).cast("int").alias("h")
    mine = own.select("conv_id", "turns", h, (conv - conv % group).alias("base"))
    first = own.where(conv % group == 0).select(
        conv.alias("of"), F.slice("turns", F.lit(1), F.lit(max(heads - 1, 1))).alias("head")
    )
    none = F.slice("turns", F.lit(1), F.lit(0))
    taken = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    joined = mine.join(first, F.col("base") == F.col("of"), "left")
    return joined.select("conv_id", F.concat(taken, rest).alias("turns"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the sorted (digest, conv_id) of one digest, as text, ``PIECE`` ids at most."""
    for batch in batches:
        digests = batch.column("digest").to_pylist()
        ids = batch.column("conv_id").to_pylist()
        cuts = [i for i in range(1, len(ids)) if digests[i] != digests[i - 1]]
        rows = []
        for begin, end in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            for at in range(begin, end, PIECE):
                part = ids[at : min(at + PIECE, end)]
                rows.append((digests[at], part[0], ",".join(map(str, part)).encode()))
        if rows:
            digest, first, text = zip(*rows, strict=True)
            arrays = [pa.array(digest, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "first", "text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each digest, which come one after the other."""
    now, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if digest == now:
                state.update(b",")
            else:
                done.append((now, state.digest()))
                now, state = digest, hashlib.sha256()
            state.update(text)
        yield _ends(done)
    yield _ends([(now, state.digest())])


def _ends(done: list[tuple[bytes | None, bytes]]) -> pa.RecordBatch:
    done = [row for row in done if row[0] is not None]
    arrays = [pa.array([row[i] for row in done], pa.binary()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(arrays, ["of", "ends"])


def classes(convs: DataFrame) -> DataFrame:
    """Conversations (conv_id, turns) with the same turns as one row of ``_ROW``.

    ``ends`` is the SHA-256 of their ids in rising order, joined by commas. The ids of a
    large class are sorted by ranges and joined to long pieces in many tasks; only the
    pieces meet, and are hashed one after the other.
    """
    hexed = F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")
    # Four bytes each: joined like the ids, read as an array by the tasks.
    sizes = F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(t["size"]), 8, "0")), "")
    keyed = convs.select("conv_id", F.unhex(hexed).alias("key"), F.unhex(sizes).alias("sizes"))
    keyed = stored(keyed.withColumn("digest", F.unhex(F.md5("key"))), "rebuilt")
    order = ["digest", "conv_id"]
    sorted_ids = keyed.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = sorted_ids.mapInArrow(_pieces, "digest binary, first bigint, text binary")
    met = pieces.repartition("digest").sortWithinPartitions("digest", "first")
    ends = met.mapInArrow(_hashed, "of binary, ends binary")
    same = keyed.groupBy("digest").agg(
        F.first("key").alias("key"),
        F.first("sizes").alias("sizes"),
        F.count("*").alias("convs"),
        F.min("conv_id").alias("conv_id"),
    )
    joined = same.join(ends, F.col("digest") == F.col("of"))
    return joined.withColumn("known", F.lit(None).cast("binary")).select(*_names(_ROW))


class Run:
    """One run of sorted rows as a radix tree, and the nodes that come of it.

    A row's string ends at a node and brings that node ``convs`` members. A row of a
    higher level also brings, for each depth of its string, what lower levels know of
    that node: its members, their smallest id, its finished children, leaves and savings.
    """

    def __init__(self, rows: list[tuple], last: bool, level: int):
        self.rows, self.last, self.level = rows, last, level
        self.sizes = [np.frombuffer(row[1], ">i4") for row in rows]
        self.nodes: list[list] = []
        self.spines: dict[int, tuple[np.ndarray, dict[int, bytes]]] = {}
        self.digests: dict[int, list[bytes]] = {}
        tree = radix_tree.Tree()
        for row in rows:
            tree.insert(row[0])
        below: list[list] = []
        for children, top, bottom, row in tree.upward():
            parts = below[len(below) - children :]
            del below[len(below) - children :]
            below.append(self._edge(parts, top, bottom, row))

    def _digest(self, row: int, depth: int) -> bytes:
        """What stands for the first ``depth`` turns of a row."""
        if row not in self.digests:
            state, made = hashlib.md5(), []
            key = self.rows[row][0]
            for at in range(0, len(key) + 1, WIDTH):
                made.append(state.copy().digest())
                state.update(key[at : at + WIDTH])
            self.digests = {row: made}
        return self.digests[row][depth]

    def _edge(self, parts: list[list], top: int, bottom: int, row: int | None) -> list:
        """The nodes on an edge, deepest first: [sums, tops, known, ends, first, last row]."""
        sums, tops, known, ends = _EMPTY.copy(), [], None, {}
        rows = [part[4] for part in parts] + [part[5] for part in parts]
        deepest = bottom // WIDTH
        if row is not None:
            rows.append(row)
            _, _, convs, conv_id, path, own_ends = self.rows[row]
            sums += (convs, 0, 0, 0, 0)
            sums[1] = min(sums[1], conv_id)
            if path is not None:
                known = np.frombuffer(path, np.int64).reshape(-1, KNOWN).copy()
                ends.update(_unpacked(own_ends))
            elif own_ends is not None:
                ends[deepest] = own_ends
        for part_sums, part_tops, part_known, part_ends, _, _ in parts:
            sums = _added(sums, part_sums)
            tops += part_tops
            ends.update(part_ends)
            if part_known is not None:
                part_known = part_known[: deepest + 1]
                known = part_known if known is None else _added(known, part_known)
        first, last = min(rows), max(rows)
        for depth in range(deepest, top // WIDTH, -1):
            if known is not None:
                sums = _added(sums, known[depth])
            sums, tops = self._node(depth, sums, tops, ends.pop(depth, None), first, last)
        return [sums, tops, known, ends, first, last]

    def _node(self, depth: int, sums: np.ndarray, tops: list, ends: bytes | None, first: int, last: int):
        if not self.last and (first == 0 or last == len(self.rows) - 1):
            spine = 0 if first == 0 else last
            path, path_ends = self.spines.setdefault(
                spine, (np.tile(_EMPTY, (len(self.sizes[spine]) + 1, 1)), {})
            )
            path[depth] = sums
            if ends is not None:
                path_ends[depth] = ends
            for node in tops:
                self.nodes[node][-1] = self._digest(first, depth)
            return _EMPTY.copy(), []
        convs, conv_id, children, leaves, saved = sums.tolist()
        size = int(self.sizes[first][depth - 1]) if depth else 0
        leaves = leaves if children else 1
        saved += (convs - 1) * size
        for node in tops:
            self.nodes[node][2] = conv_id
        prefix = self._digest(first, depth) if self.level else None
        self.nodes.append([conv_id, depth, None, convs, children, leaves, saved, ends, prefix, None])
        return np.array([convs, conv_id, 1, leaves, saved], np.int64), [len(self.nodes) - 1]

    def made(self) -> Iterator[tuple]:
        """Finished nodes, and the strings that go on."""
        for node in self.nodes:
            yield (False, None, None, None, *node)
        for spine, (path, ends) in self.spines.items():
            key, sizes = self.rows[spine][:2]
            yield (True, key, sizes, path.tobytes(), *[None] * 7, _packed(ends), None, None)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of what is known, and the smaller id; ``b`` may end before ``a`` or after it."""
    if len(b) > len(a):
        a, b = b, a
    out = a.copy()
    if a.ndim == 1:
        out += b
        out[1] = min(a[1], b[1])
    else:
        out[: len(b)] += b
        out[: len(b), 1] = np.minimum(a[: len(b), 1], b[:, 1])
    return out


def _packed(ends: dict[int, bytes]) -> bytes:
    return b"".join(depth.to_bytes(4, "big") + digest for depth, digest in ends.items())


def _unpacked(packed: bytes) -> dict[int, bytes]:
    step = 4 + DIGEST
    cut = [packed[at : at + step] for at in range(0, len(packed), step)]
    return {int.from_bytes(x[:4], "big"): x[4:] for x in cut}


def _grown(last: bool, level: int):
    """Trees over runs of the sorted rows of a partition, one after the other."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(name).to_pylist() for name in _names(_ROW)], strict=True):
                rows.append(row)
                size += len(row[0])
                if not last and (len(rows) >= RUN_ROWS or size >= RUN_BYTES and len(rows) > 3):
                    yield _table(Run(rows, last, level))
                    rows, size = [], 0
        if rows:
            yield _table(Run(rows, last, level))

    return grow


def _table(run: Run) -> pa.RecordBatch:
    kinds = {"boolean": pa.bool_(), "binary": pa.binary(), "bigint": pa.int64()}
    columns = list(zip(*run.made(), strict=True))
    fields = [field.split() for field in _MADE.split(",")]
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def nodes(convs: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turns), one row for each node.

    A node is a different sequence of the first ``depth`` turns; the root has depth 0 and
    no text. ``n_convs`` conversations start with it, ``conv_id`` is the smallest of them
    and ``parent_conv_id`` that of its parent (root: null). ``n_leaves`` counts nodes
    without children in its subtree, itself included; ``saved_tokens`` adds up, over its
    subtree, (n_convs - 1) x bytes of the node's last text. ``ends_sha256`` is that of the
    ids of the conversations that end here. Conversations without turns end at the root.
    Without conversations there are no nodes.
    """
    rows = stored(classes(convs), "classes")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    finished: list[DataFrame] = []
    level = 0
    while True:
        count = rows.count()
        last = count <= RUN_ROWS
        if last:
            dealt = rows.coalesce(1)
        else:
            # Enough rows for each run, so that a level is far smaller than the one before.
            dealt = rows.repartitionByRange(max(1, min(tasks, count // 64)), "key")
        made = dealt.sortWithinPartitions("key").mapInArrow(_grown(last, level), _MADE)
        made = stored(made, f"level-{level}", "open")
        finished.append(made.where(~F.col("open")).select(*_names(_NODE)))
        if last:
            break
        rows = stored(
            made.where("open").select(
                "key", "sizes", F.lit(0).cast("bigint").alias("convs"),
                F.lit(NO_ID).alias("conv_id"), "known", "ends",
            ),
            f"rows-{level + 1}",
        )
        level += 1
    every = reduce(DataFrame.unionAll, finished)
    # Only nodes that were open for a while can be the parent of one finished before.
    later = every.where(F.col("prefix").isNotNull()).select(
        F.col("prefix").alias("of"), F.col("conv_id").alias("found")
    )
    joined = every.join(later, F.col("parent_prefix") == F.col("of"), "left")
    return joined.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "found").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce(F.lower(F.hex("ends")), F.lit(NOTHING)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """The nodes of the rebuilt conversations; see ``sequences``, ``rebuilt`` and ``nodes``."""
    return nodes(rebuilt(stored(sequences(conversations), "sequences"), group, heads))
