"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file and sent to the executors:

* the normaliser: a blank becomes the sign U+2581, one more is put in front;
* the pieces: an arc for each piece of the vocabulary, looked up by the hash of its
  characters, and for a character without a piece its bytes (byte fallback);
* for models of the BPE kind, an acceptor of neighbouring pieces: the weight of a
  pair is 0 if merging its joined text by rank ends with just these two pieces, and
  infinite otherwise. Models of the unigram kind weigh a piece by its negated
  score instead, and all pairs are accepted.

Each input is composed with them lazily and the shortest path of the tropical
semiring (sums of weights, least sum) is taken. For BPE at most one path has a
finite weight: the segmentation that the merges give. All distinct words of a
block advance through their positions together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from starmart.llm.common import runs_on_executors

runs_on_executors(__name__)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BLOCK_CHARS = 1_500_000
CACHE_BITS = 20
SCALAR_FROM = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ALL = (1 << 64) - 1


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _BASE + ord(c) + 1) & _ALL
    return h


class HashTable:
    """Vectorised lookup of 64-bit keys; open addressing, at most an eighth full."""

    def __init__(self, keys: list[int], values: list[int]):
        self.bits = max(8, (len(keys) * 8).bit_length())
        size = 1 << self.bits
        self.keys = np.zeros(size, np.uint64)
        self.values = np.full(size, -1, np.int32)
        for key, value in zip(keys, values, strict=True):
            at = ((key * int(_MIX)) & _ALL) >> (64 - self.bits)
            while self.values[at] >= 0:
                at = (at + 1) % size
            self.keys[at], self.values[at] = key, value

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for unknown ones."""
        at = ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.values[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[at] != keys))
        found[wrong] = -2
        while len(wrong):
            at = (at[wrong] + 1 if len(at) != len(wrong) else at + 1) & ((1 << self.bits) - 1)
            value = self.values[at]
            hit = (value < 0) | (self.keys[at] == keys[wrong])
            found[wrong[hit]] = value[hit]
            wrong, at = wrong[~hit], at[~hit]
        return found


@dataclass
class Machines:
    """The compiled machines; the id beyond the pieces is a character without one.

    ``table`` has all pieces, ``arcs`` those that a path can take.
    """

    pieces: list[str]
    kind_bpe: bool
    table: HashTable
    arcs: HashTable
    usable: np.ndarray
    weight: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    hashes: np.ndarray
    lengths: np.ndarray
    powers: np.ndarray
    byte_ids: np.ndarray
    longest: int
    cuts: str
    ids: dict[str, int] = field(default_factory=dict)
    known: dict[tuple[int, int], bool] = field(default_factory=dict)

    @property
    def other(self) -> int:
        """The id of a character that has no piece."""
        return len(self.pieces)


def _merge(text: str, rank: dict[str, float]) -> list[str]:
    """Merging by rank, leftmost first: what the acceptor is compiled from."""
    parts = list(text)
    while len(parts) > 1:
        best = min(
            ((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank),
            default=None,
        )
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


def compile_model(path: str = MODEL) -> Machines:
    """The machines of a SentencePiece model file, read on the driver."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    names = [model.id_to_piece(i) for i in range(size)]
    scores = np.array([model.get_score(i) for i in range(size)])
    plain = [
        not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        for i in range(size)
    ]
    byte_ids = np.full(256, model.unk_id(), np.int32)
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
    ids = {name: i for i, name in enumerate(names) if plain[i]}
    kind_bpe = bool(np.all(scores == np.round(scores)))
    order = {name: -scores[i] for name, i in ids.items() if len(name) > 1}
    rank, left, right = np.full(size + 1, -1.0), np.full(size + 1, -1), np.full(size + 1, -1)
    usable = np.array([*plain, True])
    for name, i in ids.items():
        if kind_bpe and len(name) > 1:
            last = _last_merge(name, order)
            usable[i] = last is not None
            rank[i] = order[name]
            if last:
                left[i], right[i] = (ids.get(part, size) for part in last)
    hashes = np.array([*(_hash(n) if p else 0 for n, p in zip(names, plain, strict=True)), 0], np.uint64)
    longest = max(map(len, ids), default=1)
    powers = np.array([pow(_BASE, k, 1 << 64) for k in range(longest * 2 + 1)], np.uint64)
    weight = np.append(np.zeros(size) if kind_bpe else -scores, 0 if kind_bpe else 10 - scores.min())
    cuts = "".join(c for c in "\n\t" if not any(c in name for name in ids))
    return Machines(
        names, kind_bpe, _table(ids), _table({n: i for n, i in ids.items() if usable[i]}), usable, weight,
        rank, left, right, hashes, np.array([*map(len, names), 1]), powers, byte_ids, longest, cuts, ids,
    )


def _table(ids: dict[str, int]) -> HashTable:
    return HashTable([_hash(name) for name in ids], list(ids.values()))


def _last_merge(name: str, order: dict[str, float]) -> tuple[str, str] | None:
    """The two parts that are merged last into a piece; None if merging ends otherwise."""
    parts = _merge(name, _Without(order, name))
    return (parts[0], parts[1]) if len(parts) == 2 else None


class _Without(dict):
    """A mapping less one key, without a copy."""

    def __init__(self, of: dict[str, float], name: str):
        super().__init__()
        self.of, self.name = of, name

    def __contains__(self, key: object) -> bool:
        return key != self.name and key in self.of

    def __getitem__(self, key: str) -> float:
        return self.of[key]


def pairs_accepted(m: Machines, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the text of each pair of pieces ends with the two of them.

    The merges that made a piece are undone, the latest first; before each, the two
    symbols at the seam must not have merged across it.
    """
    ok = np.ones(len(a), bool)
    at = np.flatnonzero((a < m.other) & (b < m.other))
    x, y, limit = a[at], b[at], np.full(len(at), np.inf)
    while len(at):
        joined = m.table.get(m.hashes[x] * m.powers[m.lengths[y]] + m.hashes[y])
        crossed = (joined >= 0) & (m.rank[joined] < limit)
        ok[at[crossed]] = False
        undo_x = m.rank[x] > m.rank[y]
        atomic = np.where(undo_x, m.left[x], m.left[y]) < 0
        limit = np.where(undo_x, m.rank[x], np.nextafter(m.rank[y], np.inf))
        nx, ny = np.where(undo_x, m.right[x], x), np.where(undo_x, y, m.left[y])
        go = ~crossed & ~atomic & (nx < m.other) & (ny < m.other)
        at, x, y, limit = at[go], nx[go], ny[go], limit[go]
    return ok


class Pairs:
    """The acceptor with what it has answered so far, in a table of fixed size."""

    def __init__(self, m: Machines):
        self.m = m
        self.keys = np.full(1 << CACHE_BITS, -1, np.int64)
        self.answers = np.zeros(1 << CACHE_BITS, bool)

    def accepted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.int64) << 32 | b
        at = ((pair.view(np.uint64) * _MIX) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        answer = self.answers[at]
        unknown = np.flatnonzero(self.keys[at] != pair)
        if len(unknown):
            new, back = np.unique(pair[unknown], return_inverse=True)
            found = pairs_accepted(self.m, (new >> 32).astype(np.int32), (new & 0xFFFFFFFF).astype(np.int32))
            answer[unknown] = found[back]
            self.keys[at[unknown]], self.answers[at[unknown]] = pair[unknown], answer[unknown]
        return answer


def shortest_paths(m: Machines, pairs: Pairs, words: np.ndarray) -> np.ndarray:
    """Piece ids of words of one length, given as a matrix of code points.

    Row by row, each id stands where its piece ends, -1 elsewhere. ``last`` is the piece on the best path to each position, ``cost`` its weight.
    """
    k, n = words.shape
    codes = words.astype(np.uint64) + np.uint64(1)
    sums = np.zeros((n + 1, k), np.uint64)
    for i in range(n):
        sums[i + 1] = sums[i] * np.uint64(_BASE) + codes[:, i]
    last = np.full((n + 1, k), -1, np.int32)
    cost = np.full((n + 1, k), np.inf)
    size = np.zeros((n + 1, k), np.int32)
    cost[0] = 0
    row = np.arange(k)
    for i in range(1, n + 1):
        lengths = np.arange(1, min(i, m.longest) + 1)
        start = i - lengths
        hashed = sums[i] - sums[start] * m.powers[lengths][:, None]
        piece = m.arcs.get(hashed.ravel())
        piece[:k] = np.where(piece[:k] < 0, m.other, piece[:k])
        at = np.flatnonzero(piece >= 0)
        source = (i - 1 - at // k) * k + at % k
        weight = cost.ravel()[source] + m.weight[piece[at]]
        if m.kind_bpe:
            joins = np.flatnonzero(np.isfinite(weight) & (source >= k))
            bad = ~pairs.accepted(last.ravel()[source[joins]], piece[at[joins]])
            weight[joins[bad]] = np.inf
        total = np.full(hashed.shape, np.inf)
        total.ravel()[at] = weight
        piece = piece.reshape(hashed.shape)
        best = np.argmin(total, axis=0)
        cost[i] = total[best, row]
        last[i] = np.where(np.isfinite(cost[i]), piece[best, row], -1)
        size[i] = lengths[best]
    out = np.full((k, n), -1, np.int32)
    at = np.full(k, n)
    for _ in range(n):
        going = np.flatnonzero(at > 0)
        if not len(going):
            break
        ends = at[going]
        out[going, ends - 1] = last[ends, going]
        at[going] -= size[ends, going]
    return out


def shortest_path(m: Machines, pairs: Pairs, word: str) -> list[int]:
    """The same for one long word, position by position."""
    cost, last, size = [0.0], [-1], [0]
    for i in range(1, len(word) + 1):
        best = (np.inf, -1, 1)
        for length in range(1, min(i, m.longest) + 1):
            piece = m.ids.get(word[i - length : i], m.other if length == 1 else -1)
            if piece < 0 or not m.usable[piece] or cost[i - length] == np.inf:
                continue
            if m.kind_bpe and i > length:
                key = (last[i - length], piece)
                if key not in m.known:
                    a, b = (np.array([x], np.int32) for x in key)
                    m.known[key] = bool(pairs.accepted(a, b)[0])
                if not m.known[key]:
                    continue
            best = min(best, (cost[i - length] + float(m.weight[piece]), piece, length))
        cost.append(best[0])
        last.append(best[1])
        size.append(best[2])
    out, at = [], len(word)
    while at > 0:
        out.append(last[at])
        at -= size[at]
    return out[::-1]


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _spelled(m: Machines, ids: list[int], word: str) -> np.ndarray:
    """Ids with characters that have no piece written as their bytes."""
    out, at = [], 0
    for i in ids:
        if i == m.other:
            out += m.byte_ids[list(word[at].encode())].tolist()
            at += 1
        else:
            out.append(i)
            at += len(m.pieces[i])
    return np.array(out, np.int32)


def encode_words(
    m: Machines, pairs: Pairs, words: list[str]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece ids of distinct words, as (ids, start and size of each word's span).

    Words of one length advance together.
    """
    start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    parts, total = [np.empty(0, np.int32)], 0

    def add(at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        nonlocal total
        start[at], size[at] = total + np.cumsum(sizes) - sizes, sizes
        parts.append(ids)
        total += len(ids)

    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        if n > SCALAR_FROM:
            single = {int(i): shortest_path(m, pairs, words[i]) for i in at}
        else:
            joined = "".join([words[i] for i in at]).encode("utf-32-le")
            found = shortest_paths(m, pairs, np.frombuffer(joined, np.uint32).reshape(len(at), n))
            held = found >= 0
            add(at, found[held], held.sum(axis=1))
            odd = np.flatnonzero((found == m.other).any(axis=1))
            single = {int(at[i]): found[i][held[i]].tolist() for i in odd}
        for i, ids in single.items():
            whole = _spelled(m, ids, words[i])
            add(np.array([i]), whole, np.array([len(whole)]))
    return np.concatenate(parts), start, size


def encode_texts(m: Machines, pairs: Pairs, texts: list[str]) -> list[np.ndarray]:
    """Piece ids of each text. Pieces do not reach across the words that are split here."""
    pattern = re.compile(f"{SPACE}*[^{SPACE}{m.cuts}]+|{SPACE}+" + (f"|[{m.cuts}]" if m.cuts else ""))
    parts = [pattern.findall(normalised(text)) for text in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    every = np.empty(int(counts.sum()), object)
    every[:] = [word for p in parts for word in p]
    form, forms = pd.factorize(every)
    flat, starts, sizes = encode_words(m, pairs, list(forms))
    size = sizes[form]
    ends = np.cumsum(size)
    at = np.arange(int(size.sum())) + np.repeat(starts[form] - ends + size, size)
    ids = flat[at]
    ids_before = np.append(0, ends)[np.append(0, np.cumsum(counts))]
    return [ids[a:b] for a, b in zip(ids_before[:-1], ids_before[1:], strict=True)]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoded(m: Machines, batches: Iterator[pd.Series]) -> Iterator[list[np.ndarray]]:
    """Ids of all texts in turn, block by block, so that no more than a block is held."""
    pairs = Pairs(m)
    for batch in batches:
        for group in _groups(batch.fillna("").tolist()):
            yield encode_texts(m, pairs, group)


def _decoder(m: Machines) -> Callable[[np.ndarray], str]:
    """Pieces and bytes in a row, U+2581 as a blank, without the one in front."""
    spelled = [p.replace(SPACE, " ").encode() for p in m.pieces]
    for byte, i in enumerate(m.byte_ids.tolist()):
        spelled[i] = bytes([byte])
    size = np.array([len(s) for s in spelled], np.int64)
    flat, start = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(size) - size

    def decoded(ids: np.ndarray) -> str:
        n = size[ids]
        ends = np.cumsum(n)
        at = np.arange(int(n.sum())) + np.repeat(start[ids] - ends + n, n)
        return flat[at].tobytes().decode("utf-8", "replace").removeprefix(" ")

    return decoded


def encode(text: Column, m: Machines) -> Column:
    """Binary column of the ids, four bytes each, little end first; null is empty text."""

    @pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in _encoded(m, batches):
            yield pd.Series([i.tobytes() for i in ids], dtype=object)

    return encoded(text)


def decode(ids: Column, m: Machines) -> Column:
    """The text of a binary column of ids; null is no ids."""

    @pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = _decoder(m)
        for batch in batches:
            yield pd.Series([decoder(np.frombuffer(x or b"", np.int32)) for x in batch], dtype=object)

    return decoded(ids)


def encode_and_decode(text: Column, m: Machines) -> Column:
    """Struct of ids and decoded text, made by one worker a task."""

    @pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = _decoder(m)
        for ids in _encoded(m, batches):
            columns = {"ids": [i.tobytes() for i in ids], "decoded": [decoder(i) for i in ids]}
            yield pd.DataFrame(columns, dtype=object)

    return both(text)


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text, ids, decoded) of every row; ``path`` names the model file.

    Null and empty texts have no ids and decode to the empty text. Every other text
    decodes to itself, but that U+2581 comes back as a blank. Repeated rows get a
    row each. Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    slim = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    coded = slim.withColumn("coded", encode_and_decode(F.col("text"), compile_model(path)))
    return coded.select("doc_id", "text", "coded.ids", "coded.decoded")
