"""An adaptive radix tree over byte keys.

An inner node starts with room for 4 children and grows to 16, 48 and 256. Bytes that
all keys below a node share are kept once, in its ``prefix``; a key without company is
a leaf and is not cut into nodes at all. A key may end inside of another one: the node
that it ends at holds its number.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Node4:
    """Up to four children; their bytes, sorted, stand beside them."""

    room = 4
    __slots__ = ("prefix", "row", "bytes", "children")

    def __init__(self, prefix: bytes, row: int | None = None):
        self.prefix, self.row = prefix, row
        self.bytes, self.children = bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.children[at]

    def put(self, byte: int, child) -> None:
        """Set the child of a byte; a new byte needs room."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.children[at] = child
        else:
            self.bytes.insert(at, byte)
            self.children.insert(at, child)

    def full(self) -> bool:
        return len(self.children) == self.room

    def items(self) -> Iterator[tuple[int, object]]:
        """Bytes and children, in the order of the bytes."""
        return zip(self.bytes, self.children, strict=True)

    def grown(self):
        """The same node in the next larger layout."""
        larger = LARGER[type(self)](self.prefix, self.row)
        for byte, child in self.items():
            larger.put(byte, child)
        return larger


class Node16(Node4):
    """As the smallest layout, with room for sixteen."""

    room = 16
    __slots__ = ()


class Node48(Node4):
    """An index of 256 places that point to up to 48 children."""

    room = 48
    __slots__ = ("place",)

    def __init__(self, prefix: bytes, row: int | None = None):
        super().__init__(prefix, row)
        self.place = bytearray(256)

    def get(self, byte: int):
        at = self.place[byte]
        return self.children[at - 1] if at else None

    def put(self, byte: int, child) -> None:
        at = self.place[byte]
        if at:
            self.children[at - 1] = child
        else:
            self.children.append(child)
            self.place[byte] = len(self.children)

    def items(self) -> Iterator[tuple[int, object]]:
        return ((byte, self.children[at - 1]) for byte, at in enumerate(self.place) if at)


class Node256(Node4):
    """A child for each byte."""

    room = 257
    __slots__ = ()

    def __init__(self, prefix: bytes, row: int | None = None):
        super().__init__(prefix, row)
        self.children = [None] * 256

    def get(self, byte: int):
        return self.children[byte]

    def put(self, byte: int, child) -> None:
        self.children[byte] = child

    def full(self) -> bool:
        return False

    def items(self) -> Iterator[tuple[int, object]]:
        return ((byte, child) for byte, child in enumerate(self.children) if child is not None)


LARGER = {Node4: Node16, Node16: Node48, Node48: Node256}


def shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of ``b`` from ``at`` on are those that ``a`` starts with."""
    high = min(len(a), len(b) - at)
    if a[:high] == b[at : at + high]:
        return high
    low = 0
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle
    return low


class Tree:
    """Different keys, numbered in the order in which they were put in. A leaf is a number."""

    def __init__(self):
        self.keys: list[bytes] = []
        self.root = Node4(b"")

    def insert(self, key: bytes) -> int:
        row = len(self.keys)
        self.keys.append(key)
        above, byte, node, depth = None, 0, self.root, 0
        while True:
            if isinstance(node, int):
                above.put(byte, self._fork(node, key, row, depth))
                return row
            same = shared(node.prefix, key, depth)
            if same < len(node.prefix):
                fork = Node4(node.prefix[:same])
                fork.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1 :]
                self._place(fork, key, row, depth + same)
                if above is None:
                    self.root = fork
                else:
                    above.put(byte, fork)
                return row
            depth += same
            if depth == len(key):
                node.row = row
                return row
            child = node.get(key[depth])
            if child is None:
                if node.full():
                    node = node.grown()
                    if above is None:
                        self.root = node
                    else:
                        above.put(byte, node)
                node.put(key[depth], row)
                return row
            above, byte, node, depth = node, key[depth], child, depth + 1

    def _fork(self, leaf: int, key: bytes, row: int, depth: int) -> Node4:
        other = self.keys[leaf]
        same = shared(other[depth:], key, depth)
        fork = Node4(key[depth : depth + same])
        self._place(fork, other, leaf, depth + same)
        self._place(fork, key, row, depth + same)
        return fork

    @staticmethod
    def _place(node: Node4, key: bytes, row: int, depth: int) -> None:
        if depth == len(key):
            node.row = row
        else:
            node.put(key[depth], row)

    def upward(self) -> Iterator[tuple[int, int, int, int | None]]:
        """Every edge after those below it, in the order of the keys.

        (children, top, bottom, row): the number of edges right below, the byte depths
        from ``top`` + 1 to ``bottom`` that it covers, and the key that ends there.
        """
        stack: list[tuple] = [(self.root, -1, None)]
        while stack:
            node, top, bottom = stack.pop()
            if isinstance(node, int):
                yield 0, top, len(self.keys[node]), node
            elif bottom is not None:
                yield sum(1 for _ in node.items()), top, bottom, node.row
            else:
                bottom = top + 1 + len(node.prefix)
                stack.append((node, top, bottom))
                stack.extend((child, bottom, None) for _, child in reversed(list(node.items())))
