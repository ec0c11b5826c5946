"""An adaptive radix tree over byte strings, some of which may be prefixes of others.

Inner nodes hold the bytes that all keys below share (path compression) and one of
four layouts of children, which grows as children are added: 4 and 16 sorted key
bytes with as many places, 48 places behind an index of 256 bytes, 256 places.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

_ABSENT = 255


class Sorted:
    """Up to ``room`` children beside their sorted key bytes."""

    __slots__ = ("keys", "nodes", "room")

    def __init__(self, room: int = 4) -> None:
        self.room, self.keys, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        at = self.keys.find(byte)
        return None if at < 0 else self.nodes[at]

    def put(self, byte: int, node) -> Sorted | Indexed:
        """Set a child; the layout to use from now on."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.keys) == self.room:
            larger = Sorted(16) if self.room == 4 else Indexed()
            for key, child in self:
                larger.put(key, child)
            return larger.put(byte, node)
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def __iter__(self) -> Iterator[tuple]:
        return zip(self.keys, self.nodes, strict=True)


class Indexed:
    """Up to 48 children; the index says at which place each key byte's child is."""

    __slots__ = ("index", "nodes")

    def __init__(self) -> None:
        self.index, self.nodes = bytearray([_ABSENT]) * 256, []

    def get(self, byte: int):
        at = self.index[byte]
        return None if at == _ABSENT else self.nodes[at]

    def put(self, byte: int, node) -> Indexed | Direct:
        at = self.index[byte]
        if at != _ABSENT:
            self.nodes[at] = node
        elif len(self.nodes) == 48:
            larger = Direct()
            for key, child in self:
                larger.put(key, child)
            return larger.put(byte, node)
        else:
            self.index[byte] = len(self.nodes)
            self.nodes.append(node)
        return self

    def __iter__(self) -> Iterator[tuple]:
        return ((byte, self.nodes[at]) for byte, at in enumerate(self.index) if at != _ABSENT)


class Direct:
    """A place for each key byte."""

    __slots__ = ("nodes",)

    def __init__(self) -> None:
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> Direct:
        self.nodes[byte] = node
        return self

    def __iter__(self) -> Iterator[tuple]:
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


class Node:
    """The bytes from the branch above to this node, the value of a key that ends here, and children."""

    __slots__ = ("children", "path", "value")

    def __init__(self, path: bytes, value=None) -> None:
        self.path, self.value, self.children = path, value, None

    def put(self, byte: int, child: Node) -> None:
        self.children = (Sorted() if self.children is None else self.children).put(byte, child)


def shared_bytes(a: bytes, b: bytes) -> int:
    """Length of the common prefix: by halving steps, each of which compares slices."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    """Keys with values that are not None; a key that is set again takes the new value."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def set(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.value = value
                return
            byte = key[at]
            child = None if node.children is None else node.children.get(byte)
            if child is None:
                node.put(byte, Node(key[at:], value))
                return
            rest = key[at : at + len(child.path)]
            same = shared_bytes(child.path, rest)
            if same < len(child.path):
                middle = Node(rest[:same])
                child.path = child.path[same:]
                middle.put(child.path[0], child)
                node.put(byte, middle)
                child = middle
            node, at = child, at + same

    def walk(self) -> Iterator[tuple[int, bytes, object]]:
        """Depth first: for each node the byte depth at which it hangs, its path and its value or None."""
        stack = [(0, self.root)]
        while stack:
            depth, node = stack.pop()
            yield depth, node.path, node.value
            if node.children is not None:
                below = depth + len(node.path)
                stack += [(below, child) for _, child in node.children][::-1]
