"""A HAT-trie for counts of word-id sequences.

Inner nodes of the shallow trie branch by one word id. Below them hash containers hold the rest of
each sequence with its count. A container of more than `burst` entries becomes a node with
one container per next id, so a hot first word does not make one huge table. Whole subtrees under
a first id leave the trie as runs sorted by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

Ids = tuple[int, ...]
Run = list[tuple[bytes, Ids, int]]


class Node(dict):
    """Children by word id: a Node, or a hash container of the remaining ids."""

    ended = 0


class HatTrie:
    def __init__(self, burst: int = 4096) -> None:
        self.root, self.burst, self.size = Node(), burst, 0

    def add(self, ids: Ids, by: int = 1) -> None:
        node = self.root
        for depth, word in enumerate(ids, 1):
            child = node.get(word)
            if child is None:
                child = node[word] = {}
            if type(child) is dict:
                rest = ids[depth:]
                count = child.get(rest)
                if count is None:
                    child[rest] = by
                    self.size += 1
                    if len(child) > self.burst:
                        node[word] = self._burst(child)
                else:
                    child[rest] = count + by
                return
            node = child
        self.size += not node.ended
        node.ended += by

    def _burst(self, container: dict) -> Node:
        node = Node()
        for rest, count in container.items():
            if rest:
                node.setdefault(rest[0], {})[rest[1:]] = count
            else:
                node.ended = count
        return node

    def _entries(self, child: Node | dict, ids: Ids) -> Iterator[tuple[Ids, int]]:
        if type(child) is dict:
            for rest, count in child.items():
                yield ids + rest, count
            return
        if child.ended:
            yield ids, child.ended
        for word, below in child.items():
            yield from self._entries(below, (*ids, word))

    def _weight(self, child: Node | dict) -> int:
        if type(child) is dict:
            return len(child)
        return bool(child.ended) + sum(self._weight(c) for c in child.values())

    def spill(self, words: list[bytes], keep: int = 0) -> Iterator[Run]:
        """Take out whole subtrees, the largest first, until at most `keep` entries stay.

        Each is a run of (words joined by a space, ids, count), sorted by the words.
        """
        weights = sorted(((self._weight(c), w) for w, c in self.root.items()), reverse=True)
        for weight, word in weights:
            if self.size <= keep:
                return
            subtree = self.root.pop(word)
            self.size -= weight
            yield sorted((b" ".join([words[i] for i in ids]), ids, n) for ids, n in self._entries(subtree, (word,)))
