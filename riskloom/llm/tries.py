"""A trie as an open hash table, walked for many strings at once."""
from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


class Trie:
    """Entries are sequences of small numbers (bytes or code points); each has a value of at least 0."""

    def __init__(self, entries: Iterable[tuple[Sequence[int], int]]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for symbols, value in entries:
            at = 0
            for s in symbols:
                nxt = children[at].get(s)
                if nxt is None:
                    nxt = children[at][s] = len(children)
                    children.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = value
        self.ends = np.array(ends)
        bits = max(10, len(ends).bit_length() + 3)
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.goes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        todo = np.array([(at << 21) | s for at, c in enumerate(children) for s in c], np.int64)
        goes = np.array([n for c in children for n in c.values()], np.int64)
        slot = self._slot(todo)
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.goes[slot[free]] = todo[free], goes[free]  # of several for one slot the last stays
            left = self.keys[slot] != todo
            todo, goes, slot = todo[left], goes[left], (slot[left] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child by their symbol, and those children."""
        key = (node << 21) | symbol
        slot = self._slot(key)
        off = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        while len(off):
            slot[off] = (slot[off] + 1) & self.last
            off = off[(self.keys[slot[off]] != key[off]) & (self.keys[slot[off]] >= 0)]
        known = self.keys[slot] == key
        return known, self.goes[slot[known]]

    def matches(self, symbols: np.ndarray, sizes: np.ndarray, start: int, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For the given rows of a padded matrix: (end, rows, values) of the entries that begin at `start`."""
        live = rows[sizes[rows] > start]
        node, end = np.zeros(len(live), np.int64), start
        while len(live):
            known, node = self.step(node, symbols[live, end])
            live, end = live[known], end + 1
            value = self.ends[node]
            some = value >= 0
            if some.any():
                yield end, live[some], value[some]
            more = sizes[live] > end
            live, node = live[more], node[more]
