"""A counting trie of word-id paths with burstable containers, bounded in memory.

A path is a 64-bit code whose leading bits belong to the first word, the next to the first two, the rest to
all words, so that a subtree is a range of codes. A container holds the codes under one prefix with their
counts; one that grows too large bursts into containers one byte deeper. When the trie is full, its
largest subtrees leave it whole, as sorted runs.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def tally(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes ascending and the sum of their counts."""
    if counts is None:
        codes = np.sort(codes)
        edges = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
        return codes[edges], np.diff(np.append(edges, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    edges = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[edges], np.add.reduceat(counts, edges) if len(edges) else counts


class Container:
    """Codes under one prefix: tallied ones, and runs not yet merged into them."""

    def __init__(self):
        self.codes, self.counts = np.empty(0, _U), np.empty(0, np.int64)
        self.runs: list = []
        self.waiting = 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.runs.append((codes, counts))
        self.waiting += len(codes)
        if self.waiting > max(4096, len(self.codes)):
            self.settle()

    def settle(self) -> None:
        if self.runs:
            self.codes, self.counts = tally(np.concatenate([self.codes, *(r[0] for r in self.runs)]),
                                            np.concatenate([self.counts, *(r[1] for r in self.runs)]))
            self.runs, self.waiting = [], 0

    def size(self) -> int:
        return len(self.codes) + self.waiting


class HatTrie:
    """Counts of codes. burst: entries of a container before it becomes a node; limit: entries of the whole trie."""

    def __init__(self, burst: int = 65_536, limit: int = 2_000_000):
        self.burst, self.limit, self.total = burst, limit, 0
        self.children: dict = {}

    def add(self, codes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Take sorted distinct codes with counts; returns the runs of subtrees that had to leave."""
        self._add(self.children, codes, counts, 0)
        if self.total <= self.limit:
            return []
        sizes = {byte: self._settled(child) for byte, child in self.children.items()}
        self.total, gone = sum(sizes.values()), []
        for byte in sorted(sizes, key=sizes.get, reverse=True):
            if 2 * self.total <= self.limit:
                break
            self.total -= sizes[byte]
            gone.append(byte)
        return [run for byte in sorted(gone) for run in self._runs(self.children.pop(byte))]

    def drain(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """All that is left, in the order of codes."""
        runs = [run for byte in sorted(self.children) if self._settled(self.children[byte]) for run in self._runs(self.children[byte])]
        self.children, self.total = {}, 0
        return runs

    def _add(self, children: dict, codes: np.ndarray, counts: np.ndarray, depth: int) -> None:
        byte = (codes >> _U(56 - 8 * depth)).astype(np.uint8)
        edges = np.append(np.flatnonzero(np.append(True, byte[1:] != byte[:-1])) if len(byte) else [], len(byte)).astype(np.int64)
        for a, b in zip(edges[:-1], edges[1:]):
            child = children.setdefault(int(byte[a]), Container())
            if isinstance(child, dict):
                self._add(child, codes[a:b], counts[a:b], depth + 1)
                continue
            before = child.size()
            child.add(codes[a:b], counts[a:b])
            self.total += child.size() - before
            if child.size() > self.burst and depth < 7:
                child.settle()
                if child.size() > self.burst:
                    self.total -= child.size()
                    children[int(byte[a])] = deeper = {}
                    self._add(deeper, child.codes, child.counts, depth + 1)

    def _settled(self, child) -> int:
        if isinstance(child, dict):
            return sum(map(self._settled, child.values()))
        child.settle()
        return child.size()

    def _runs(self, child) -> list:
        if isinstance(child, dict):
            return [run for byte in sorted(child) for run in self._runs(child[byte])]
        return [(child.codes, child.counts)]
