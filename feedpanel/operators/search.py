"""Breadth-first search of one graph from many sources inside a task.

Nodes are whole numbers in falling order of their in-degree, so the ``r``-th edges
into a run of nodes belong to a prefix of it. Every node has one bit per source of
a batch; a step ORs the bits of the nodes that were reached last along the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

# Nodes that are brought on at a time, in-degree from which a node is brought on by
# itself, and edges below which a step follows the edges out of the nodes reached last.
_ROWS_AT_ONCE = 8192
_HUB = 64
_FEW_EDGES = 100_000

PACKED = "first bigint, lead bigint, n bigint, steps binary, src binary"


def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (d, s), sorted, as few rows: the first ``d``, a bit per edge that tells
    whether ``d`` is one more than before, and four bytes of ``s`` per edge."""
    for pdf in batches:
        if len(pdf):
            d, s = pdf["d"].to_numpy("int64"), pdf["s"].to_numpy("int64")
            steps = np.packbits(np.diff(d, prepend=d[0]).astype(bool))
            yield pd.DataFrame({"first": [d[0]], "lead": [s[0]], "n": [len(d)], "steps": [steps.tobytes()], "src": [s.astype("<u4").tobytes()]})


def unpack(packed: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) of all edges, in the order of (dst, src)."""
    packed = packed.sort_values(["first", "lead"])
    src = np.concatenate([np.frombuffer(b, "<u4") for b in packed["src"]]).astype(np.int64)
    steps = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(packed["steps"], packed["n"])]
    dst = np.concatenate([first + np.cumsum(s, dtype=np.int64) for first, s in zip(packed["first"], steps)])
    return src, dst


def _starts(ends: np.ndarray, n: int) -> np.ndarray:
    """Where the edges of each node begin in a list sorted by ``ends``."""
    return np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])


class Search:
    """The edges of a graph of ``n`` nodes and three tables of 64 * ``words`` bits per node."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int, words: int):
        self.src, self.start = src, _starts(dst, n)
        self.out, self.to = _starts(src, n), dst[np.argsort(src, kind="stable")]
        degree = np.diff(self.start)
        self.n_in, self.n_hubs = int((degree > 0).sum()), int((degree > _HUB).sum())
        # nodes with more than r edges into them, r = 0, 1, ...
        self.deep = [int((degree[: self.n_in] > r).sum()) for r in range(_HUB + 1)]
        self.seen, self.front, self.next = (np.zeros((n, words), np.uint64) for _ in range(3))
        self.part = np.empty((_ROWS_AT_ONCE, words), np.uint64)

    def sources(self) -> np.ndarray:
        """Nodes with edges out of them."""
        return np.flatnonzero(np.diff(self.out))

    def run(self, sources: np.ndarray, few: int = _FEW_EDGES) -> tuple[int, int]:
        """Pairs of a source and another node that it reaches, and the sum of their distances."""
        at = np.arange(len(sources))
        self.seen[:], self.front[:], self.next[:] = 0, 0, 0
        self.seen[sources, at // 64] = self.front[sources, at // 64] = np.left_shift(np.uint64(1), (at % 64).astype(np.uint64))
        depth = pairs = total = 0
        reached, active = 1, sources
        while reached:
            depth += 1
            edges = int((self.out[active + 1] - self.out[active]).sum())
            reached, active = (self._follow if edges <= few else self._bring)(active)
            pairs, total = pairs + reached, total + depth * reached
        return pairs, total

    def _follow(self, active: np.ndarray) -> tuple[int, np.ndarray]:
        """One step along the edges out of the active nodes."""
        size = self.out[active + 1] - self.out[active]
        place = np.arange(size.sum()) + np.repeat(self.out[active] - np.cumsum(size) + size, size)
        order = np.argsort(self.to[place], kind="stable")
        to, source = self.to[place][order], np.repeat(active, size)[order]
        heads = np.flatnonzero(np.diff(to, prepend=-1))
        node = to[heads]
        arrived = np.bitwise_or.reduceat(self.front[source], heads, axis=0) if len(to) else self.front[:0]
        fresh = arrived & ~self.seen[node]
        some = fresh.any(axis=1)
        node, fresh = node[some], fresh[some]
        self.front[active] = 0
        self.front[node] = fresh
        self.seen[node] |= fresh
        return int(np.bitwise_count(fresh).sum(dtype=np.int64)), node

    def _bring(self, active: np.ndarray) -> tuple[int, np.ndarray]:
        """One step along the edges into all nodes, some thousand nodes at a time."""
        reached, found = 0, []
        for low in range(0, self.n_in, _ROWS_AT_ONCE):
            high = min(low + _ROWS_AT_ONCE, self.n_in)
            got = self.next[low:high]
            got[:] = 0
            hubs = min(max(self.n_hubs, low), high)
            for node in range(low, hubs):
                for first in range(self.start[node], self.start[node + 1], _ROWS_AT_ONCE):
                    source = self.src[first : min(first + _ROWS_AT_ONCE, self.start[node + 1])]
                    got[node - low] |= np.bitwise_or.reduce(self.front[source], axis=0)
            for r in range(_HUB):
                end = min(self.deep[r], high)
                if end <= hubs:
                    break
                part = self.part[: end - hubs]
                np.take(self.front, self.src[self.start[hubs:end] + r], axis=0, out=part, mode="clip")
                got[hubs - low : end - low] |= part
            np.bitwise_and(got, ~self.seen[low:high], out=got)
            self.seen[low:high] |= got
            reached += int(np.bitwise_count(got).sum(dtype=np.int64))
            found.append(low + np.flatnonzero(got.any(axis=1)))
        # nodes without edges into them are reached by no step
        self.front[self.n_in :] = 0
        self.front, self.next = self.next, self.front
        return reached, np.concatenate(found)
