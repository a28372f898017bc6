"""Exact top-k inner products by a dual-tree search.

Items and documents are sparse vectors over the same coordinates; a score is
their inner product (items hold 0 or 1, documents whole numbers). Each side is held in a hierarchy whose nodes
know the maximum of every coordinate below them. The product of two nodes'
maxima bounds every score between them; where it is below the weakest k-th
score among the node's items, the whole batch of pairs is dropped.
"""

from __future__ import annotations

import heapq

import numpy as np

# Children of an item node, documents of a leaf.
ITEM_FAN = 8
DOC_LEAF = 16


def splits(start: np.ndarray, coord: np.ndarray, value: np.ndarray, n_coords: int,
           leaf: int) -> tuple[np.ndarray, list]:
    """A binary hierarchy over sparse rows: (order of the rows, nodes as (from,
    to, children)), root first.

    A node is split at the middle of its coordinate of largest variance, so
    rows that score alike come together.
    """
    order = np.arange(len(start) - 1)
    nodes: list = []

    def grow(a: int, b: int) -> int:
        at = len(nodes)
        nodes.append([a, b, ()])
        if b - a <= leaf:
            return at
        rows = order[a:b]
        size = start[rows + 1] - start[rows]
        place = np.arange(int(size.sum())) + np.repeat(start[rows] - (np.cumsum(size) - size), size)
        if not len(place):
            middle = (a + b) // 2
        else:
            c, v = coord[place], value[place].astype(np.float64)
            mean = np.bincount(c, v, n_coords) / (b - a)
            spread = np.bincount(c, v * v, n_coords) / (b - a) - mean * mean
            key = np.zeros(b - a)
            best = int(np.argmax(spread))
            mine = c == best
            key[np.repeat(np.arange(b - a), size)[mine]] = v[mine]
            order[a:b] = rows[np.argsort(-key, kind="stable")]
            above = int((key > mean[best]).sum())
            # Rows that hold more than the mean part from the rest, unless
            # they are very few or nearly all.
            middle = a + (above if 1 / 8 <= above / (b - a) <= 7 / 8 else (b - a) // 2)
        nodes[at][2] = (grow(a, middle), grow(middle, b))
        return at

    if len(order):
        grow(0, len(order))
    return order, nodes


class Items:
    """The item hierarchy: nodes with their coordinates, children and items."""

    def __init__(self, start: np.ndarray, coord: np.ndarray, n_coords: int):
        n = len(start) - 1
        order, _ = splits(start, coord, np.ones(len(coord)), n_coords, ITEM_FAN)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.order, self.n_coords = order, n_coords
        # Level 0 are the items in hierarchy order; each higher level joins
        # ITEM_FAN neighbours.
        sets = [coord[start[i]:start[i + 1]] for i in order]
        self.n, self.children, self.levels = n, [()] * n, []
        level, low = list(range(n)), np.arange(n)
        while len(level) > 1:
            upper = []
            for k in range(0, len(level), ITEM_FAN):
                below = level[k:k + ITEM_FAN]
                upper.append(len(sets))
                sets.append(np.unique(np.concatenate([sets[i] for i in below])))
                self.children.append(tuple(below))
            # First item below each node of the level.
            low = low[::ITEM_FAN]
            self.levels.append(low)
            level = upper
        self.root = level[0] if level else None
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        self.end = np.cumsum(self.size)

    def bounds(self, nodes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Inner product of each node's coordinates (some at least) with
        ``dense``."""
        size = self.size[nodes]
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1])) + np.repeat(self.end[nodes] - ends, size)
        return np.add.reduceat(dense[self.flat[place]], ends - size)


class Search:
    """Top ``k`` documents of every item among the batches added so far."""

    def __init__(self, items: Items, k: int, floors: np.ndarray):
        self.items, self.k = items, k
        # By hierarchy place: a score known to be reached by k documents, or
        # 1, the least score of a result.
        self.least = np.maximum(floors[items.order], 1)
        self.best: list = [[] for _ in range(items.n)]
        self.dense = np.zeros(items.n_coords, np.int64)
        self.pairs = self.scored = 0

    def _weakest(self) -> np.ndarray:
        """Per item node the weakest k-th score below it."""
        return np.concatenate([self.least] + [np.minimum.reduceat(self.least, low)
                                              for low in self.items.levels])

    def _take(self, place: int, score: int, doc: tuple) -> None:
        heap = self.best[place]
        if len(heap) < self.k:
            heapq.heappush(heap, (score, doc))
        elif (score, doc) > heap[0]:
            heapq.heapreplace(heap, (score, doc))
        if len(heap) == self.k:
            self.least[place] = max(self.least[place], heap[0][0])

    def add(self, ids: list, start: np.ndarray, coord: np.ndarray, value: np.ndarray) -> None:
        """Search a batch of documents: sparse rows whose ids order ties (a
        larger id tuple wins)."""
        if not self.items.n or len(start) < 2:
            return
        order, nodes = splits(start, coord, value, self.items.n_coords, DOC_LEAF)
        maxima = self._maxima(order, nodes, start, coord, value)
        stack = [(0, np.array([self.items.root]))]
        weakest = self._weakest()
        while stack:
            at, active = stack.pop()
            a, b, below = nodes[at]
            active = self._left(maxima[at], active, weakest)
            if not len(active):
                continue
            if below:
                # Both sides go one level down.
                active = np.concatenate([self.items.children[i] or (i,) for i in active])
                stack += [(child, active) for child in reversed(below)]
                continue
            for row in order[a:b]:
                s, e = start[row], start[row + 1]
                self._score(ids[row], (coord[s:e], value[s:e]), active, weakest)
            weakest = self._weakest()

    def _maxima(self, order, nodes, start, coord, value) -> list:
        """Per document node its coordinates and their maxima."""
        out: list = [None] * len(nodes)
        for at in range(len(nodes) - 1, -1, -1):  # children come after their parent
            a, b, below = nodes[at]
            parts = ([out[c] for c in below] if below else
                     [(coord[start[r]:start[r + 1]], value[start[r]:start[r + 1]]) for r in order[a:b]])
            c, v = (np.concatenate(x) for x in zip(*parts))
            np.maximum.at(self.dense, c, v)
            c = np.unique(c)
            out[at] = (c, self.dense[c])
            self.dense[c] = 0
        return out

    def _left(self, vector: tuple, nodes: np.ndarray, weakest: np.ndarray) -> np.ndarray:
        """The item nodes whose bound with ``vector`` reaches their weakest."""
        c, v = vector
        if not len(c):
            return nodes[:0]
        self.dense[c] = v
        self.pairs += len(nodes)
        kept = nodes[self.items.bounds(nodes, self.dense) >= weakest[nodes]]
        self.dense[c] = 0
        return kept

    def _score(self, doc: tuple, vector: tuple, nodes: np.ndarray, weakest: np.ndarray) -> None:
        """One document against the items below ``nodes``."""
        c, v = vector
        if not len(c):
            return
        self.dense[c] = v
        while len(nodes):
            self.pairs += len(nodes)
            bound = self.items.bounds(nodes, self.dense)
            fine = bound >= weakest[nodes]
            single = nodes < self.items.n
            for place, score in zip(nodes[fine & single].tolist(), bound[fine & single].tolist()):
                self.scored += 1
                if score >= self.least[place]:
                    self._take(place, score, doc)
            nodes = nodes[fine & ~single]
            if len(nodes):
                nodes = np.concatenate([self.items.children[i] for i in nodes])
        self.dense[c] = 0

    def results(self):
        """(item, score, document id) of all kept pairs, best first."""
        for place, heap in enumerate(self.best):
            for score, doc in sorted(heap, reverse=True):
                yield int(self.items.order[place]), score, doc
