"""Set join on a prefix tree of globally ordered sets.

Sets are sequences under one global order, the most frequent element first, so
similar sets share long prefixes and the tree stores them once. A probe walks
the tree level by level: the overlap of a prefix with the probe is counted
once for all sets below it, and a subtree is cut as soon as the overlap so far
plus what can still come (the smaller of the probe's and the subtree's
remaining lengths) is below the least overlap any of its sets needs. In a tree
of many sets, bitmaps of the most frequent elements say first which sets the
walk can reach at all: elements in common among these, plus what the others can
add, bound the overlap. Where few sets are left, only their paths are walked.

Two sets of sizes a and b link when 100 * overlap >= 75 * union, that is, when
their overlap is at least ceil(3 (a + b) / 7).
"""

from __future__ import annotations

import numpy as np

# Sets from which a tree has bitmaps, and the most elements in them.
HEAD_SETS, HEAD_BITS = 32, 2048


def needed(a, b):
    """Least overlap of linked sets of sizes a and b."""
    return -(-3 * (a + b) // 7)


class Tree:
    """Prefix tree of sequences of dense ids that ascend within a sequence."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray, ids: list[int]):
        """``sizes``: the full set sizes, which may exceed the sequences'
        lengths by elements that no other set has. ``ids`` names the sets."""
        order = sorted(range(len(ids)), key=lambda i: sequences[ids[i]].astype(">u4").tobytes())
        self.sets = np.array([ids[i] for i in order], np.int64)
        seqs = [sequences[i] for i in self.sets]
        lens = [len(s) for s in seqs]
        # Nodes: (parent, from depth, to depth, a sequence that has the edge).
        parent, low, high, source, level = [-1], [0], [0], [0], [0]
        leaf = np.empty(len(seqs), np.int64)
        path = [0]
        for k, seq in enumerate(seqs):
            common = 0
            if k:
                m = min(lens[k], lens[k - 1])
                differ = np.flatnonzero(seq[:m] != seqs[k - 1][:m])
                common = int(differ[0]) if len(differ) else m
            last = None
            while high[path[-1]] > common:
                last = path.pop()
            if high[path[-1]] < common:  # split the edge that leads to ``last``
                top = path[-1]
                parent.append(top)
                low.append(high[top])
                high.append(common)
                source.append(source[last])
                level.append(0)
                split = len(parent) - 1
                parent[last], low[last] = split, common
                path.append(split)
            if lens[k] > common:
                parent.append(path[-1])
                low.append(common)
                high.append(lens[k])
                source.append(k)
                level.append(0)
                path.append(len(parent) - 1)
            leaf[k] = path[-1]
        n = len(parent)
        level = np.zeros(n, np.int64)
        children: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            children[parent[v]].append(v)
        rows, at = [[0]], 0
        while rows[at]:
            rows.append([c for v in rows[at] for c in children[v]])
            at += 1
        rows.pop()
        place = np.empty(n, np.int64)
        flat = [v for row in rows for v in row]
        place[flat] = np.arange(n)
        self.levels, start = [], 0
        for row in rows:
            edges = [seqs[source[v]][low[v]:high[v]] for v in row]
            width = np.array([len(e) for e in edges], np.int64)
            tokens = np.concatenate(edges) if width.any() else np.empty(0, np.int64)
            up = place[[max(parent[v], 0) for v in row]]
            self.levels.append((start, len(row), up, tokens, width))
            start += len(row)
        self.leaf = place[leaf]
        self.depth = np.array(high, np.int64)[flat]
        self.final = np.array([int(seqs[source[v]][high[v] - 1]) if high[v] else -1 for v in flat])
        # Least full size and most remaining elements below each node.
        self.least = np.full(n, np.iinfo(np.int64).max)
        deepest = np.zeros(n, np.int64)
        np.minimum.at(self.least, self.leaf, sizes[self.sets])
        np.maximum.at(deepest, self.leaf, np.array(lens, np.int64))
        for first, count, up, _, _ in reversed(self.levels[1:]):
            here = slice(first, first + count)
            np.minimum.at(self.least, up, self.least[here])
            np.maximum.at(deepest, up, deepest[here])
        self.rest = deepest - self.depth
        self.sizes = sizes[self.sets]
        self.heads = None
        if len(seqs) >= HEAD_SETS:
            flat, owner = np.concatenate(seqs), np.repeat(np.arange(len(seqs)), lens)
            bits = min(HEAD_BITS, 64 * -(-4 * len(flat) // (64 * len(seqs)) or -1))
            held = np.zeros((len(seqs), bits), bool)
            held[owner[flat < bits], flat[flat < bits]] = True
            self.heads = np.packbits(held, axis=1).view(np.uint64)
            self.others = np.bincount(owner[flat >= bits], minlength=len(seqs))
            self.flat, self.ends = flat, np.concatenate([[0], np.cumsum(lens)])

    def _possible(self, has: np.ndarray, length: int, size: int) -> np.ndarray:
        """Sets (by their order in the tree) that the bitmaps leave possible."""
        head = np.zeros(64 * self.heads.shape[1], bool)
        part = has[:len(head)]
        head[:len(part)] = part
        common = np.bitwise_count(self.heads & np.packbits(head).view(np.uint64)).sum(axis=1, dtype=np.int64)
        most = common + np.minimum(self.others, length - int(head.sum()))
        return np.flatnonzero(most >= needed(size, self.sizes))

    def _along(self, paths: np.ndarray, has: np.ndarray, size: int) -> np.ndarray:
        """Of a few sets, those linked with a probe, counted along their paths."""
        lens = self.ends[paths + 1] - self.ends[paths]
        start = np.cumsum(lens) - lens
        at = np.repeat(self.ends[paths] - start, lens) + np.arange(int(lens.sum()))
        total = np.concatenate([[0], np.cumsum(has[self.flat[at]])])
        return self.sets[paths[total[start + lens] - total[start] >= needed(size, self.sizes[paths])]]

    def linked(self, has: np.ndarray, before: np.ndarray, length: int, size: int) -> np.ndarray:
        """Sets linked with a probe: ``has`` marks its elements, ``before[t]``
        counts those up to t, ``length`` all of them; ``size`` is its full size."""
        if self.heads is not None:
            paths = self._possible(has, length, size)
            if 8 * len(paths) <= len(self.sets):
                return self._along(paths, has, size)
        overlap = np.zeros(len(self.depth), np.int64)
        alive = np.zeros(len(self.depth), bool)
        alive[0] = True
        need = needed(size, self.least)
        for first, count, up, tokens, width in self.levels[1:]:
            open_ = alive[up]
            if not open_.any():
                break
            here = slice(first, first + count)
            if not open_.all():
                tokens = tokens[np.repeat(open_, width)]
                width = np.where(open_, width, 0)
            total = np.concatenate([[0], np.cumsum(has[tokens])])
            ends = np.cumsum(width)
            overlap[here] = overlap[up] + total[ends] - total[ends - width]
            left = np.minimum(length - before[self.final[here]], self.rest[here])
            alive[here] = open_ & (overlap[here] + left >= need[here])
        found = alive[self.leaf] & (overlap[self.leaf] >= needed(size, self.sizes))
        return self.sets[found]


def densely(tokens: list[np.ndarray], freqs: list[np.ndarray]) -> list[np.ndarray]:
    """Sequences of dense ids, numbered by the global order (most frequent
    first, then by hash) and ascending."""
    flat, freq = np.concatenate(tokens), np.concatenate(freqs).astype(np.int64)
    values, index, inverse = np.unique(flat, return_index=True, return_inverse=True)
    order = np.lexsort((values, -freq[index]))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    cuts = np.cumsum([len(t) for t in tokens])[:-1]
    return [np.sort(s) for s in np.split(rank[inverse], cuts)]


def components(tokens: list[np.ndarray], freqs: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Component number of every set (its least member's index). Each set is
    probed at most once, and only sets not yet reached are left in the tree."""
    n = len(tokens)
    label = np.full(n, -1, np.int64)
    seqs = densely(tokens, freqs)
    width = max((int(s[-1]) + 1 for s in seqs if len(s)), default=0)
    open_, tree, held = np.ones(n, bool), None, 0
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root], queue = root, [root]
        open_[root] = False
        while queue and open_.any():
            if tree is None or open_.sum() * 2 < held:
                left = np.flatnonzero(open_).tolist()
                tree, held = Tree(seqs, sizes, left), len(left)
            probe = queue.pop()
            has = np.zeros(width + 1, bool)
            has[seqs[probe]] = True
            hits = tree.linked(has, np.cumsum(has), len(seqs[probe]), int(sizes[probe]))
            hits = hits[open_[hits]]
            label[hits], open_[hits] = root, False
            queue.extend(hits.tolist())
    return label


def links(probes, stored) -> list[tuple[int, int]]:
    """Every (probe, stored) pair that links; each side is (tokens, freqs, sizes)."""
    seqs = densely(probes[0] + stored[0], probes[1] + stored[1])
    a, sizes = len(probes[0]), np.concatenate([probes[2], stored[2]])
    tree = Tree(seqs, sizes, list(range(a, len(seqs))))
    width = max((int(s[-1]) + 1 for s in seqs if len(s)), default=0)
    out = []
    for i in range(a):
        has = np.zeros(width + 1, bool)
        has[seqs[i]] = True
        out += [(i, int(j) - a) for j in tree.linked(has, np.cumsum(has), len(seqs[i]), int(sizes[i]))]
    return out
