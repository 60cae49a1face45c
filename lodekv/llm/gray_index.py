"""Gray-order hierarchical index over 64-bit fingerprints, vectorised over many buckets at once.

Fingerprints are sorted by Gray rank, so that neighbours share bits. Every ``FANOUT`` neighbours form a node,
every ``FANOUT`` nodes a node above. A node holds the bits on which all fingerprints below agree (mask and
pattern); what its parent already holds is factored out. A search walks down with the differences
accumulated so far and drops a whole group as soon as they exceed the threshold.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the sequence of 64-bit Gray codes."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """``bucket``: ascending bucket number of each fingerprint; only fingerprints of one bucket are compared."""

    def __init__(self, fingerprints: np.ndarray, bucket: np.ndarray):
        self.order = np.lexsort((gray_rank(fingerprints), bucket))
        self.leaves = fingerprints[self.order]
        self.bucket = bucket[self.order]
        #: From the leaves up: (first child, end of children, mask, pattern, bucket). A node never spans buckets.
        self.levels = [(None, None, np.full(len(self.leaves), _ALL), self.leaves, self.bucket)]
        while True:
            _, _, mask, pattern, owner = self.levels[-1]
            first = _starts(owner)
            sizes = np.diff(np.append(first, len(owner)))
            if sizes.max(initial=0) <= FANOUT:
                break
            place = np.arange(len(owner)) - np.repeat(first, sizes)
            heads = np.flatnonzero(place % FANOUT == 0)
            both, some = np.bitwise_and.reduceat(pattern, heads), np.bitwise_or.reduceat(pattern, heads)
            agreed = np.bitwise_and.reduceat(mask, heads) & ~(some ^ both)
            self.levels.append((heads, np.append(heads[1:], len(owner)), agreed, both & agreed, owner[heads]))

    def pairs(self, most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(positions i, positions j of the input, comparisons) with i before j in Gray order, at most ``most`` bits apart."""
        owner = self.levels[-1][4]
        n = len(self.leaves)
        first = _starts(owner)
        of_bucket = np.searchsorted(owner[first], self.bucket) if n else np.zeros(0, np.int64)
        begin, end = first[of_bucket], np.append(first[1:], len(owner))[of_bucket]
        query, node = _expand(np.arange(n), begin, end)
        done, work = np.zeros(len(query), np.int64), len(query)
        above = np.zeros(len(query), np.uint64)
        for depth in range(len(self.levels) - 1, -1, -1):
            heads, ends, mask, pattern, _ = self.levels[depth]
            own = mask[node] & ~above
            done = done + np.bitwise_count((self.leaves[query] ^ pattern[node]) & own)
            keep = done <= most
            keep &= (self._last(depth)[node] > query) if depth else (node > query)
            query, node, done = query[keep], node[keep], done[keep]
            if depth == 0:
                break
            own = mask[node]
            parent, node = _expand(np.arange(len(node)), heads[node], ends[node])
            query, done, above = query[parent], done[parent], own[parent]
            work += len(node)
        return self.order[query], self.order[node], work

    def _last(self, depth: int) -> np.ndarray:
        """The last leaf below each node of a level."""
        last = np.arange(len(self.leaves))
        for level in range(1, depth + 1):
            last = last[self.levels[level][1] - 1]
        return last


def _starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)


def _expand(rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with every number from its begin to before its end."""
    counts = end - begin
    out = np.repeat(rows, counts)
    total = int(counts.sum())
    within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return out, np.repeat(begin, counts) + within


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each number's connected component, by label propagation with shortcuts."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def trees(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect each component: member m to member (m - 1) // 2, so that no member has over three."""
    order = np.argsort(label, kind="stable")
    first = _starts(label[order])
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    child = np.flatnonzero(place > 0)
    parent = child - place[child] + (place[child] - 1) // 2
    return order[child], order[parent]
