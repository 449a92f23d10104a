"""Dual-tree traversal of two point sets, vectorised level by level with numpy.

A tree is implicit: the points are sorted along a Z-order curve and level ``l``
cuts the order into ``2**l`` even runs, each with its bounding box. A frontier
of node pairs descends both trees together. A pair whose boxes are further
apart than the radius is discarded, a pair whose boxes lie wholly within it is
accepted without looking at points, and the rest is split; only leaf pairs
that stay uncertain compare points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from sylvaq.functions.graph import components

LEAF = 8
CHUNK = 1 << 19


def _z_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    def bits(v: np.ndarray) -> np.ndarray:
        lo, hi = v.min(), v.max()
        q = ((v - lo) * (65535.0 / (hi - lo)) if hi > lo else np.zeros(len(v))).astype(np.uint64)
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            q = (q | (q << np.uint64(shift))) & np.uint64(mask)
        return q

    return np.argsort(bits(x) | (bits(y) << np.uint64(1)), kind="stable")


class Tree:
    """Points in Z-order with the bounding boxes of every level."""

    def __init__(self, x: np.ndarray, y: np.ndarray, tag: np.ndarray):
        o = _z_order(x, y)
        self.x, self.y, self.tag = x[o], y[o], tag[o]
        n = len(o)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
        while (1 << self.depth) > n:
            self.depth -= 1
        self.starts, self.boxes = [], []
        for level in range(self.depth + 1):
            k = np.arange((1 << level) + 1, dtype=np.int64)
            s = k * n >> level
            self.starts.append(s)
            self.boxes.append(tuple(f.reduceat(v, s[:-1]) for f, v in ((np.minimum, self.x), (np.maximum, self.x), (np.minimum, self.y), (np.maximum, self.y))))


def _split(i: np.ndarray, j: np.ndarray, a: bool, b: bool, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Children pairs of node pairs; of a tree with itself each unordered pair once."""
    ii = [2 * i, 2 * i + 1] if a else [i]
    jj = [2 * j, 2 * j + 1] if b else [j]
    pairs = [(p, q) for p in ii for q in jj]
    i2, j2 = np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])
    if same:
        keep = i2 <= j2
        i2, j2 = i2[keep], j2[keep]
    return i2, j2


def near_ranges(a: Tree, b: Tree, radius: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Node pairs as ranges (a_from, a_to, b_from, b_to, certain) that cover every near point pair."""
    r2 = radius * radius
    la = lb = 0
    i = j = np.zeros(1, np.int64)
    while len(i):
        ax0, ax1, ay0, ay1 = (v[i] for v in a.boxes[la])
        bx0, bx1, by0, by1 = (v[j] for v in b.boxes[lb])
        zero = np.zeros(len(i))
        near_x = np.maximum(zero, np.maximum(bx0 - ax1, ax0 - bx1))
        near_y = np.maximum(zero, np.maximum(by0 - ay1, ay0 - by1))
        far_x = np.maximum(bx1 - ax0, ax1 - bx0)
        far_y = np.maximum(by1 - ay0, ay1 - by0)
        possible = near_x * near_x + near_y * near_y <= r2
        certain = far_x * far_x + far_y * far_y <= r2
        at_leaf = la == a.depth and lb == b.depth
        for take, sure in ((certain, True), (possible & ~certain, False)) if at_leaf else ((certain, True),):
            if take.any():
                yield a.starts[la][i[take]], a.starts[la][i[take] + 1], b.starts[lb][j[take]], b.starts[lb][j[take] + 1], sure
        if at_leaf:
            return
        go = possible & ~certain
        down_a, down_b = la < a.depth, lb < b.depth
        i, j = _split(i[go], j[go], down_a, down_b, same)
        la, lb = la + down_a, lb + down_b


def _expand(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (range number, i, j) of the ranges' products, in bounded chunks."""
    # long a-ranges are cut so that one product row block never exceeds a chunk
    wide = np.maximum(1, CHUNK // np.maximum(1, b1 - b0))
    cuts = -(-(a1 - a0) // wide)
    k = np.repeat(np.arange(len(a0)), cuts)
    step = np.arange(len(k)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    s0 = a0[k] + step * wide[k]
    s1 = np.minimum(s0 + wide[k], a1[k])
    size = (s1 - s0) * (b1 - b0)[k]
    total = np.cumsum(size)
    begin = 0
    while begin < len(k):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + CHUNK, side="right")))
        part = slice(begin, end)
        sz, kk = size[part], k[part]
        flat = np.arange(sz.sum()) - np.repeat(np.cumsum(sz) - sz, sz)
        w = np.repeat((b1 - b0)[kk], sz)
        yield np.repeat(kk, sz), np.repeat(s0[part], sz) + flat // w, np.repeat(b0[kk], sz) + flat % w
        begin = end


def near_pairs(a: Tree, b: Tree, radius: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of positions (i in a, j in b) at most ``radius`` apart; with ``same``, i < j."""
    r2 = radius * radius
    for a0, a1, b0, b1, sure in near_ranges(a, b, radius, same):
        for _, i, j in _expand(a0, a1, b0, b1):
            keep = i < j if same else np.ones(len(i), bool)
            if not sure:
                dx, dy = a.x[i] - b.x[j], a.y[i] - b.y[j]
                keep &= dx * dx + dy * dy <= r2
            if keep.any():
                yield i[keep], j[keep]


def near_counts(a: Tree, b: Tree, radius: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Near partners of every point of ``a`` in ``b`` and the reverse; with ``same``, of ``a``
    in ``a`` without itself. Certain node pairs are counted wholesale by difference arrays."""
    r2 = radius * radius
    ca, cb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    da, db = np.zeros(len(a.x) + 1, np.int64), np.zeros(len(b.x) + 1, np.int64)
    for a0, a1, b0, b1, sure in near_ranges(a, b, radius, same):
        if sure:
            own = (a0 == b0) if same else np.zeros(len(a0), bool)
            for d, s, e, n in ((da, a0, a1, b1 - b0 - own), (db, b0, b1, np.where(own, 0, a1 - a0))):
                np.add.at(d, s, n)
                np.add.at(d, e, -n)
        else:
            for _, i, j in _expand(a0, a1, b0, b1):
                dx, dy = a.x[i] - b.x[j], a.y[i] - b.y[j]
                keep = dx * dx + dy * dy <= r2
                if same:
                    keep &= i < j
                ca += np.bincount(i[keep], minlength=len(ca))
                cb += np.bincount(j[keep], minlength=len(cb))
    ca, cb = ca + np.cumsum(da[:-1]), cb + np.cumsum(db[:-1])
    return (ca + cb, cb) if same else (ca, cb)


def near_links(a: Tree, b: Tree, radius: float, same: bool) -> np.ndarray:
    """Component (its first position) of every point in the graph of near pairs; the positions of ``b`` follow
    those of ``a`` unless ``same``. A certain node pair costs its points once, not their product, and an
    uncertain one whose points already hang together is not looked at."""
    r2, shift = radius * radius, 0 if same else len(a.x)
    n = shift + len(b.x)
    chain = np.zeros(n + 1, np.int64)  # covers position p where p and p + 1 belong together
    left, right, open_ = [], [], []
    for a0, a1, b0, b1, sure in near_ranges(a, b, radius, same):
        if sure:
            for s, e in ((a0, a1), (b0 + shift, b1 + shift)):
                np.add.at(chain, s, 1)
                np.add.at(chain, e - 1, -1)
            left.append(a0)
            right.append(b0 + shift)
        else:
            open_.append((a0, a1, b0, b1))
    row = np.flatnonzero(np.cumsum(chain[:-1]) > 0)
    root = components(n, np.concatenate([row, *left]), np.concatenate([row + 1, *right]))
    for ranges in open_:
        for s in range(0, len(ranges[0]), 4096):
            a0, a1, b0, b1 = (v[s : s + 4096] for v in ranges)
            breaks = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
            one = (breaks[a0] == breaks[a1 - 1]) & (breaks[b0 + shift] == breaks[b1 + shift - 1]) & (root[a0] == root[b0 + shift])
            for _, i, j in _expand(a0[~one], a1[~one], b0[~one], b1[~one]):
                dx, dy = a.x[i] - b.x[j], a.y[i] - b.y[j]
                near = (dx * dx + dy * dy <= r2) & (root[i] != root[j + shift])
                if near.any():
                    root = components(n, np.concatenate([np.arange(n), i[near]]), np.concatenate([root, j[near] + shift]))
    return root
