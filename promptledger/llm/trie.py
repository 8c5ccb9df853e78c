"""Hamming self-join of sorted 64-bit fingerprints over their binary tries, vectorised.

A trie node is a run of a sorted array that shares a prefix. Pairs of nodes of equal depth go down together: a pair's
children are the pairs of its nodes' halves by the next bit, halves of unlike bits cost one more differing bit, and a
pair over the budget is pruned. Pairs of small nodes end the descent and are compared leaf by leaf. All tries of a
partition descend at once, level by level, in numpy arrays; ``PAIRS`` bounds how many node pairs are open.
"""

from __future__ import annotations

import numpy as np

#: Node pairs open at once; more wait on a stack.
PAIRS = 1 << 18

#: A pair of nodes with no more leaf pairs than this is compared directly.
LEAVES = 16


class Links:
    """Union-find over positions of one sorted array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        r = up[x]
        while True:
            s = up[r]
            if (s == r).all():
                return r
            r = s

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite in bulk: hook the larger root of each pair to the smallest it meets, until no pair is apart."""
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.up, hi, lo)


def _bounds(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First position in each [lo, hi) whose key has ``bit`` set; keys share all higher bits within a run."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = open_ & ((keys[np.minimum(mid, len(keys) - 1)] >> bit) & np.uint64(1)).astype(bool)
        hi = np.where(one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def self_join(keys: np.ndarray, starts: np.ndarray, top: int, budget: int, links: Links | None = None) -> Links:
    """Unite all pairs of positions within the same run that differ in ``budget`` bits or fewer.

    keys: uint64, sorted within each run; starts: where runs begin, with the end appended. ``top``: bits below which
    keys of a run may differ (the trie's height).
    """
    links = links or Links(len(keys))
    lo, hi = starts[:-1].astype(np.int64), starts[1:].astype(np.int64)
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(lo[i:i + PAIRS], hi[i:i + PAIRS], lo[i:i + PAIRS], hi[i:i + PAIRS], np.zeros(len(lo[i:i + PAIRS]), np.int8), top) for i in range(0, len(lo), PAIRS)]
    while stack:
        al, ah, bl, bh, err, depth = stack.pop()
        if not len(al):
            continue
        same = al == bl
        # a subtree pair whose remaining bits fit the budget is linked whole
        sure = (err + depth <= budget)
        if sure.any():
            for u, v in ((al, ah), (bl, bh)):
                n = (v - u)[sure]
                first = np.repeat(u[sure], n)
                links.join(first, first + _offsets(n))
            links.join(al[sure], bl[sure])
            keep = ~sure
            al, ah, bl, bh, err, same = al[keep], ah[keep], bl[keep], bh[keep], err[keep], same[keep]
            if not len(al):
                continue
        size = (ah - al) * (bh - bl)
        small = size <= LEAVES
        if small.any():
            _compare(keys, al[small], ah[small], bl[small], bh[small], budget, links)
            keep = ~small
            al, ah, bl, bh, err, same = al[keep], ah[keep], bl[keep], bh[keep], err[keep], same[keep]
            if not len(al):
                continue
        depth -= 1
        bit = np.uint64(depth)
        am = _bounds(keys, al, ah, bit)
        bm = np.where(same, am, 0)
        other = ~same
        if other.any():
            bm[other] = _bounds(keys, bl[other], bh[other], bit)
        e1 = err + np.int8(1)
        parts = (
            (al, am, bl, bm, err, np.ones(len(al), bool)), (am, ah, bm, bh, err, np.ones(len(al), bool)),
            (al, am, bm, bh, e1, np.ones(len(al), bool)), (am, ah, bl, bm, e1, other),
        )
        cat = [[], [], [], [], []]
        for p in parts:
            ok = p[5] & (p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= budget) & ~((p[0] == p[2]) & (p[1] - p[0] < 2))
            for c, x in zip(cat, p, strict=False):
                c.append(x[ok])
        nxt = [np.concatenate(c) for c in cat]
        for i in range(0, len(nxt[0]), PAIRS):
            stack.append((*(x[i:i + PAIRS] for x in nxt), depth))
    return links


def _offsets(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def _compare(keys, al, ah, bl, bh, budget, links) -> None:
    na, nb = ah - al, bh - bl
    n = na * nb
    k = _offsets(n)
    width = np.repeat(nb, n)
    a, b = np.repeat(al, n) + k // width, np.repeat(bl, n) + k % width
    near = (a < b) | (np.repeat(al, n) != np.repeat(bl, n))
    a, b = a[near], b[near]
    near = np.bitwise_count(keys[a] ^ keys[b]) <= budget
    links.join(a[near], b[near])
