"""Burrows-Wheeler transforms of string collections and their merge by interleave refinement."""

from __future__ import annotations

import numpy as np


class Shard:
    """The transform of a collection: symbols before the suffixes in sorted order, and where each suffix's extension
    to the left stands in that order. Symbols are at least 1; each string is closed by a 0 and read as a cycle."""

    def __init__(self, bwt: np.ndarray, back: np.ndarray, at: np.ndarray):
        self.bwt, self.back, self.at = bwt, back, at

    @classmethod
    def build(cls, symbols: np.ndarray, lengths: np.ndarray, depth: int) -> Shard:
        """Of concatenated strings; suffixes are in order of their first `depth` symbols at least."""
        n, k = len(symbols), len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n + k, np.int64)
        inner = np.ones(n + k, bool)
        inner[ends] = False
        text[inner] = symbols
        after = np.arange(1, n + k + 1)
        after[ends] = ends - lengths
        before = np.empty_like(after)
        before[after] = np.arange(n + k)
        rank = np.unique(text, return_inverse=True)[1]
        step, jump = 1, after
        while step < depth:
            rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[jump], return_inverse=True)[1]
            jump, step = jump[jump], 2 * step
        order = np.argsort(rank, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(n + k)
        return cls(text[before[order]], place[before[order]], order)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the shards' suffixes by their first `depth` symbols: (row in the shards' concatenation, common prefix
    with the row before, `depth` standing for that or more).

    Each round sorts the interleave, stably, by the symbol before each suffix, and takes every suffix's extension:
    after round h it is in order of h symbols. No suffix is compared with another.
    """
    base = np.cumsum([0] + [len(s.bwt) for s in shards])
    bwt = np.concatenate([s.bwt for s in shards])
    if bwt.max(initial=0) < 1 << 16:
        bwt = bwt.astype(np.uint16)
    small = np.int32 if base[-1] < 2**31 else np.int64
    back = np.concatenate([s.back.astype(small) + small(b) for s, b in zip(shards, base[:-1], strict=True)])
    order = np.arange(base[-1], dtype=small)
    block = np.zeros(len(order), small)
    common = np.full(len(order), depth, np.int32)
    fresh = np.zeros(len(order), bool)
    for h in range(1, depth + 1):
        c = bwt[order]
        move = np.argsort(c, kind="stable")
        c, b = c[move], block[move]
        new = np.zeros(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        order = back[order[move]]
        block = np.cumsum(new, dtype=small)
        common[new & ~fresh] = h - 1
        fresh |= new
    common[:1] = 0
    return order, common
