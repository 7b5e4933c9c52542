"""Hierarchical navigable small-world graphs in numpy, built and searched many vectors at a time."""

from __future__ import annotations

import numpy as np

#: Links of a node, and of a node as it enters; beam while building; a node in LEVEL_SHARE rises a level.
LINKS = 32
NEW_LINKS = 16
BUILD_BEAM = 48
LEVEL_SHARE = 16
#: Queries that move together.
TOGETHER = 512


class Graph:
    """A graph over rows of unit vectors. Nodes are stored by falling level, so a level is a prefix.

    `links[l]` holds the neighbours of level l (-1 for none); the top level has few nodes and is scanned.
    """

    def __init__(self, vectors: np.ndarray, order: np.ndarray, sizes: list[int], links: list[np.ndarray]):
        self.vectors, self.order, self.sizes, self.links = vectors, order, sizes, links

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 0) -> Graph:
        n = len(unit)
        order = np.random.default_rng(seed).permutation(n)
        sizes = [n]
        while sizes[-1] > 4 * LEVEL_SHARE:
            sizes.append(-(-sizes[-1] // LEVEL_SHARE))
        self = cls(np.ascontiguousarray(unit[order], np.float32), order, sizes, [])
        for level in range(len(sizes) - 1, -1, -1):
            self.links.insert(0, self._level(sizes[level]))
        return self

    def _level(self, size: int) -> np.ndarray:
        """Links among the first `size` nodes: nodes enter in growing batches, each linked to what a beam finds."""
        links = np.full((size, LINKS), -1, np.int32)
        first = min(size, 2 * NEW_LINKS)
        self._enter(links, np.arange(first), 0)
        at = first
        while at < size:
            end = min(size, at + max(NEW_LINKS, min(at // 2, TOGETHER)))
            self._enter(links, np.arange(at, end), at)
            at = end
        return links

    def _enter(self, links: np.ndarray, new: np.ndarray, known: int) -> None:
        v = self.vectors
        sims = v[new] @ v[new].T
        np.fill_diagonal(sims, -np.inf)
        near = np.argsort(-sims, 1)[:, : min(NEW_LINKS, len(new) - 1)]
        cand, sim = new[near], np.take_along_axis(sims, near, 1)
        if known:
            found, s = self._beam(links, v[new], self._seeds(v[new], known), min(BUILD_BEAM, known))
            cand, sim = np.hstack([found, cand]), np.hstack([s, sim])
        chosen = self._diverse(cand, sim, NEW_LINKS)
        links[new, : chosen.shape[1]] = chosen
        # The way back; nodes that get too many links choose again.
        a, b = np.repeat(new, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        nodes, start, count = np.unique(b, return_index=True, return_counts=True)
        width = int(count.max(initial=0))
        extra = np.full((len(nodes), width), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(b)) - np.repeat(start, count)] = a
        every = np.hstack([links[nodes], extra])
        every.sort(1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        room = (every >= 0).sum(1)
        easy = room <= LINKS
        every[easy] = -np.sort(-every[easy], 1)
        links[nodes[easy]] = every[easy][:, :LINKS]
        for k in range(0, int((~easy).sum()), TOGETHER):
            at = np.flatnonzero(~easy)[k : k + TOGETHER]
            s = np.where(every[at] >= 0, np.einsum("acd,ad->ac", v[every[at]], v[nodes[at]]), -np.inf)
            links[nodes[at]] = self._diverse(every[at], s, LINKS)

    def _diverse(self, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, those nearer to the row's node than to one chosen before, then the nearest others."""
        order = np.argsort(-sim, 1)[:, : 2 * BUILD_BEAM]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        rows, c = cand.shape
        v = self.vectors[cand]
        between = np.einsum("acd,aed->ace", v, v)
        chosen, n = np.zeros((rows, c), bool), np.zeros(rows, int)
        closest = np.full((rows, c), -np.inf)
        for k in range(c):
            ok = (n < most) & np.isfinite(sim[:, k]) & (sim[:, k] > closest[:, k])
            chosen[:, k] = ok
            n += ok
            closest = np.where(ok[:, None], np.maximum(closest, between[:, k]), closest)
        rank = np.where(chosen, 0, 1) + ~np.isfinite(sim) * 2
        first = np.argsort(rank, 1, kind="stable")[:, :most]
        out = np.take_along_axis(cand, first, 1)
        return np.where(np.isfinite(np.take_along_axis(sim, first, 1)), out, -1)

    def _seeds(self, q: np.ndarray, known: int | None = None) -> np.ndarray:
        """The nearest of the top level's nodes (of those `known` so far), then the walk down to level 1."""
        top = min(self.sizes[-1], known or self.sizes[-1])
        seed = (q @ self.vectors[:top].T).argmax(1)[:, None]
        for level in range(len(self.sizes) - 2, 0, -1) if known is None else ():
            seed = self._beam(self.links[level], q, seed, 1)[0]
        return seed

    def _beam(self, links: np.ndarray, q: np.ndarray, seed: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest nodes that a best-first walk finds, nearest first (-1 beyond what it reaches)."""
        m = len(q)
        ids, sims = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf, np.float32)
        done = np.zeros((m, beam), bool)
        seen = np.zeros((m, len(links)), bool)
        ids[:, 0] = seed[:, 0]
        sims[:, 0] = np.einsum("ad,ad->a", self.vectors[seed[:, 0]], q)
        seen[np.arange(m), seed[:, 0]] = True
        live = np.arange(m)
        while len(live):
            s = np.where(done[live], -np.inf, sims[live])
            at = s.argmax(1)
            go = np.isfinite(s[np.arange(len(live)), at])
            live, at = live[go], at[go]
            if not len(live):
                break
            done[live, at] = True
            near = links[ids[live, at]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(near >= 0, near, ids[live, at][:, None])] = True
            got = np.where(fresh, np.einsum("acd,ad->ac", self.vectors[near], q[live]), -np.inf)
            all_s = np.hstack([sims[live], got])
            pick = np.argpartition(-all_s, beam - 1, 1)[:, :beam]
            sims[live] = np.take_along_axis(all_s, pick, 1)
            ids[live] = np.take_along_axis(np.hstack([ids[live], near]), pick, 1)
            done[live] = np.take_along_axis(np.hstack([done[live], np.zeros(near.shape, bool)]), pick, 1)
        order = np.argsort(-sims, 1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(np.isfinite(sims), ids, -1), sims

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of similarity >= least; a beam that is full of them is doubled. A beam of all nodes is a scan."""
        n = len(self.vectors)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(0, len(q), TOGETHER):
            who = np.arange(k, min(k + TOGETHER, len(q)))
            width = beam
            while len(who):
                if width >= n:
                    a, b = np.nonzero(q[who] @ self.vectors.T >= least)
                    out.append((who[a], b))
                    break
                ids, sims = self._beam(self.links[0], q[who], self._seeds(q[who]), width)
                full = (ids[:, -1] >= 0) & (sims[:, -1] >= least)
                a, b = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
                out.append((who[a], ids[a, b]))
                who, width = who[full], width * 2
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))
        return a, self.order[b]

    def dump(self) -> bytes:
        return b"".join([np.array([len(self.vectors), self.vectors.shape[1], len(self.sizes), *self.sizes], np.int64).tobytes(), self.order.astype(np.int64).tobytes(), self.vectors.tobytes(), *[x.tobytes() for x in self.links]])

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        n, d, levels = np.frombuffer(raw, np.int64, 3).tolist()
        sizes = np.frombuffer(raw, np.int64, levels, 24).tolist()
        at = 24 + 8 * levels
        order = np.frombuffer(raw, np.int64, n, at)
        at += 8 * n
        vectors = np.frombuffer(raw, np.float32, n * d, at).reshape(n, d)
        at += 4 * n * d
        links = []
        for s in sizes:
            links.append(np.frombuffer(raw, np.int32, s * LINKS, at).reshape(s, LINKS))
            at += 4 * s * LINKS
        return cls(vectors, order, sizes, links)
