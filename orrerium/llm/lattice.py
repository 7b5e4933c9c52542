"""Subword lattices of many words at once: marginal likelihoods and expected piece counts.

A word is a space byte and its bytes. Every piece of the vocabulary that matches is an edge, so
the forward recursion sums over all segmentations; it runs in log space, words of one length side
by side.
"""

from __future__ import annotations

import numpy as np

from orrerium.llm.common import _BYTE, _R, mix

#: Numbers (words x positions x piece lengths) that are held at a time.
CELLS = 600_000
#: Zipf's law on the vocabulary's own order of scores: probability ~ 1 / (rank + this).
RANK_SHIFT = 50.0


class Pieces:
    """A vocabulary's pieces as byte strings, by hash, and starting log probabilities from its scores."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        score: dict[bytes, float] = {}
        worst = min(sp.get_score(i) for i in range(sp.get_piece_size()))
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                score.setdefault(bytes([int(piece[3:5], 16)]), worst)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = piece.replace("▁", " ").encode()
                score[raw] = max(score.get(raw, worst), sp.get_score(i))
        self.raw = sorted(score)
        self.longest = max(map(len, self.raw))
        rank = np.argsort(np.argsort([-score[r] for r in self.raw], kind="stable"), kind="stable")
        p = 1.0 / (rank + RANK_SHIFT)
        self.start = np.log(p / p.sum())
        keys = np.zeros(len(self.raw), np.uint64)
        for k, r in enumerate(self.raw):
            h = 0
            for b in r:
                h = (h * _R + int(_BYTE[b])) & 0xFFFFFFFFFFFFFFFF
            keys[k] = h
        self.bits = 18
        size = 1 << self.bits
        keys = mix(keys)
        self.key, self.id, self.probes = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0
        at, todo = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.id[at[todo]] < 0]
            now, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.key[now], self.id[now] = keys[put], put
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & (size - 1)
            self.probes += 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each (mixed) hash, -1 for none."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        e = self.id[at]
        bad = np.flatnonzero((e >= 0) & (self.key[at] != h))
        where = at[bad]
        for _ in range(self.probes):
            if not len(bad):
                return e
            where = (where + 1) & ((1 << self.bits) - 1)
            e[bad] = self.id[where]
            go = (e[bad] >= 0) & (self.key[where] != h[bad])
            bad, where = bad[go], where[go]
        e[bad] = -1
        return e


def _blocks(n: np.ndarray, longest: int):
    """Runs of words of one length, few enough for CELLS."""
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        size = int(n[order[at]])
        end = int(np.searchsorted(n[order], size, "right"))
        step = max(1, CELLS // ((size + 1) * min(size + 1, longest)))
        yield from ((size, order[k : min(k + step, end)]) for k in range(at, end, step))
        at = end


def marginals(pieces: Pieces, logp: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood of each word over all segmentations, expected counts of the pieces under `weight`).

    Without `weight` no counts are made. Words are the spans of buf; each is read with a space before it.
    """
    out = np.zeros(len(start))
    counts = np.zeros(len(pieces.raw))
    padded = np.append(logp, -np.inf)
    for size, who in _blocks(end - start, pieces.longest):
        m, width = len(who), size + 1
        k_most = min(width, pieces.longest)
        b = np.empty((m, width), np.uint8)
        b[:, 0] = 32
        b[:, 1:] = buf[start[who][:, None] + np.arange(size)]
        code = _BYTE[b]
        # ids[k - 1][:, j]: the piece of the k bytes that end before j + 1
        ids = np.full((k_most, m, width), -1, np.int32)
        h = np.zeros((m, width), np.uint64)
        for k in range(1, k_most + 1):
            # The hash of the k bytes ending at j: that of the k - 1 bytes ending at j - 1, times R, plus byte j.
            h[:, k - 1 :] = (h[:, k - 2 : -1] if k > 1 else 0) * np.uint64(_R) + code[:, k - 1 :] if k > 1 else code
            ids[k - 1, :, k - 1 :] = pieces.find(mix(h[:, k - 1 :].ravel())).reshape(m, -1)
        edge = padded[ids]
        alpha = np.full((m, width + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, width + 1):
            k = min(j, k_most)
            x = alpha[:, j - k : j] + edge[:k, :, j - 1][::-1].T
            top = x.max(1)
            safe = np.where(np.isfinite(top), top, 0)
            alpha[:, j] = safe + np.log(np.exp(x - safe[:, None]).sum(1)) if k > 1 else x[:, 0]
        out[who] = alpha[:, width]
        if weight is None:
            continue
        beta = np.full((m, width + 1), -np.inf)
        beta[:, width] = 0
        for j in range(width - 1, -1, -1):
            k = min(width - j, k_most)
            x = np.stack([edge[i, :, j + i] for i in range(k)], 1) + beta[:, j + 1 : j + k + 1]
            top = x.max(1)
            safe = np.where(np.isfinite(top), top, 0)
            beta[:, j] = safe + np.log(np.exp(x - safe[:, None]).sum(1)) if k > 1 else x[:, 0]
        w = np.log(weight[who]) - alpha[:, width]
        for k in range(1, k_most + 1):
            e = alpha[:, : width + 1 - k] + edge[k - 1, :, k - 1 :] + beta[:, k:] + w[:, None]
            got = ids[k - 1, :, k - 1 :]
            ok = got >= 0
            counts += np.bincount(got[ok], np.exp(e[ok]), minlength=len(counts))
    return out, counts
