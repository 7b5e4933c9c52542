"""Ids of a public word-level BPE, whole texts at a time.

The library's own encoder spends most of its time in merges of words it has seen before.
Here a text is split by the tokenizer's published pattern, distinct words are merged in
numpy by the published merge ranks. Texts outside the plain case (characters other than ASCII
and Latin-1 letters, special-token strings) and very long words go through the library itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from orrerium.llm.common import CHUNK_BYTES, LOWER, Rolling, text_chunks

#: Words of this many bytes and more go through the library.
LONG_WORD = 48
#: Distinct words remembered by a worker, in a table of 2**20 slots.
CACHE_WORDS = 500_000
_NONE = np.int32(2**31 - 1)

#: Fixed values of the tokenizer's pattern: byte classes, and what may follow an apostrophe in one token.
_BLANK, _LETTERS, _DIGIT, _OTHER = 0, 1, 2, 3
KIND = np.full(256, _OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
KIND[97:123] = KIND[128:] = _LETTERS
KIND[48:58] = _DIGIT
SHORT = np.frombuffer(b"stmd", np.uint8)
LONGER = np.array([a << 8 | b for a, b in (b"re", b"ve", b"ll")], np.int32)


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._index(keys, np.arange(len(pairs), dtype=np.int32), made)
        shown = self._byte_letters()
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[shown[b] + "</w>"] for b in range(256)], np.int32)
        self._forget()

    @staticmethod
    def _byte_letters() -> list[str]:
        """Byte-level alphabet: printable bytes show as themselves, the others as the letters from U+0100 on."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

    def _index(self, keys: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """An open-addressed table in arrays."""
        self.bits = 20
        size = 1 << self.bits
        self.slot_key, self.slot_rank, self.slot_made = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            free = self.slot_key[at[todo]] < 0
            now, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.slot_key[now], self.slot_rank[now], self.slot_made[now] = keys[put], rank[put], made[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of a and b (or _NONE), and what it makes."""
        keys = a.astype(np.int64) << 20 | b
        at = self._slot(keys)
        rank, made = np.full(len(keys), _NONE, np.int32), np.zeros(len(keys), np.int32)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.slot_key[at]
            hit = there == keys[open_]
            rank[open_[hit]], made[open_[hit]] = self.slot_rank[at[hit]], self.slot_made[at[hit]]
            go = ~hit & (there >= 0)
            if not go.any():
                break
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return rank, made

    def _merge(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of one byte length, a matrix of a row each: always a row's lowest rank, leftmost first."""
        n, width = sym.shape
        size = np.full(n, width)
        if width == 1:
            return sym, size
        rank, made = (x.reshape(n, width - 1) for x in self._find(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
        live = np.arange(n)
        cols = np.arange(width)
        while len(live):
            r = rank[live]
            j = r.argmin(1)
            best = r[np.arange(len(live)), j]
            live, j = live[best < _NONE], j[best < _NONE]
            if not len(live):
                break
            s, r, m = sym[live], rank[live], made[live]
            k = np.arange(len(live))
            s[k, j] = m[k, j]
            later = cols[None, :-1] > j[:, None]
            s[:, :-1] = np.where(later, s[:, 1:], s[:, :-1])
            if width > 2:
                later = cols[None, : width - 2] >= j[:, None]
                r[:, :-1] = np.where(later, r[:, 1:], r[:, :-1])
                m[:, :-1] = np.where(later, m[:, 1:], m[:, :-1])
            r[:, -1] = _NONE
            size[live] -= 1
            for at, ok in ((j - 1, j > 0), (j, j + 1 < size[live])):
                x = np.flatnonzero(ok)
                r[x, at[x]], m[x, at[x]] = self._find(s[x, at[x]], s[x, at[x] + 1])
            sym[live], rank[live], made[live] = s, r, m
        return sym, size

    def _ids(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of distinct words."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        for width in np.unique(n):
            at = np.flatnonzero(n == width)
            if width >= LONG_WORD:
                for i in at:
                    out[i] = np.array(self.library.encode(raw[i].decode(), add_special_tokens=False).ids, np.int32)
                continue
            b = np.frombuffer(b"".join([raw[i] for i in at]), np.uint8).reshape(len(at), width)
            sym = self.inner[b]
            sym[:, -1] = self.final[b[:, -1]]
            sym, size = self._merge(sym)
            for k, (i, m) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
                out[i] = sym[k, :m]
        return out

    def _forget(self) -> None:
        self.key = np.zeros(1 << 20, np.uint64)
        self.entry = np.full(1 << 20, -1, np.int32)
        self.n_known, self.steps = 0, 1
        self.pool, self.pool_at, self.pool_n, self.used = np.zeros(1 << 20, np.int32), np.zeros(CACHE_WORDS, np.int64), np.zeros(CACHE_WORDS, np.int64), 0

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """Entry of each word hash, -1 for unknown ones."""
        at = (h >> np.uint64(44)).astype(np.int64)
        e = self.entry[at]
        bad = np.flatnonzero((e >= 0) & (self.key[at] != h))
        for _ in range(self.steps):
            if not len(bad):
                return e
            at[bad] = (at[bad] + 1) & 0xFFFFF
            e[bad] = self.entry[at[bad]]
            bad = bad[(e[bad] >= 0) & (self.key[at[bad]] != h[bad])]
        e[bad] = -1
        return e

    def _learn(self, h: np.ndarray, raw: list[bytes]) -> None:
        ids = self._ids(raw)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        mine = np.arange(self.n_known, self.n_known + len(h))
        self.pool[self.used : self.used + len(flat)] = flat
        self.pool_at[mine] = self.used + np.cumsum(n) - n
        self.pool_n[mine] = n
        self.used += len(flat)
        self.n_known += len(h)
        at, todo, steps = (h >> np.uint64(44)).astype(np.int64), np.arange(len(h)), 0
        while len(todo):
            free = todo[self.entry[at[todo]] < 0]
            now, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.key[now], self.entry[now] = h[put], mine[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & 0xFFFFF
            steps += 1
        self.steps = max(self.steps, steps)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids; null is an empty text."""
        for i, j, buf, off in text_chunks(texts, 2 * CHUNK_BYTES):
            flat, ends, odd = self._plain(buf, off)
            for k in range(j - i):
                if odd[k]:
                    text = buf[off[k] : off[k + 1]].tobytes().decode()
                    yield np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
                else:
                    yield flat[ends[k] : ends[k + 1]]

    def _plain(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, their bounds, rows that need the library)."""
        n = len(off) - 1
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.zeros(n, bool)
        b = LOWER[buf]
        kind = KIND[b]
        high = np.flatnonzero(b >= 128)
        bad = np.zeros(0, np.int64)
        if len(high):
            lead = high[b[high] == 0xC3]
            tail = lead + 1
            upper = tail[(b[tail] >= 0x80) & (b[tail] <= 0x9E)]
            b[upper] += 32
            fine = np.zeros(len(b), bool)
            ok = b[tail] != 0xB7
            fine[lead[ok]] = fine[tail[ok]] = True
            bad = high[~fine[high]]
        angle = np.flatnonzero((b[:-1] == 60) & (b[1:] == 124))
        odd = np.zeros(n, bool)
        odd[np.searchsorted(off, np.concatenate([bad, angle]), "right") - 1] = True
        edge = np.zeros(len(b) + 1, bool)
        edge[off] = True
        new = np.ones(len(b), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | edge[1:-1]
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(b))
        row = np.searchsorted(off, start, "right") - 1
        quote = np.flatnonzero((b[start[:-1]] == 39) & (end[:-1] - start[:-1] == 1) & (kind[start[1:]] == _LETTERS) & (row[1:] == row[:-1]))
        if len(quote):
            at, most = end[quote], end[quote + 1]
            one = b[at]
            two = np.where(at + 1 < most, b[np.minimum(at + 1, len(b) - 1)], 0)
            k = np.where(np.isin(one, SHORT), 1, np.where(np.isin(one.astype(np.int32) << 8 | two, LONGER), 2, 0))
            end[quote] += k
            start[quote + 1] += k
        keep = (kind[np.minimum(start, len(b) - 1)] != _BLANK) & (start < end) & ~odd[row]
        keep[quote + 1 if len(quote) else []] &= (start < end)[quote + 1] if len(quote) else True
        start, end, row = start[keep], end[keep], row[keep]
        h = Rolling(b).spans(start, end)
        e = self._lookup(h)
        new = np.flatnonzero(e < 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            if self.n_known + len(fresh) > CACHE_WORDS:
                self._forget()
                fresh, first = np.unique(h, return_index=True)
                new = np.arange(len(h))
            at = new[first]
            text = b.tobytes()
            self._learn(fresh, [text[s:t] for s, t in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            e = self._lookup(h)
        m = self.pool_n[e]
        upto = np.cumsum(m)
        flat = self.pool[np.repeat(self.pool_at[e] - upto + m, m) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.concatenate([[0], upto])[np.searchsorted(row, np.arange(n + 1), "left")]
        return flat, ends, odd


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The worker's encoder for the file, read once."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
