"""Periodic runs of words: all maximal repetitions of each text, by Kolpakov and Kucherov's algorithm.

A suffix automaton gives the factorisation into longest earlier matches. A run that touches a border of factors is
found there by Main's algorithm; any other lies within one factor and is copied from where that factor stood before.
Only stretches covered by word sequences that their text repeats can hold runs, so the automaton is made of these.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orrerium.llm.common import NOT_SPACE, Rolling, mix, text_chunks, words

#: Words that a run has at least.
LEAST = 12
_RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Automaton:
    """Suffix automaton of a sequence of small integers, with the end of each state's first occurrence.

    Most states have one way on, which stands in arrays; the others' further ways are in dictionaries.
    """

    def __init__(self, x: list[int]):
        self.symbol, self.to, self.first = array("q", [-1]), array("q", [0]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        link, length = array("q", [-1]), array("q", [0])
        symbol, to, more, first, last = self.symbol, self.to, self.more, self.first, 0
        for i, c in enumerate(x):
            new = len(to)
            symbol.append(-1), to.append(0), link.append(0), length.append(i + 1), first.append(i)
            p, q = last, -1
            while p >= 0:
                if symbol[p] == c:
                    q = to[p]
                    break
                if symbol[p] < 0:
                    symbol[p], to[p] = c, new
                else:
                    ways = more.get(p)
                    if ways is None:
                        more[p] = {c: new}
                    elif c in ways:
                        q = ways[c]
                        break
                    else:
                        ways[c] = new
                p = link[p]
            if q >= 0 and length[p] + 1 < length[q]:
                twin = len(to)
                symbol.append(symbol[q]), to.append(to[q]), link.append(link[q]), length.append(length[p] + 1), first.append(first[q])
                if q in more:
                    more[twin] = dict(more[q])
                link[q] = link[new] = twin
                while p >= 0:
                    if symbol[p] == c:
                        if to[p] != q:
                            break
                        to[p] = twin
                    else:
                        ways = more.get(p)
                        if ways is None or ways.get(c) != q:
                            break
                        ways[c] = twin
                    p = link[p]
            elif q >= 0:
                link[new] = q
            last = new

    def factors(self, x: list[int]) -> Iterator[tuple[int, int, int]]:
        """(start, length, start of an earlier occurrence or -1): the longest match that begins earlier, or one new symbol."""
        symbol, to, more, first, n, i = self.symbol, self.to, self.more, self.first, len(x), 0
        while i < n:
            state, j = 0, i
            while j < n:
                c = x[j]
                step = to[state] if symbol[state] == c else more[state].get(c, -1) if state in more else -1
                if step < 0 or first[step] >= j:
                    break
                state, j = step, j + 1
            yield (i, j - i, first[state] - (j - i) + 1) if j > i else (i, 1, -1)
            i = max(j, i + 1)


def common_prefixes(x: list[int]) -> np.ndarray:
    """Of x and each of its suffixes (the Z function); the first is 0."""
    n = len(x)
    z = [0] * n
    lo = hi = 0
    for i in range(1, n):
        k = 0
        if i < hi:
            k = z[i - lo]
            if k < hi - i:
                z[i] = k
                continue
            k = hi - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return np.array(z, np.int64)


def at_border(x: list[int], b: int, before: int, after: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs with start <= b <= end, seen `before` and `after` symbols around b; what goes on beyond these isn't told."""
    t, v = x[b - before : b], x[b : b + after]
    w, back = t + v, t[::-1]
    found = []
    if after:  # runs that hold x[b : b + q]
        q = np.arange(1, after + 1)
        right = np.append(common_prefixes(v)[1:], 0)
        left = common_prefixes([*back, -1, *w[::-1]])[before + 1 + after - q]
        ok = np.flatnonzero((left + right >= q) & (left + right + q >= least))
        found += zip((b - left[ok]).tolist(), (b + q + right)[ok].tolist(), q[ok].tolist(), strict=True)
    if before:  # runs that hold x[b - q : b]
        q = np.arange(1, before + 1)
        left = np.append(common_prefixes(back)[1:], 0)
        right = common_prefixes([*v, -1, *w])[after + 1 + before - q] if after else np.zeros(before, np.int64)
        ok = np.flatnonzero((left + right >= q) & (left + right + q >= least))
        found += zip((b - q - left)[ok].tolist(), (b + right)[ok].tolist(), q[ok].tolist(), strict=True)
    n = len(x)
    for start, end, period in found:
        if start == b - before > 0 and x[start - 1] == x[start - 1 + period] or end == b + after < n and x[end] == x[end - period]:
            continue
        yield start, end, period


def find_runs(x: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all maximal repetitions of max(least, twice the period) symbols, by start and period."""
    runs: dict[int, dict[int, int]] = {}
    previous = 0

    def border(b: int, after: int) -> None:
        before = min(b, 2 * previous + after)
        if before + after >= least:
            for start, end, period in at_border(x, b, before, after, least):
                ends = runs.setdefault(start, {})
                ends[end] = min(period, ends.get(end, period))

    for b, size, source in Automaton(x).factors(x):
        border(b, size)
        if source >= 0 and size >= least + 2:
            shift, stop = b - source, source + size - 1
            for start in range(source + 1, source + size):
                if start in runs:
                    for end, period in list(runs[start].items()):
                        if end <= stop:
                            runs.setdefault(start + shift, {})[end + shift] = period
        previous = size
    border(len(x), 0)
    return sorted(((start, end - start, period) for start, ends in runs.items() for end, period in ends.items()), key=lambda r: (r[0], r[2]))


def _stretches(ids: np.ndarray, row: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(first, end) of words that can lie in runs.

    A run of period q repeats each of its sequences of (least + 1) // 2 words or fewer q words on, and these
    sequences cover it: what no repeated sequence covers is in no run, nor beside one that goes on.
    """
    k = max(1, least // 2)
    m = len(ids) - k + 1
    if m <= 1:
        return
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + m]
    at = np.flatnonzero(row[:m] == row[k - 1 :])
    h = mix(h[at] ^ mix(row[at] + 1))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, at[hit], 1)
    np.add.at(step, at[hit] + k, -1)
    covered = np.cumsum(step[:-1]) > 0
    edge = covered.copy()
    edge[1:] &= ~covered[:-1] | (row[1:] != row[:-1])
    last = covered.copy()
    last[:-1] &= ~covered[1:] | (row[1:] != row[:-1])
    for first, end in zip(np.flatnonzero(edge).tolist(), (np.flatnonzero(last) + 1).tolist(), strict=True):
        if end - first >= least:
            yield first, end


def _kernel(buf: np.ndarray, off: np.ndarray, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(number of words, runs, text without repetitions) of each text."""
    n = len(off) - 1
    start, end, row = words(buf, off, NOT_SPACE)
    first = np.searchsorted(row, np.arange(n + 1))
    keep, found, counts = np.ones(len(start), bool), [], np.zeros(n, np.int64)
    if len(start):
        ids = Rolling(buf).spans(start, end)
        for lo, hi in _stretches(ids, row, least):
            who = int(row[lo])
            for s, length, period in find_runs(np.unique(ids[lo:hi], return_inverse=True)[1].tolist(), least):
                found.append((lo - first[who] + s, length, period))
                counts[who] += 1
                keep[lo + s + period : lo + s + length] = False
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    cols = np.array(found, np.int64).reshape(-1, 3)
    runs = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(cols[:, k]) for k in range(3)], fields=list(_RUNS)))
    # Kept words, each with the white space byte after it if another one follows.
    stays, out = NOT_SPACE[buf], buf.copy()
    for i in np.flatnonzero(~keep).tolist():
        stays[start[i] : end[i]] = False
    kept = np.flatnonzero(keep)
    gap = end[kept[:-1]][row[kept[:-1]] == row[kept[1:]]]
    out[gap] = 32
    stays[gap] = True
    ends = np.concatenate([[0], np.cumsum(stays)])[off]
    data = out[stays]
    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))
    return pa.array(np.diff(first), pa.int64()), runs, texts.cast(pa.string())


def find(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Every document with its runs of words: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed.

    docs: doc_id, text; other columns are left aside. Words stand between white space (ASCII's) and are compared as
    64-bit hashes of their bytes. A run is a stretch of max(least, 2 * period) words or more that no neighbouring word
    extends; its period is the smallest. `collapsed` is the text without the words that a run holds after its first
    period, the others joined by one space. Null and empty texts have no words; ids may be null or repeated, rows are
    judged one by one; a text is read whole, whatever its length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *_kernel(buf, off, least)], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(scan, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
