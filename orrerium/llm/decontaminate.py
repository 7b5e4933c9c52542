"""Benchmark decontamination: token windows of a test set, looked up in every training text.

The windows of all benchmark items are broadcast as a sorted hash set behind a check of their
size; a set beyond the bound is dealt out by hash and joined instead. A hash hit counts only when
the window's bytes are equal.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrerium.llm.common import ALNUM, LOWER, Rolling, materialise, mix, text_chunks, words

#: Bytes of benchmark text that are broadcast (a worker holds about six times as much); more go the way of a join.
BROADCAST_BYTES = 16 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, kept string"


def _window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Of every n consecutive word hashes, by first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _STEP + h[k : k + m]
    return mix(out)


class Windows:
    """Windows of benchmark items: by length, their hashes in order, and where each window's words stand in `text`."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.names = [None if item is None else str(item) for item, _ in items]
        parts, upto, held = [], 0, defaultdict(list)
        for who, (_, text) in enumerate(items):
            for _, _, buf, off in text_chunks(pa.array([text], pa.string())):
                b = LOWER[buf]
                start, end, _ = words(b, off, ALNUM)
                if not len(start):
                    continue
                size, raw = min(n, len(start)), b.tobytes()
                parts.append(b" ".join([raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]) + b" ")
                first = upto + np.cumsum(end - start + 1) - (end - start + 1)
                h = _window_hash(Rolling(b).spans(start, end), size)
                held[size].append((h, first[: len(h)], first[size - 1 :] + (end - start)[size - 1 :], np.full(len(h), who, np.int32)))
                upto += len(parts[-1])
        self.text = b"".join(parts)
        self.by_size = {}
        for size, found in held.items():
            cols = [np.concatenate([f[k] for f in found]) for k in range(4)]
            order = np.argsort(cols[0], kind="stable")
            self.by_size[size] = tuple(c[order] for c in cols)

    def owners(self, size: int, h: int, window: bytes) -> set[str] | None:
        """The items that have the window; None if it only shares a hash, or no item has it."""
        hashes, begin, end, who = self.by_size[size]
        lo, hi = np.searchsorted(hashes, np.uint64(h)), np.searchsorted(hashes, np.uint64(h), "right")
        equal = [k for k in range(lo, hi) if self.text[begin[k] : end[k]] == window]
        return {self.names[who[k]] for k in equal} - {None} if equal else None


def _mark(found: Windows, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set[str]]]:
    """(start, end, row, hit) of words, and the items found in each row."""
    b = LOWER[buf]
    start, end, row = words(b, off, ALNUM)
    step = np.zeros(len(start) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    if len(start):
        h = Rolling(b).spans(start, end)
        raw = b.tobytes()
        for size, (known, *_) in found.by_size.items():
            w = _window_hash(h, size)
            if not len(w):
                continue
            at = np.minimum(np.searchsorted(known, w), len(known) - 1)
            for i in np.flatnonzero((known[at] == w) & (row[: len(w)] == row[size - 1 :])).tolist():
                who = found.owners(size, int(w[i]), b" ".join([raw[s:e] for s, e in zip(start[i : i + size].tolist(), end[i : i + size].tolist(), strict=True)]))
                if who is not None:
                    step[i] += 1
                    step[i + size] -= 1
                    items[int(row[i])] |= who
    return start, end, row, np.cumsum(step[:-1]) > 0, items


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every document with what of it occurs in the benchmark, and its text without the hit words (`kept`).

    docs: doc_id, text and any other columns, which are left aside. benchmark: item_id, text. Words are
    runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII; a window is `n`
    words, or the whole item where it has fewer. Null and empty texts have no words; items without
    words have no windows; a null item_id marks hits and isn't counted as an item; repeated rows
    are judged one by one. `kept` drops each run of hit words with what stands between them.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs, items = docs.select("doc_id", F.col("text").cast("string")), benchmark.select("item_id", F.col("text").cast("string"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {REPORT}"
    if size > broadcast_bytes:
        return _joined(docs, items, n, schema)
    known = spark.sparkContext.broadcast(Windows([tuple(r) for r in items.collect()], n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in text_chunks(batch.column(1)):
                start, end, row, hit, items = _mark(known.value, buf, off)
                yield _report(batch.column(0).slice(i, j - i), buf, off, start, end, row, hit, items)

    return docs.mapInArrow(scan, schema)


def _report(ids, buf, off, start, end, row, hit, items) -> pa.RecordBatch:
    n = len(off) - 1
    n_words, n_hit = np.bincount(row, minlength=n), np.bincount(row[hit], minlength=n)
    kept = [_without(buf[off[k] : off[k + 1]], start[row == k] - off[k], end[row == k] - off[k], hit[row == k]) if n_hit[k] else buf[off[k] : off[k + 1]].tobytes().decode() for k in range(n)]
    cols = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(items.get(k, ())) for k in range(n)], pa.int64()), pa.array([_digest(items.get(k, set())) for k in range(n)]), pa.array(n_hit > 0), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "kept"])


def _without(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hit: np.ndarray) -> str:
    keep = np.ones(len(buf), bool)
    for k in np.flatnonzero(hit).tolist():
        keep[start[k] : start[k + 1] if k + 1 < len(hit) and hit[k + 1] else end[k]] = False
    return buf[keep].tobytes().decode()


def _joined(docs: DataFrame, items: DataFrame, n: int, schema: str) -> DataFrame:
    """The way of a large benchmark: windows of both sides meet by hash; a document's own windows then mark it."""
    keyed = materialise(docs.withColumn("_key", F.monotonically_increasing_id()), "decontaminate-docs")
    lengths = sorted({r[0] for r in _windows(items, n, None).select("size").distinct().collect()})
    left = _windows(keyed.select("_key", "text"), n, lengths).select(F.col("id").alias("_key"), "h", "size").distinct()
    hits = left.join(_windows(items, n, None).select("h", "size", "words", F.col("id").alias("item_id")).distinct(), ["h", "size"])
    found = hits.groupBy("_key").agg(F.collect_list(F.struct("item_id", "words")).alias("found"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mine = batch.slice(k, 1)
                known = Windows([(x["item_id"], x["words"]) for x in mine.column(2)[0].as_py() or ()], n)
                if not len(text := mine.column(1).fill_null("")):
                    continue
                for _, _, buf, off in text_chunks(text):
                    yield _report(mine.column(0), buf, off, *_mark(known, buf, off))

    return keyed.join(found, "_key", "left").select("doc_id", "text", "found").mapInArrow(mark, schema)


def _windows(rows: DataFrame, n: int, lengths: list[int] | None) -> DataFrame:
    """(id, h, size, words) of all windows: of an item's own length, or of each of `lengths`, then without the words."""
    kind = rows.schema[0].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, buf, off in text_chunks(batch.column(1)):
                b = LOWER[buf]
                start, end, row = words(b, off, ALNUM)
                if not len(start):
                    continue
                h, raw = Rolling(b).spans(start, end), b.tobytes()
                count = np.bincount(row, minlength=len(off) - 1)
                for size in lengths if lengths is not None else range(1, n + 1):
                    w = _window_hash(h, size)
                    ok = row[: len(w)] == row[size - 1 :] if len(w) else np.zeros(0, bool)
                    if lengths is None:
                        ok &= np.minimum(count[row[: len(w)]], n) == size
                    at = np.flatnonzero(ok)
                    text = [None] * len(at) if lengths is not None else [b" ".join([raw[s:e] for s, e in zip(start[k : k + size], end[k : k + size], strict=True)]).decode() for k in at]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row[at])), pa.array(w[at].view(np.int64)), pa.array(np.full(len(at), size, np.int32)), pa.array(text, pa.string())], ["id", "h", "size", "words"])

    return rows.mapInArrow(cut, f"id {kind.simpleString()}, h long, size int, words string")
