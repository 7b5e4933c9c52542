"""Removal of repeated substrings: suffix order of a sharded corpus by merged Burrows-Wheeler transforms.

The corpus isn't suffix-sorted whole. Every string of `least` bytes has an anchor, the place of the
smallest hash of a gram in its first `slack` bytes, which equal strings share; so strings are told
apart by what their anchors are followed by, and the suffix order falls into independent parts:

1. Each run of starts with one anchor has a core (bytes that all its strings hold) and a hull (all
   bytes that any of them holds). Hash buckets count cores and hulls. A core that stands once means that no
   string of the run is repeated; a hull that stands twice, that all are.
2. The runs in between (some thousandths of all) send their hull, the core as one symbol. Each chunk of
   documents makes the Burrows-Wheeler transform of its own; a bucket merges the chunks' transforms by interleave
   refinement, whose common prefixes give the repeated intervals.
3. A core with very many different hulls (a passage that a large share of documents hold) isn't merged in
   one task: its strings' hashes are dealt out instead.

Documents travel in compressed chunks of some megabytes, so a pass moves few rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrerium.llm.bwt import Shard, merge
from orrerium.llm.common import Rolling, forget, materialise, mix, partitions, text_chunks, trim

#: Bytes of a chunk of documents (a pass holds some hundred times as much), and the different hulls of a core beyond which its strings are dealt out by hash.
CHUNK = 512 << 10
#: Chunks whose cores make a bucket, and whose hulls do.
BUCKET_CHUNKS = 16
HOT_HULLS = 256
GRAM = 8
_UPPER = np.uint64(0xFFFFFFFF00000000)
_WHOLE, _HULL, _EACH = 0, 1, 2


def slack_for(least: int) -> int:
    """A power of two, up to 64, of at most a third of the least length."""
    return max(1, min(64, 1 << max(0, (least // 3).bit_length() - 1)))


class Runs:
    """Runs of starts of `least` bytes with one anchor each, of texts in a byte string."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, least: int):
        self.least, self.slack = least, slack_for(least)
        self.core = least - self.slack
        self.rolling = Rolling(buf)
        # The upper half of a gram's hash and its place in one number, so that the least of a window is a plain minimum.
        low = self.rolling.windows(max(1, min(GRAM, self.core)))
        low &= _UPPER
        low |= np.arange(len(low), dtype=np.uint64)
        step = 1
        while step < self.slack and len(low) > step:
            low = np.minimum(low[step:], low[:-step])
            step *= 2
        head = np.ones(len(low), bool)
        for o, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            head[max(o, e - least + 1) : e] = False
        start = np.flatnonzero(head)
        anchor = (low[start] & ~_UPPER).astype(np.int64)
        new = np.ones(len(start), bool)
        # An anchor lies within its text, so runs of different texts have different anchors.
        new[1:] = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(new)
        self.anchor = anchor[first]
        self.first = start[first]
        self.last = start[np.append(first[1:], len(start)) - 1] if len(first) else self.first

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of cores, and of hulls with the anchor's place in them."""
        core = self.rolling.spans(self.anchor, self.anchor + self.core)
        hull = self.rolling.spans(self.first, self.last + self.least)
        place = ((self.anchor - self.first) << 20 | (self.last - self.first)).astype(np.uint64)
        return core, mix(hull ^ mix(place))


def _chunked(docs: DataFrame) -> DataFrame:
    """Documents as compressed chunks: chunk, ids, off, data."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight, n = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, buf, off in text_chunks(batch.column(1), CHUNK):
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), ids, pa.array([off.tobytes()], pa.binary()), pa.array([tight.compress(buf.tobytes())], pa.binary())], ["chunk", "ids", "off", "data"])
                n += 1

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(pack, f"chunk long, ids array<{kind}>, off binary, data binary")


def _open(off: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.frombuffer(off, np.int64)


def _by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    b = (mix(h) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(buckets + 1))
    for k in np.unique(b).tolist():
        yield k, order[cut[k] : cut[k + 1]]


def _numbers(col: pa.ChunkedArray | list, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in (col if isinstance(col, list) else col.to_pylist())]


def _table(rows: list[tuple], names: dict[str, pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, t) for c, (n, t) in zip(cols, names.items(), strict=True)})


_ASKED = {"chunk": pa.int64(), "kind": pa.int32(), "runs": pa.binary()}
_SENT = {"bucket": pa.int32(), "kind": pa.int32(), "chunk": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary()}
_FOUND = {"chunk": pa.int64(), "starts": pa.binary()}


def _judge(group: pa.Table) -> pa.Table:
    """A bucket of cores: which runs are repeated whole, and which must send more."""
    trim()
    chunks, cores, hulls, runs = group.column("chunk").to_pylist(), *(_numbers(group.column(c), np.uint64) for c in ("core", "hull")), _numbers(group.column("run"), np.int32)
    who = np.repeat(np.arange(len(chunks)), [len(x) for x in cores])
    core, hull, run = np.concatenate(cores), np.concatenate(hulls), np.concatenate(runs)
    _, c, times = np.unique(core, return_inverse=True, return_counts=True)
    keep = times[c] > 1
    c, hull, run, who = c[keep], hull[keep], run[keep], who[keep]
    order = np.lexsort((hull, c))
    c, hull, run, who = c[order], hull[order], run[order], who[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (hull[1:] != hull[:-1])
    h = np.cumsum(new) - 1
    alone = np.bincount(h)[h] == 1 if len(h) else np.zeros(0, bool)
    kinds = np.bincount(c[new], minlength=c.max(initial=-1) + 1)
    open_ = np.bincount(c[alone], minlength=len(kinds)) > 0
    kind = np.where(kinds[c] > HOT_HULLS, _EACH, _HULL)
    # A hull speaks once for all its copies.
    ask = open_[c] & new & (kinds[c] > 1)
    out = []
    for w in np.unique(who):
        mine = who == w
        for k, m in ((_WHOLE, mine & ~alone), (_HULL, mine & ask & (kind == _HULL)), (_EACH, mine & ask & (kind == _EACH))):
            if m.any():
                out.append((chunks[w], k, run[m].tobytes()))
    return _table(out, _ASKED)


def _resolve(group: pa.Table, least: int) -> pa.Table:
    """A bucket of hulls, merged, or of single strings, counted: the repeated starts of each chunk."""
    trim()
    chunks = group.column("chunk").to_pylist()
    out = []
    if group.column("kind")[0].as_py() == _EACH:
        hashes, starts = _numbers(group.column("a"), np.uint64), _numbers(group.column("b"), np.int64)
        who = np.repeat(np.arange(len(chunks)), [len(x) for x in hashes])
        _, inv, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        hit, where = times[inv] > 1, np.concatenate(starts)
        out = [(chunks[w], where[hit & (who == w)].tobytes()) for w in np.unique(who[hit])]
        return _table(out, _FOUND)
    depth = slack_for(least) + 1
    shards, starts = [], []
    cores = [np.frombuffer(x[:n], np.uint64) for x, n in ((c, int.from_bytes(c[-8:], "little")) for c in group.column("c").to_pylist())]
    every = np.unique(np.concatenate(cores))
    for own, bwt, back, start in zip(cores, *(_numbers(group.column(c), np.int32) for c in "abd"), strict=True):
        # Cores are symbols beyond the bytes, in one order in all shards.
        bwt = np.where(bwt > 256, 257 + np.searchsorted(every, own).astype(np.int32)[np.maximum(bwt - 257, 0)] if len(own) else bwt, bwt)
        shards.append(Shard(bwt, back, start))
        starts.append(start)
    order, common = merge(shards, depth)
    same = common >= depth
    same[:1] = False
    twice = same.copy()
    twice[:-1] |= same[1:]
    start = np.concatenate(starts)[order]
    hit = twice & (start >= 0)
    who = np.repeat(np.arange(len(shards)), [len(s.bwt) for s in shards])[order]
    out = [(chunks[w], start[hit & (who == w)].astype(np.int64).tobytes()) for w in np.unique(who[hit])]
    return _table(out, _FOUND)


def _shard(buf: np.ndarray, runs: Runs, at: np.ndarray, core: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """The transform of the runs' hulls: symbols, extensions, cores, and each suffix's start if a judged string begins there."""
    own, symbol = np.unique(core, return_inverse=True)
    parts, lengths = [], []
    for k, s in zip(at.tolist(), symbol.tolist(), strict=True):
        a, f, e = int(runs.anchor[k]), int(runs.first[k]), int(runs.last[k]) + runs.least
        parts += [buf[f:a].astype(np.int64) + 1, np.array([257 + s]), buf[a + runs.core : e].astype(np.int64) + 1]
        lengths.append(a - f + 1 + e - a - runs.core)
    lengths = np.array(lengths)
    shard = Shard.build(np.concatenate(parts), lengths, runs.slack + 1)
    head = np.cumsum(lengths + 1) - lengths - 1
    text_start = np.full(int((lengths + 1).sum()), -1, np.int64)
    for k, h in zip(at.tolist(), head.tolist(), strict=True):
        n = int(runs.last[k] - runs.first[k]) + 1
        text_start[h : h + n] = np.arange(runs.first[k], runs.first[k] + n)
    bwt, back, at = (x.astype(np.int32).tobytes() for x in (shard.bwt, shard.back, text_start[shard.at]))
    return bwt, back, own.tobytes() + len(own.tobytes()).to_bytes(8, "little"), at


def remove_repeats(docs: DataFrame, least: int = 400) -> DataFrame:
    """Every document without the bytes of any `least`-byte string that starts more than once in the corpus.

    docs: doc_id, text; other columns are left aside. Texts are UTF-8 bytes, null is empty; strings never cross documents,
    overlaps count, and all are judged on the input. Repeated rows repeat each other. Returns doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, and kept, the remaining bytes as text (parts of characters that a cut leaves are dropped there).
    Strings are told apart by 64-bit hashes of their cores.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = materialise(_chunked(docs), "chunks")
    buckets = max(partitions(spark), -(-chunks.count() // BUCKET_CHUNKS))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, off, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "off", "data")), strict=True):
                core, hull = Runs(*_open(off, data), least).hashes()
                for b, at in _by_bucket(core, buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([chunk], pa.int64()), *(pa.array([x[at].tobytes()], pa.binary()) for x in (core, hull)), pa.array([at.astype(np.int32).tobytes()], pa.binary())], ["bucket", "chunk", "core", "hull", "run"])
                trim()

    sent = chunks.select("chunk", "off", "data").mapInArrow(anchors, "bucket int, chunk long, core binary, hull binary, run binary")
    asked = materialise(sent.groupBy("bucket").applyInArrow(_judge, "chunk long, kind int, runs binary"), "runs")
    forget(spark)

    def send(key: tuple, mine: pa.Table, ask: pa.Table) -> pa.Table:
        trim()
        out: list[tuple] = []
        if len(mine) and len(ask):
            chunk, buf, off = key[0].as_py(), *_open(mine.column("off")[0].as_py(), mine.column("data")[0].as_py())
            runs = Runs(buf, off, least)
            core, _ = runs.hashes()
            kinds, told = ask.column("kind").to_pylist(), _numbers(ask.column("runs"), np.int32)
            if hulls := [t for k, t in zip(kinds, told, strict=True) if k == _HULL]:
                at = np.concatenate(hulls)
                out += [(b, _HULL, chunk, *_shard(buf, runs, at[x], core[at[x]])) for b, x in _by_bucket(core[at], buckets)]
            if each := [t for k, t in zip(kinds, told, strict=True) if k == _EACH]:
                at = np.concatenate(each)
                n = runs.last[at] - runs.first[at] + 1
                start = np.repeat(runs.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                h = runs.rolling.spans(start, start + least)
                out += [(b, _EACH, chunk, h[x].tobytes(), start[x].tobytes(), b"", b"") for b, x in _by_bucket(h, buckets)]
        return _table(out, _SENT)

    wanted = asked.where(F.col("kind") != _WHOLE)
    more = chunks.select("chunk", "off", "data").groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(send, "bucket int, kind int, chunk long, a binary, b binary, c binary, d binary")
    found = materialise(more.groupBy("kind", "bucket").applyInArrow(lambda g: _resolve(g, least), "chunk long, starts binary"), "starts")
    forget(spark)
    replies = asked.where(F.col("kind") == _WHOLE).select("chunk", "runs", F.lit(None).cast("binary").alias("starts")).unionByName(found.select("chunk", F.lit(None).cast("binary").alias("runs"), "starts"))

    def finish(mine: pa.Table, told: pa.Table) -> pa.Table:
        trim()
        out: list[tuple] = []
        for ids, off, data in zip(*(mine.column(c).to_pylist() for c in ("ids", "off", "data")), strict=True):
            buf, off = _open(off, data)
            edge = np.zeros(len(buf) + 1, np.int64)
            if whole := [x for x in told.column("runs").to_pylist() if x is not None]:
                runs, at = Runs(buf, off, least), np.concatenate(_numbers(whole, np.int32))
                np.add.at(edge, runs.first[at], 1)
                np.add.at(edge, runs.last[at] + least, -1)
            if some := [x for x in told.column("starts").to_pylist() if x is not None]:
                start = np.concatenate(_numbers(some, np.int64))
                np.add.at(edge, start, 1)
                np.add.at(edge, start + least, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for k, doc in enumerate(ids):
                text, mask = buf[off[k] : off[k + 1]], gone[off[k] : off[k + 1]]
                raw = text[~mask].tobytes()
                spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                out.append((doc, len(text), int(mask.sum()), spans, hashlib.sha256(raw).hexdigest(), raw.decode(errors="ignore")))
        names = {"doc_id": mine.schema.field("ids").type.value_type, "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
        return _table(out, names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema)
