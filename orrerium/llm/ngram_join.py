"""Exact n-gram Jaccard self-join behind count-vector R-trees.

Equal sets of shingles are one class. A set's rarest shingles (as many as two similar sets can't both
miss; rarity by a sketch of fixed size, any order gives the same links) are its keys, and an R-tree stands over
the sets of each key: the counts of shingles by hash group are its points, and a node is entered only if the sum of the
coordinate minima of the point and the node's upper corner allows the overlap. What survives is joined to
groups of sets that may be alike, within which an R-tree finds the pairs that are verified on the shingles. Links found
become components. A key that many sets have is cut into blocks, and pairs of blocks are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrerium.llm.common import FILTER_BITS, LOWER, NOT_SPACE, Rolling, id_filter, materialise, may_have, mix, partitions, rows_of, settled, step, text_chunks, trim, words
from orrerium.llm.components import components, forest

#: Coordinates of a point, points of a node, and the most documents and shingles of a block of a cluster.
DIMENSIONS = 64
NODE = 32
BLOCK_DOCS = 4000
BLOCK_SHINGLES = 4_000_000
#: Counts by finer groups that a task holds.
FINE_CELLS = 16_000_000
#: Cells of the sketch of shingle frequencies (a byte each is broadcast), and its slices.
SKETCH_BITS = 20
SLICES = 32
#: Sets of a key that are compared pair by pair; those beyond which a key is cut into blocks; keys sent at a time; text bytes of a bucket.
FEW = 12
HOT_KEY = 4096
SENT_KEYS = 200_000
BUCKET_BYTES = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-word shingles of each row, sorted; fewer words are one shingle."""
    b = LOWER[buf]
    start, end, row = words(b, off, NOT_SPACE)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = Rolling(b).spans(start, end)
    count = np.bincount(row, minlength=len(off) - 1)
    parts = []
    for size in range(1, n + 1):
        m = len(h) - size + 1
        if m <= 0:
            break
        ok = row[:m] == row[size - 1 :]
        if size < n:
            ok &= count[row[:m]] == size
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        g = np.full(len(at), size, np.uint64)
        for k in range(size):
            g = g * _ODD + h[at + k]
        parts.append((row[at], mix(g)))
    row, g = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return row[new], g[new]


def class_of(row: np.ndarray, g: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two 64-bit sums) of the set of each row: equal for equal sets."""
    s1, s2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    np.add.at(s1, row, mix(g))
    np.add.at(s2, row, mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return np.bincount(row, minlength=rows), s1.view(np.int64), s2.view(np.int64)


def profile(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, name): size and 128-bit sum of each set, and these in 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in text_chunks(batch.column(1)):
                size, s1, s2 = class_of(*shingles(buf, off, n), j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(s1), pa.array(s2), pa.array(class_name(size, s1, s2))], ["doc_id", "n_shingles", "s1", "s2", "name"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, name long")


def _texts(batch: pa.RecordBatch, known) -> pa.Array:
    """Texts of rows that a filter of ids lets through, and of rows without an id."""
    if known is None:
        return batch.column(1)
    ids = batch.column(0)
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    keep = ~there
    keep[there] = may_have(known.value, ids.drop_null().to_numpy(zero_copy_only=False))
    return batch.column(1).filter(pa.array(keep))


def sketch(docs: DataFrame, n: int, known=None) -> np.ndarray:
    """For each cell of shingle hashes, 8 log2(1 + how many texts have a shingle there)."""
    width = (1 << SKETCH_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, buf, off in text_chunks(_texts(batch, known)):
                cells += np.bincount((shingles(buf, off, n)[1] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells))
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([cells[k * width : (k + 1) * width].astype(np.uint32).tobytes() for k in range(SLICES)], pa.binary())], ["slice", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
        level = [np.minimum(255, 8 * np.log2(1.0 + x)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(level, pa.binary())], ["slice", "cells"])

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for k, x in docs.select("doc_id", "text").mapInArrow(count, "slice int, cells binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, cells binary").collect():  # a byte a cell
        out[k * width : (k + 1) * width] = np.frombuffer(x, np.uint8)
    return out


def keys(row: np.ndarray, g: np.ndarray, size: np.ndarray, name: np.ndarray, level: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """placed_keys without the places."""
    return placed_keys(row, g, size, name, level, p, q)[:2]


def placed_keys(row: np.ndarray, g: np.ndarray, size: np.ndarray, name: np.ndarray, level: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, place): of each set the rarest shingles, one more than a set as similar may lack, and how many are rarer still; hot
    ones once for each pair of blocks."""
    cell = level[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((g, cell, row))
    first = np.cumsum(size) - size
    lead = size - -(-size * p // q) + 1
    place = np.arange(len(order)) - first[row]
    early = place < lead[row]
    take, place = order[early], place[early]
    row, g, cell = row[take], g[take], cell[take]
    spare = 2.0 ** (float(np.median(level)) / 8)
    blocks = np.maximum(1, np.ceil((2.0 ** (cell / 8) - spare) / HOT_KEY)).astype(np.int64)
    hot = np.flatnonzero(blocks > 1)
    if not len(hot):
        return row, g, place
    times = blocks[hot]
    who = np.repeat(hot, times)
    other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    mine = (mix(name[row[who]].view(np.uint64)) % blocks[who].astype(np.uint64)).astype(np.int64)
    pair = np.minimum(mine, other) * 1_000_003 + np.maximum(mine, other)
    cold = blocks == 1
    return np.concatenate([row[cold], row[who]]), np.concatenate([g[cold], mix(g[who] * _ODD + mix(pair.astype(np.uint64)))]), np.concatenate([place[cold], place[who]])


def points(row: np.ndarray, g: np.ndarray, rows: int) -> np.ndarray:
    """The counts of each set's shingles by hash group."""
    at = row * DIMENSIONS + (g & np.uint64(DIMENSIONS - 1)).astype(np.int64)
    return np.bincount(at, minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS).astype(np.int32)


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 with their like bytes together, most of which are 0."""
    return np.ascontiguousarray(x.astype("<u4").reshape(-1, 1).view(np.uint8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def set_keys(docs: DataFrame, n: int, p: int, q: int, level: np.ndarray, buckets: int, ids=None) -> DataFrame:
    """(bucket, keys, names, sizes, places, points): the keys of the sets of a run of documents, each with its set's name and size and its
    place in the set's order, packed by bucket; in bucket -1 the names of the run's sets with their points."""
    known = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight, held, n_held = zstandard.ZstdCompressor(level=1), [], 0

        def send() -> pa.RecordBatch:
            name, point = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            mine, key, size, place = np.concatenate([x[0][x[2]] for x in held]), *(np.concatenate([x[k] for x in held]) for k in (3, 4, 5))
            bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut)).tolist()
            parts = [order[cut[b] : cut[b + 1]] for b in full]
            cols = [[*(x[at].tobytes() for at in parts), last] for x, last in ((key, b""), (mine, name.tobytes()))]
            cols += [[*(planes(x[at]) for at in parts), None] for x in (size, place)]
            return pa.RecordBatch.from_arrays([pa.array([*full, -1], pa.int32()), *(pa.array(c, pa.binary()) for c in (*cols, [None] * len(full) + [tight.compress(planes(point))]))], ["bucket", "keys", "names", "sizes", "places", "points"])

        for batch in batches:
            for i, j, buf, off in text_chunks(_texts(batch, ids)):
                row, g = shingles(buf, off, n)
                size, s1, s2 = class_of(row, g, j - i)
                name = class_name(size, s1, s2)
                who, key, place = placed_keys(row, g, size, name, known.value, p, q)
                held.append((name, points(row, g, j - i), who, key, size[who], place))
                n_held += len(key)
                if n_held >= SENT_KEYS:
                    yield send()
                    held, n_held = [], 0
        if held:
            yield send()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, keys binary, names binary, sizes binary, places binary, points binary")


def _paired(first: np.ndarray, m: np.ndarray, size: np.ndarray, place: np.ndarray, p: int, q: int) -> np.ndarray:
    """Which entries of runs of equal keys (by size within a run) may be the first that two sets as similar as asked have in common.

    Of a key that few sets have, every pair is tried: sizes, and what both have from the key on, must allow the overlap. Of others,
    the sets next in size must.
    """
    out = np.zeros(len(size), bool)
    for n in np.unique(m[(m > 1) & (m <= FEW)]).tolist():
        at = first[m == n][:, None] + np.arange(n)
        for x, y in zip(*np.triu_indices(n, 1), strict=True):
            a, b = at[:, x], at[:, y]
            rest = np.minimum(size[a] - place[a], size[b] - place[b])
            fit = (size[a] * q >= size[b] * p) & (size[b] * q >= size[a] * p) & (rest * (p + q) >= (size[a] + size[b]) * p)
            out[a[fit]] = out[b[fit]] = True
    many = np.repeat(m > FEW, m)
    run = np.repeat(np.arange(len(m)), m)
    near = many[1:] & (run[1:] == run[:-1]) & (size[:-1] * q >= size[1:] * p)
    out[1:] |= near
    out[:-1] |= near
    return out


def shared(group: pa.Table, p: int, q: int) -> pa.Table:
    """bucket, name, keys: the sets of a bucket that have a key in common with another one that may be as similar as asked, with those keys."""
    trim()
    bucket = group.column("bucket")[0].as_py()
    key, name = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint64), ("names", np.int64)))
    size, place = (np.concatenate([unplanes(x) for x in group.column(c).to_pylist()]) for c in ("sizes", "places"))
    order = np.lexsort((name, size, key))
    key, name, size, place = key[order], name[order], size[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name, size, place = key[new], name[new], size[new], place[new]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    many = _paired(first, np.diff(np.append(first, len(key))), size, place, p, q)
    key, name = key[many], name[many]
    order = np.argsort(name, kind="stable")
    key, name = key[order], name[order]
    first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
    cut = np.append(first, len(name)).tolist()
    return pa.table({"bucket": pa.array(np.full(len(first), bucket), pa.int32()), "name": pa.array(name[first]), "keys": pa.array([key[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})


def _points_of(dealt: DataFrame) -> DataFrame:
    """name, point of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = unplanes(loose.decompress(raw)).reshape(-1, DIMENSIONS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(name, np.int64)), pa.array([planes(v) for v in x], pa.binary())], ["name", "point"])

    rows = dealt.where("bucket = -1").select("names", "points").mapInArrow(run, "name long, point binary")
    return rows.groupBy("name").agg(F.first("point").alias("point"))


def class_name(size: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """A class in 64 bits, at least 0."""
    return (mix(s1.view(np.uint64) + mix(s2.view(np.uint64) + size.astype(np.uint64))) >> np.uint64(1)).view(np.int64)


class Tree:
    """An R-tree over points of shingle counts, packed in order of set size and of the coordinates that stand out.

    levels[0] are the leaves; a node holds its children's upper corner and their least and largest size.
    """

    def __init__(self, point: np.ndarray, size: np.ndarray):
        self.point, self.size = point, size
        high = (point[:, :16] * DIMENSIONS > size[:, None]) @ (1 << np.arange(16)) if len(size) else size
        self.order = np.lexsort((high, size))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        upper, least, most = point[self.order], size[self.order], size[self.order]
        while len(upper) > 1 or not self.levels:
            first = np.arange(0, len(upper), NODE)
            if not len(first):
                break
            upper, least, most = np.maximum.reduceat(upper, first), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
            self.levels.append((upper, least, most))

    def search(self, point: np.ndarray, size: int, p: int, q: int) -> np.ndarray:
        """Sets whose bound on the overlap leaves similarity p / q possible."""
        if not self.levels:
            return np.zeros(0, np.int64)
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            upper, least, most = self.levels[k]
            at = at[(most[at] * q >= size * p) & (least[at] * p <= size * q)]
            at = at[np.minimum(upper[at], point).sum(1) * (p + q) >= p * (size + np.maximum(least[at], -(-size * p // q)))]
            at = (at[:, None] * NODE + np.arange(NODE)).ravel()
            at = at[at < (len(self.levels[k - 1][0]) if k else len(self.order))]
        at = self.order[at]
        return at[alike(self.point[at], self.size[at], point, size, p, q)]


def alike(point: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray | int, p: int, q: int) -> np.ndarray:
    """Whether the sizes and the summed coordinate minima leave similarity p / q possible."""
    fit = (np.minimum(size, other_size) * q >= np.maximum(size, other_size) * p) & (np.minimum(size, other_size) > 0)
    return fit & (np.minimum(point, other).sum(1) * (p + q) >= p * (size + other_size))


def links(left: list[np.ndarray], right: list[np.ndarray] | None, p: int, q: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among `left`, or between `left` and `right` (indexes go on into it)."""
    sets = left + (right or [])
    size = np.array([len(s) for s in sets], np.int64)
    point = np.zeros((len(sets), DIMENSIONS), np.int32)
    for k, s in enumerate(sets):
        point[k] = points(np.zeros(len(s), np.int64), s, 1)
    shift = len(left) if right is not None else 0
    tree = Tree(point[shift:], size[shift:])
    # The same bound on finer groups, about two shingles to a group: most of what is unlike needn't be verified.
    width = 1 << int(np.clip(np.ceil(np.log2(max(size.max(initial=1) / 2, 1))), 6, 12))
    while width > DIMENSIONS and width * len(sets) > FINE_CELLS:
        width //= 2
    fine = np.zeros((len(sets), width), np.uint16)
    for k, s in enumerate(sets):
        fine[k] = np.minimum(np.bincount(((s >> np.uint64(6)) & np.uint64(width - 1)).astype(np.int64), minlength=width), 65535)
    group = np.arange(len(sets))
    out = []
    for i, s in enumerate(left):
        cand = tree.search(point[i], len(s), p, q) + shift
        if right is None:
            cand = cand[cand < i]
        cand = cand[group[cand] != group[i]]
        bound = np.minimum(fine[cand], fine[i]).sum(1, dtype=np.int64)
        some = (bound * (p + q) >= p * (len(s) + size[cand])) | (size[cand] > 65535)
        cand = cand[some][np.argsort(-bound[some], kind="stable")]
        while len(cand := cand[group[cand] != group[i]]):
            j, cand = int(cand[0]), cand[1:]
            both = len(np.intersect1d(s, sets[j], assume_unique=True))
            if q * both >= p * (len(s) + len(sets[j]) - both):
                out.append((i, j))
                a, b = sorted((group[i], group[j]))
                group[group == b] = a
    return out


def _of_hot_key(who: np.ndarray, group: np.ndarray, point: np.ndarray, size: np.ndarray, p: int, q: int) -> list[tuple[int, int]]:
    """Edges that join the sets `who` of one key as far as their bounds allow, beyond what `group` has joined.

    Sets of the largest group needn't be searched from: a pair that ends in another one is found from there.
    """
    out: list[tuple[int, int]] = []
    own = group[who].copy()
    if (own == own[0]).all():
        return out
    tree, done, tried = Tree(point[who], size[who]), np.zeros(len(who), bool), 0
    while True:
        names, inv, times = np.unique(own, return_inverse=True, return_counts=True)
        todo = np.flatnonzero(~done & (inv != times.argmax()))
        if not len(todo):
            return out
        # A few steps to find the large group, then all that are left outside.
        for k in todo[:1] if tried < 8 else todo:
            done[k] = True
            tried += 1
            near = tree.search(point[who[k]], int(size[who[k]]), p, q)
            for other in np.unique(own[near[own[near] != own[k]]]).tolist():
                out.append((int(who[k]), int(who[near[own[near] == other][0]])))
                own[own == other] = own[k]


def meet(group: pa.Table, p: int, q: int) -> pa.Table:
    """A bucket's sets that have a key in common and whose bounds allow a link, as a forest (a, b) of what may be alike.

    group: name, keys, point; a name once.
    """
    trim()
    names = np.asarray(group.column("name"))
    held = group.column("keys").to_pylist()
    key, who = np.frombuffer(b"".join(held), np.uint64), np.repeat(np.arange(len(names)), [len(x) // 8 for x in held])
    point = np.stack([unplanes(x) for x in group.column("point").to_pylist()]).astype(np.int32)
    size = point.sum(1, dtype=np.int64)
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    m = np.diff(np.append(first, len(key)))
    pairs = [np.zeros((0, 2), np.int64)]
    for n in np.unique(m[m <= FEW]).tolist():
        sets = who[first[m == n][:, None] + np.arange(n)]
        x, y = np.triu_indices(n, 1)
        pairs.append(np.unique(np.stack([sets[:, x].ravel(), sets[:, y].ravel()], 1), axis=0))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    keep = [pairs[k : k + 100_000][alike(point[a[:, 0]], size[a[:, 0]], point[a[:, 1]], size[a[:, 1]], p, q)] for k in range(0, len(pairs), 100_000) for a in (pairs[k : k + 100_000],)]
    edges = np.concatenate([pairs[:0], *keep])
    own = np.arange(len(names))
    at, low = forest(edges[:, 0], edges[:, 1])
    own[at] = low
    for f, n in sorted(zip(first[m > FEW].tolist(), m[m > FEW].tolist(), strict=True), key=lambda x: -x[1]):
        if found := _of_hot_key(who[f : f + n], own, point, size, p, q):
            for a, b in found:
                own[own == own[b]] = own[a]
    at = np.flatnonzero(own != np.arange(len(own)))
    return pa.table({"a": pa.array(names[at]), "b": pa.array(names[own[at]])})


def _clusters(dealt: DataFrame, p: int, q: int) -> DataFrame:
    """(id, component) of the sets that keys and bounds leave possible."""
    common = dealt.where("bucket >= 0").select("bucket", "keys", "names", "sizes", "places").groupBy("bucket").applyInArrow(lambda g: shared(g, p, q), "bucket int, name long, keys binary")
    met = common.join(_points_of(dealt), "name").groupBy("bucket").applyInArrow(lambda g: meet(g, p, q), "a long, b long")
    return components(met)


def ngram_join(docs: DataFrame, n: int = 3, p: int = 90, q: int = 100) -> DataFrame:
    """Every document with the size of its shingle set and its component of links (q * overlap >= p * union).

    docs: doc_id, text; other columns are left aside. Words are runs of bytes other than ASCII white
    space, A-Z lower-cased. Null, empty and blank texts have no shingles and link with nothing.
    Equal sets are one class, so repeated rows and copies cost one comparison; rows of one id with different texts are
    different members, and rows without an id are members without a name (a component of such rows alone has a null id). Shingles are compared by
    64-bit hashes. Returns doc_id, n_shingles, component_id.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = materialise(profile(docs, n), "profile")
    reps = rows.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2", "name").agg(F.min("doc_id").alias("rep"))
    reps = materialise(reps, "classes")
    size, many = rows.agg(F.sum("n_shingles")).first()[0] or 0, reps.count()
    # The representatives' texts alone: by a filter of ids, or by a join if there are too many for it.
    known = id_filter(reps.select("rep")) if many <= FILTER_BITS else None
    texts = docs if known else rows_of(docs, reps.select("rep"), "doc_id")
    buckets = max(partitions(docs.sparkSession), -(-size * 6 // BUCKET_BYTES))
    with step() as held:
        dealt = materialise(set_keys(texts, n, p, q, sketch(texts, n, known), buckets, known), "keys")
        cluster = _clusters(dealt, p, q)
        roots = cluster.select(F.col("component").alias("id"), "component").distinct()
    members = settled(cluster.unionByName(roots).select(F.col("id").alias("name"), F.col("component").alias("c")), "clusters", held)
    found = components(_verified(docs, reps, members, n, p, q))
    named = reps.join(found.withColumnRenamed("id", "name"), "name", "left").withColumn("top", F.coalesce("component", "name"))
    named = materialise(named.select("n_shingles", "s1", "s2", "rep", "top"), "named")
    least = named.groupBy("top").agg(F.min("rep").alias("component_id"))
    top = materialise(named.join(least, "top").select("n_shingles", "s1", "s2", "component_id"), "tops")
    blank = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("n_shingles > 0").join(top, ["n_shingles", "s1", "s2"]).select("doc_id", "n_shingles", "component_id").unionByName(blank)


def _verified(texts: DataFrame, reps: DataFrame, members: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """Links (a, b) within clusters. A large cluster is cut into blocks, and pairs of blocks are compared."""
    sizes = materialise(reps.join(members, "name"), "members")
    blocks = sizes.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s")).select("c", F.ceil(F.greatest(F.col("m") / BLOCK_DOCS, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = sizes.select("name", "c", F.col("rep").alias("doc_id")).join(materialise(blocks, "blocks"), "c")
    placed = materialise(placed.withColumn("mine", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")), "placed")
    mine = rows_of(texts, placed.select("doc_id"), "doc_id")
    spread = mine.join(placed, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = spread.select("c", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "name", "text").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")

    def close(key: tuple, held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        sides = [[x for x in held if x[0] == s] for s in (key[1], key[2])]
        ids = [x[1] for x in sides[0]] + ([x[1] for x in sides[1]] if key[1] != key[2] else [])
        found = links([x[2] for x in sides[0]], [x[2] for x in sides[1]] if key[1] != key[2] else None, p, q)
        return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            at = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            block, name = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for first, end, buf, off in text_chunks(batch.column(5)):
                row, g = shingles(buf, off, n)
                own = class_name(*class_of(row, g, end - first)).tolist()
                cut = np.searchsorted(row, np.arange(end - first + 1))
                for k in range(first, end):
                    if at[k] != now:
                        if len(held) > 1:
                            yield close(now, held)
                        trim()
                        now, held = at[k], []
                    # Rows of one id may have other texts than the class that is named by it.
                    if own[k - first] == name[k]:
                        held.append((block[k], name[k], g[cut[k - first] : cut[k - first + 1]].copy()))
        if len(held) > 1:
            yield close(now, held)

    return dealt.mapInArrow(run, "a long, b long")
