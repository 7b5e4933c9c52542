"""Ranked lexical search: a max tree over document ranges for each term, searched best-first.

A first pass over the documents writes, for every run of them, which of the queries' terms each holds and how often.
A second one makes a tree of each run: its leaves are ranges of a few documents with the greatest impact of every
term in them, its nodes take the maxima of ranges of ranges. A query opens the node of the highest sum of weighted
maxima until no bound reaches its k-th score; equal bounds are opened, since a smaller id wins a tie. Runs are
searched in waves, each sixteen times as large as the one before, and the k-th scores of a wave bound the next, so
that what is found grows with the queries and not with the documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrerium.llm.common import ALNUM, LOWER, Rolling, materialise, mix, text_chunks, words

#: Documents of a run, and bytes of its text beyond which it ends; documents of a leaf and children of a node.
RUN_DOCS = 8192
RUN_BYTES = 16 << 20
FAN = 16
#: Terms that one table of maxima holds, and bytes of query terms and texts that are broadcast at a time.
TABLE_TERMS = 8192
BROADCAST_BYTES = 16 << 20

_RUN = "level int, n_docs long, n_terms long, ids binary, sizes binary, ends binary, terms binary, counts binary"
_HIT = "query long, doc long, score long"


def terms_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every term: runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII."""
    b = LOWER[buf]
    start, end, row = words(b, off, ALNUM)
    return (Rolling(b).spans(start, end) if len(start) else np.zeros(0, np.uint64)), row


class Queries:
    """Queries as sets of numbered terms, in groups whose tables of maxima are bounded."""

    def __init__(self, texts: list[str | None]):
        sets = []
        for text in texts:
            parts = [terms_of(buf, off)[0] for _, _, buf, off in text_chunks(pa.array([text], pa.string()))]
            sets.append(np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64))
        self.vocabulary = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.sets = [np.searchsorted(self.vocabulary, s).astype(np.int32) for s in sets]
        self.groups: list[list[int]] = []
        held: set[int] = set()
        for q, s in enumerate(self.sets):
            if not self.groups or len(held | set(s.tolist())) > TABLE_TERMS:
                self.groups.append([])
                held = set()
            self.groups[-1].append(q)
            held |= set(s.tolist())


def index(docs: DataFrame, vocabulary: np.ndarray, run_docs: int = RUN_DOCS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """A row for each run of documents: their ids (and which are null), numbers of terms, and the postings of the vocabulary by document.

    level: how many times sixteen runs there are for each of its like, by hash.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def row(parts: list[tuple], salt: int) -> pa.RecordBatch:
        ids, sizes, ends, terms, counts = (np.concatenate([p[k] for p in parts]) if k != 2 else np.cumsum(np.concatenate([p[2] for p in parts])) for k in range(5))
        h, level = int(mix(np.array([salt ^ int(mix(ids[:1, 0].view(np.uint64))[0])], np.uint64))[0]), 0
        while h & 15 == 0 and level < 15:
            h, level = h >> 4, level + 1
        cols = [pa.array([level], pa.int32()), pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64())]
        cols += [pa.array([x.tobytes()], pa.binary()) for x in (ids, sizes, ends.astype(np.int64), terms.astype(np.int32), counts.astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["level", "n_docs", "n_terms", "ids", "sizes", "ends", "terms", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, parts, held, size, salt = known.value, [], 0, 0, 0
        for batch in batches:
            for i, j, buf, off in text_chunks(batch.column(1)):
                h, at = terms_of(buf, off)
                n, col = j - i, batch.column(0).slice(i, j - i)
                ids = np.stack([np.asarray(col.fill_null(0)), np.asarray(col.is_null()).astype(np.int64)], 1)
                if len(vocab) and len(h):
                    place = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                    hit = vocab[place] == h
                    key, count = np.unique(at[hit] * len(vocab) + place[hit], return_counts=True)
                else:
                    key = count = np.zeros(0, np.int64)
                doc, term = key // max(len(vocab), 1), key % max(len(vocab), 1)
                parts.append((ids, np.bincount(at, minlength=n), np.bincount(doc, minlength=n), term, count))
                held, size = held + n, size + len(buf)
                if held >= run_docs or size >= run_bytes:
                    yield row(parts, salt)
                    parts, held, size, salt = [], 0, 0, salt + 1
        if parts:
            yield row(parts, salt)

    return docs.mapInArrow(scan, _RUN)


class Run:
    """A run of documents with the postings of some terms, and their tree."""

    def __init__(self, ids, sizes, ends, terms, impacts, wanted: np.ndarray):
        """wanted: the terms that the tree is for, ascending."""
        self.ids, n = ids, len(ids)
        place = np.minimum(np.searchsorted(wanted, terms), max(len(wanted) - 1, 0))
        keep = wanted[place] == terms if len(wanted) else np.zeros(len(terms), bool)
        doc = np.repeat(np.arange(n), np.diff(ends, prepend=0))[keep]
        present, self.term = np.unique(place[keep], return_inverse=True)
        self.present = wanted[present]
        self.impact, self.begin = impacts[keep], np.searchsorted(doc, np.arange(n + 1))
        low = np.zeros((-(-n // FAN), len(present)), np.int64)
        np.maximum.at(low, (doc // FAN, self.term), self.impact)
        self.tables = [low]  # from leaves to root
        while len(self.tables[-1]) > 1:
            t = self.tables[-1]
            self.tables.append(np.maximum.reduceat(t, np.arange(0, len(t), FAN), axis=0))

    def search(self, query: np.ndarray, weights: np.ndarray, k: int, best: list[tuple], least: int) -> None:
        """Put documents into `best`, a heap of the k best (score, order of the id reversed), of scores of `least` at least."""
        at = np.minimum(np.searchsorted(self.present, query), max(len(self.present) - 1, 0))
        at = at[self.present[at] == query] if len(self.present) else at[:0]
        if not len(at):
            return
        w = weights[self.present[at]]
        weight = np.zeros(len(self.present), np.int64)
        weight[at] = w
        top = len(self.tables) - 1
        heap = [(-int(b), top, i) for i, b in enumerate(self.tables[top][:, at] @ w)]
        heapq.heapify(heap)
        while heap:
            bound, level, i = heapq.heappop(heap)
            floor = max(least, best[0][0] if len(best) >= k else 1)
            if -bound < floor:
                return
            lo, hi = i * FAN, (i + 1) * FAN
            if level:
                bounds = self.tables[level - 1][lo:hi][:, at] @ w
                for j in np.flatnonzero(bounds >= floor).tolist():
                    heapq.heappush(heap, (-int(bounds[j]), level - 1, lo + j))
                continue
            begin = self.begin[lo : hi + 1]
            total = np.concatenate([[0], np.cumsum(self.impact[begin[0] : begin[-1]] * weight[self.term[begin[0] : begin[-1]]])])
            scores = np.diff(total[begin - begin[0]])
            for j in np.flatnonzero(scores >= floor).tolist():
                doc, null = self.ids[lo + j].tolist()
                entry = (int(scores[j]), -null, -doc)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _array(blob: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(blob, kind)


def _search(runs: DataFrame, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, k: int, least: np.ndarray) -> DataFrame:
    """The k best documents of each query among those of a task's runs, unless their scores are below `least`; a null id is -1 in `null`."""
    shared = runs.sparkSession.sparkContext.broadcast((queries.sets, queries.groups, weights, least))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, groups, w, floor = shared.value
        best: list[list[tuple]] = [[] for _ in sets]
        wanted = [np.unique(np.concatenate([sets[q] for q in g])) for g in groups]
        for batch in batches:
            for r in batch.to_pylist():
                ids, sizes, ends = _array(r["ids"]).reshape(-1, 2), _array(r["sizes"]), _array(r["ends"])
                terms, tf = _array(r["terms"], np.int32), _array(r["counts"], np.int32).astype(np.int64)
                m = 50 + (50 * sizes * n_docs) // max(n_terms, 1)
                impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(ends, prepend=0)))
                for group, some in zip(groups, wanted, strict=True):
                    run = Run(ids, sizes, ends, terms, impacts, some)
                    for q in group:
                        run.search(sets[q], w, k, best[q], int(floor[q]))
        for lo in range(0, len(best), 1000):
            rows = [(q, None if null else -doc, score) for q in range(lo, min(lo + 1000, len(best))) for score, null, doc in best[q]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, ["query", "doc", "score"])

    return runs.select("ids", "sizes", "ends", "terms", "counts").mapInArrow(scan, _HIT)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: list[tuple], k: int, kind: str) -> DataFrame:
    spark = docs.sparkSession
    queries = Queries([t for _, _, t in items])
    runs = materialise(index(docs, queries.vocabulary), "lexical-runs")
    n_docs, n_terms = (int(x or 0) for x in runs.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    df = np.zeros(len(queries.vocabulary), np.int64)
    size = len(df)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.bincount(_array(blob, np.int32), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    for term, n in runs.select("terms").mapInArrow(holders, "term long, n long").groupBy("term").agg(F.sum("n")).toLocalIterator():  # a row a term of the block
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    least = np.ones(len(items), np.int64)
    found = None
    for (level,) in sorted(runs.select("level").distinct().collect(), reverse=True):  # 16 at most
        hits = _search(runs.where(F.col("level") == level), queries, weights, n_docs, n_terms, k, least)
        found = materialise(_ranked(hits if found is None else found.unionByName(hits), k).drop("rank"), "lexical-hits")
        for query, score, n in found.groupBy("query").agg(F.min("score"), F.count(F.lit(1))).toLocalIterator():  # a row a query of the block
            if n >= k:
                least[query] = score
    names = spark.createDataFrame([(q, i) for q, (_, i, _) in enumerate(items)], f"query long, item_id {kind}")
    if found is None:
        found = spark.createDataFrame([], _HIT)
    return _ranked(found, k).join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k highest-scoring documents of each query: item_id, rank (from 1), doc_id, score.

    docs: doc_id (a whole number), text. queries: item_id, text. Other columns are left aside. Scores are sums over a
    query's distinct terms of a weight by rarity times a saturating count of the term against the document's length,
    in whole numbers. Documents of score 0 are not found; equal scores come by ascending id, null ids last. Null and
    empty texts have no terms: such queries find nothing, such documents are never found and don't count. Repeated
    rows, of documents or of queries, are searched and found one by one. Terms are compared as 64-bit hashes.

    Queries go out in blocks of at most `broadcast_bytes` of text (or one longer query), a pass over the documents each.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = queries.schema["item_id"].dataType.simpleString()
    out, block, size = None, [], 0
    rows = queries.select(F.octet_length(F.col("text").cast("string")).alias("size"), "item_id", F.col("text").cast("string")).toLocalIterator()
    for r in rows:
        n = r.size or 0
        if block and size + n > broadcast_bytes:
            found = _block(docs, block, k, kind)
            out, block, size = found if out is None else out.unionByName(found), [], 0
        block.append(tuple(r))
        size += n
    if block or out is None:
        found = _block(docs, block, k, kind)
        out = found if out is None else out.unionByName(found)
    return out
