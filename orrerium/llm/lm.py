"""Subword lattice likelihood of documents.

A word is a lattice from its start to its end. Its edges are the pieces of a public vocabulary, weighted by the vocabulary's
scores (as re-estimated by one step of expectation-maximisation over all training words), and one edge over the whole word,
weighted by its discounted training count; the discount's mass leads into the pieces. The marginal sums over all paths
in log space. Words are independent and a word begins with a piece that begins with a space, so the text's forward
recursion is the product of its words'. Expected counts start from the vocabulary alone and are summed over all parts, so
no score depends on how the documents are dealt out.

Counting doesn't broadcast the corpus's words. Documents are dealt into parts by a hash; each part
packs its distinct words' training counts, by hash, into a block for each bucket; a bucket sums
them and sends back to each part the totals of those words that other parts have, too. So what moves
grows with distinct words by part, and a word that all documents have moves once a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrerium.llm.common import LOWER, NOT_SPACE, Rolling, materialise, mix, partitions, text_chunks, trim, words
from orrerium.llm.lattice import Pieces, marginals

#: Bytes of text in a part, about.
PART_BYTES = 6 << 20
#: The hash that stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)
_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, start, end, row, hash) of the words of runs of rows."""
    for i, j, buf, off in text_chunks(texts):
        b = LOWER[buf]
        start, end, row = words(b, off, NOT_SPACE)
        yield i, j, b, start, end, row, Rolling(b).spans(start, end)


def _gathered(buf: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    upto = np.cumsum(n)
    return buf[np.repeat(start - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]


class Lexicon:
    """The distinct words of a part: hash, spelling, and count in training texts."""

    def __init__(self, texts: pa.Array, train: np.ndarray):
        none = np.zeros(0, np.int64)
        hashes, counts, spelt, sizes = [none.astype(np.uint64)], [none], [np.zeros(0, np.uint8)], [none]
        for i, _, b, start, end, row, h in _tokens(texts):
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            hashes.append(u)
            counts.append(np.bincount(inv, train[i + row].astype(float), minlength=len(u)).astype(np.int64))
            sizes.append((end - start)[first])
            spelt.append(_gathered(b, start[first], sizes[-1]))
        self.hash, first, inv = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        self.count = np.bincount(inv, np.concatenate(counts), minlength=len(self.hash)).astype(np.int64)
        n, buf = np.concatenate(sizes), np.concatenate(spelt)
        self.buf = _gathered(buf, (np.cumsum(n) - n)[first], n[first])
        self.end = np.cumsum(n[first])
        self.start = self.end - n[first]


def _reestimated(expected: np.ndarray, ends: float) -> np.ndarray:
    """Log probabilities of pieces; the end of a text is a piece of its own."""
    return np.log((expected + 0.1) / (expected.sum() + 0.1 * len(expected) + ends + 1))


def _dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(max(partitions(spark), -(-size // PART_BYTES)))
    return docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def score(docs: DataFrame, model_file: str, folds: int = 5, held_out: int = 1) -> DataFrame:
    """Every document's log10 probability, and that of a smoothed word model.

    docs: doc_id, text; other columns are left aside. A document is held out if crc32(doc_id as text) mod `folds`
    is `held_out`; the others are learned from (with a null id, too). Words are runs of bytes other than
    ASCII white space, A-Z lower-cased; each text has one end besides, so null and empty texts are their end alone.
    Repeated rows are learned from and scored one by one. With no training texts all counts are 0 and the
    lattice has the vocabulary's own probabilities. Words are told apart by 64-bit hashes.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), fold.alias("held_out"))
    docs, buckets = _dealt(docs)

    def learn(group: pa.Table) -> pa.Table:
        trim()
        part, (text, held) = group.column("part")[0].as_py(), (group.column(c).combine_chunks() for c in ("text", "held_out"))
        train = ~held.to_numpy(zero_copy_only=False)
        lex = Lexicon(text, train)
        seen = lex.count > 0
        p = _pieces(model_file)
        s, e, c = lex.start[seen], lex.end[seen], lex.count[seen].astype(float)
        expected = np.zeros(len(p.raw))
        if len(c):
            _, expected = marginals(p, p.start, lex.buf, s, e, c)
        # A block for each bucket: hashes and counts, and in bucket -1 the pieces' expected counts and the number of ends.
        h, c = np.append(lex.hash, END), np.append(lex.count, train.sum())
        b = (mix(h) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        cut = np.searchsorted(b[order], np.arange(buckets + 1))
        h, c = h[order], c[order]
        full = [k for k in range(buckets) if cut[k] < cut[k + 1]]
        hashes = [h[cut[k] : cut[k + 1]].tobytes() for k in full]
        counts = [c[cut[k] : cut[k + 1]].tobytes() for k in full]
        return pa.table({"bucket": pa.array([*full, -1], pa.int32()), "part": pa.array([part] * (len(full) + 1), pa.int32()), "a": pa.array([*hashes, expected.tobytes()], pa.binary()), "b": pa.array([*counts, b""], pa.binary())})

    blocks = materialise(docs.groupBy("part").applyInArrow(learn, "bucket int, part int, a binary, b binary"), "lexicon")

    def add(group: pa.Table) -> pa.Table:
        """Totals of a bucket's words, to each part that shares them; for part -1, the bucket's (N, V, words of count 1 and 2)."""
        part, a, b = (group.column(c).to_pylist() for c in ("part", "a", "b"))
        h, c = np.frombuffer(b"".join(a), np.uint64), np.frombuffer(b"".join(b), np.int64)
        who = np.repeat(np.arange(len(part)), [len(x) // 8 for x in a])
        u, inv, times = np.unique(h, return_inverse=True, return_counts=True)
        total = np.bincount(inv, c, minlength=len(u)).astype(np.int64)
        stats = np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.int64)
        many = times[inv] > 1
        out = [(k, h[m].tobytes(), total[inv[m]].tobytes()) for k, m in ((part[w], many & (who == w)) for w in range(len(part))) if m.any()]
        out.append((-1, b"", stats.tobytes()))
        return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "a": pa.array([x[1] for x in out], pa.binary()), "b": pa.array([x[2] for x in out], pa.binary())})

    sums = materialise(blocks.where("bucket >= 0").groupBy("bucket").applyInArrow(add, "part int, a binary, b binary"), "totals")

    def fold_up(column: str, kind: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    v = np.frombuffer(x, kind)
                    total = v.copy() if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], [column])

        return run

    def summed(rows: DataFrame, column: str, kind: type) -> np.ndarray | None:
        """The sum of equal-length vectors: within tasks, then of at most 32 sums."""
        parts = rows.select(column).mapInArrow(fold_up(column, kind), f"{column} binary").coalesce(32)
        got = [np.frombuffer(r[0], kind) for r in parts.mapInArrow(fold_up(column, kind), f"{column} binary").collect()]
        return np.sum(got, axis=0) if got else None

    stats = summed(sums.where("part = -1"), "b", np.int64)
    tokens, kinds, ones, twos = (int(x) for x in stats) if stats is not None else (0, 0, 0, 0)
    expected = summed(blocks.where("bucket = -1"), "a", np.float64)
    ends = docs.where("not held_out").count()
    discount = ones / (ones + 2 * twos) if ones else 0.5
    known = docs.sparkSession.sparkContext.broadcast(_reestimated(expected, ends) if tokens else None)  # a number for each piece

    def judge(key: tuple, group: pa.Table, sent: pa.Table) -> pa.Table:
        if not len(group):
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        trim()
        text, held = (group.column(c).combine_chunks() for c in ("text", "held_out"))
        lex = Lexicon(text, ~held.to_numpy(zero_copy_only=False))
        p = _pieces(model_file)
        count = lex.count.copy()
        h = np.frombuffer(b"".join(sent.column("a").to_pylist()), np.uint64)
        c = np.frombuffer(b"".join(sent.column("b").to_pylist()), np.int64)
        at = np.minimum(np.searchsorted(lex.hash, h), max(len(lex.hash) - 1, 0))
        hit = lex.hash[at] == h if len(lex.hash) else np.zeros(len(h), bool)
        count[at[hit]] = c[hit]
        ll, _ = marginals(p, p.start if known.value is None else known.value, lex.buf, lex.start, lex.end)
        n = max(tokens, 1)
        spare = discount * kinds / n if tokens else 1.0
        logs = np.log10(np.maximum(count - discount, 0) / n + spare * np.exp(ll))
        base = np.log10((count + 0.5) / (tokens + 0.5 * (kinds + 1)))
        end = np.log10(max(ends - discount, 0) / n) if ends else 0.0
        end_base = np.log10((ends + 0.5) / (tokens + 0.5 * (kinds + 1)))
        m = len(group)
        n_tokens, n_known, total, plain = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
        for i, j, _, _, _, row, h in _tokens(text):
            at = np.searchsorted(lex.hash, h)
            n_tokens[i:j] = np.bincount(row, minlength=j - i)
            n_known[i:j] = np.bincount(row[count[at] > 0], minlength=j - i)
            total[i:j] = np.bincount(row, logs[at], minlength=j - i)
            plain[i:j] = np.bincount(row, base[at], minlength=j - i)
        return pa.table({"doc_id": group.column("doc_id"), "held_out": held, "n_tokens": n_tokens + 1, "n_known": n_known + (ends > 0), "train_tokens": np.full(m, tokens), "base_score": plain + end_base, "score": total + end})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("part").cogroup(sums.where("part >= 0").groupBy("part")).applyInArrow(judge, schema)
