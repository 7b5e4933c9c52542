"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a
hashed linear scorer trained on the posterior labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrerium.llm.common import LOWER, NOT_SPACE, Rolling, materialise, text_chunks, words

#: Labellers, each with its statistic and the bounds beyond which it votes bad and good (else it abstains).
LABELLERS = ("symbols", "capitals", "exclamations", "length", "word_length", "variety", "repeated_lines", "bars")
BUCKETS = 1 << 10
#: Texts that the scorer is fitted on, about (drawn by a hash of the id): bounds the one task that fits it.
FIT_ROWS = 20_000
KEEP = 0.5
#: What labellers are taken to be built for: of good texts, each calls at most this share bad.
FALSE_ALARM = 5e-4
ROUNDS = 60

_PLAIN = np.zeros(256, bool)
_PLAIN[[*b" \t\n\r\v\f.,;:!?'\"-()|"]] = True
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = _PLAIN[128:] = True


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of statistics for each text, in the order of LABELLERS; texts without words have nan."""
    n = len(off) - 1
    out = np.full((n, len(LABELLERS)), np.nan)
    if not len(buf):
        return out
    byte_row = np.repeat(np.arange(n), np.diff(off))

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(byte_row[mask], minlength=n)

    b = LOWER[buf]
    start, end, row = words(b, off, NOT_SPACE)
    w = np.bincount(row, minlength=n)
    some = w > 0
    size = np.bincount(row, end - start, minlength=n)
    h = Rolling(b).spans(start, end)
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    kinds = np.bincount(row[order][new], minlength=n)
    line = np.ones(256, bool)
    line[10] = False
    ls, le, lr = words(b, off, line)
    lh = Rolling(b).spans(ls, le)
    order = np.lexsort((lh, lr))
    twice = np.zeros(len(lh), bool)
    twice[1:] = (lh[order][1:] == lh[order][:-1]) & (lr[order][1:] == lr[order][:-1])
    lines, again = np.bincount(lr, minlength=n), np.bincount(lr[order][twice], minlength=n)
    upper, lower = count((buf > 64) & (buf < 91)), count((buf > 96) & (buf < 123))
    with np.errstate(all="ignore"):
        out[:] = np.array([count(~_PLAIN[buf]) / size, upper / (upper + lower), count((buf == 33) | (buf == 63)) / w, w, size / w, np.log(kinds) / np.log(w), again / lines, count(buf == 124) / w]).T
    out[~some] = np.nan
    return out


def votes(s: np.ndarray) -> np.ndarray:
    """-1 bad, 0 abstains, 1 good, of every labeller; nan abstains."""
    bad = np.array([s[:, 0] > 0.08, s[:, 1] > 0.5, s[:, 2] > 0.3, s[:, 3] < 2, (s[:, 4] < 1.5) | (s[:, 4] > 25), (s[:, 5] < 0.6) & (s[:, 3] > 20), s[:, 6] > 0.3, s[:, 7] > 0.3])
    good = np.array([s[:, 0] < 0.01, s[:, 1] < 0.15, s[:, 2] < 0.08, s[:, 3] > 20, (s[:, 4] > 2.5) & (s[:, 4] < 12), (s[:, 5] > 0.65), (s[:, 6] < 0.1), s[:, 7] < 0.02])
    return (good.astype(np.int8) - bad.astype(np.int8)).T


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashed byte trigrams, letter case kept, as square roots of their shares."""
    n = len(off) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    if len(buf) > 2:
        b = buf.astype(np.uint32)
        t = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(22)
        row = np.repeat(np.arange(n), np.diff(off))
        ok = row[:-2] == row[2:]
        c = np.bincount(row[:-2][ok] * BUCKETS + t[ok], minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:] = np.sqrt(c / np.maximum(c.sum(1, keepdims=True), 1))
    return out


def accuracies(patterns: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: (share of good, P(vote | class) as labeller x class x vote, posterior of good).

    Faults are of many kinds and a text seldom has two, so it starts from bad where any labeller votes bad, and from
    good where any votes good and none bad. As faults don't overlap, agreement alone would let the good class take in all
    faults but the commonest; so a labeller's false alarms are held to FALSE_ALARM, and what none calls bad stays good. A labeller that always abstains keeps even odds.
    """
    called = (patterns < 0).any(1)
    least = np.where(called, 0.0, np.where((patterns > 0).any(1), 0.9, 0.5))
    post = np.where(called, 0.1, least)
    share, table = 0.5, np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        w = np.stack([weight * (1 - post), weight * post])
        share = (w[1].sum() + 1) / (weight.sum() + 2)
        for v in (-1, 0, 1):
            table[:, :, v + 1] = ((patterns == v).T.astype(float) @ w.T) + 1
        table /= table.sum(2, keepdims=True)
        table[:, 1, 0] = np.minimum(table[:, 1, 0], FALSE_ALARM)
        table[:, 1] /= table[:, 1].sum(1, keepdims=True)
        logit = np.full(len(patterns), np.log(share / (1 - share)))
        for k in range(patterns.shape[1]):
            logit += np.log(table[k, 1, patterns[:, k] + 1] / table[k, 0, patterns[:, k] + 1])
        post = np.maximum(1 / (1 + np.exp(-np.clip(logit, -50, 50))), least)
    return float(share), table, post


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 2.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    v = w.copy()
    for _ in range(rounds):
        at = w + np.float32(0.9) * v
        g = x.T @ (1 / (1 + np.exp(-(x @ at))) - y) / np.float32(len(x)) + np.float32(decay) * at
        v = np.float32(0.9) * v - np.float32(rate) * g
        w = w + v
    return w.astype(np.float64)


def _pattern(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(len(LABELLERS)))


def score(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Every document with its quality: doc_id, pattern of votes, label (posterior of good), score, kept.

    docs: doc_id, text; other columns are left aside. Null, empty and blank texts have no votes but are scored
    (by the bias) like the others; repeated rows are judged one by one. The patterns of all documents are counted
    (at most 3 ** 8); the scorer is fitted on about `fit_rows` of them, chosen by a hash of the id. With none to
    fit on, scores are the labels.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in text_chunks(batch.column(0)):
                p, n = np.unique(_pattern(votes(statistics(buf, off))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(n, pa.int64())], ["pattern", "n"])

    counted = docs.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()  # at most 3 ** 8 rows
    pattern, n = counted["pattern"].to_numpy(np.int64), counted["n"].to_numpy(float)
    _, _, post = accuracies(pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1, n)
    label = dict(zip(pattern.tolist(), post.tolist(), strict=True))
    share = min(1.0, fit_rows / max(n.sum(), 1))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in text_chunks(batch.column(0)):
                y = [label[p] for p in _pattern(votes(statistics(buf, off))).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in features(buf, off)], pa.binary()), pa.array(y, pa.float64())], ["x", "y"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        w = fit(np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), BUCKETS), rows["y"].to_numpy())
        return pd.DataFrame({"w": [w.tolist()]})

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30))).select("text").mapInArrow(draw, "x binary, y double")
    got = materialise(drawn, "fit").withColumn("g", F.lit(0)).groupBy("g").applyInPandas(learn, "w array<double>").first()
    known = spark.sparkContext.broadcast((label, None if got is None else np.array(got[0])))  # a weight a bucket

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, w = known.value
        for batch in batches:
            for i, j, buf, off in text_chunks(batch.column(1)):
                p = _pattern(votes(statistics(buf, off)))
                y = np.array([label[k] for k in p.tolist()])
                s = y if w is None else 1 / (1 + np.exp(-(features(buf, off) @ w[:-1] + w[-1])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p, pa.int64()), pa.array(y), pa.array(s), pa.array(s >= KEEP)], ["doc_id", "pattern", "label", "score", "kept"])

    return docs.mapInArrow(judge, f"doc_id {kind}, pattern long, label double, score double, kept boolean")
