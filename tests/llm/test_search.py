"""Ranked search against scores of every document."""

import collections
import math
import random
import re

import numpy as np
import pytest

from orrerium.llm import search

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def by_hand(docs, items, k):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    full = [b for _, b in bags if b]
    n_docs, n_terms, df = len(full), sum(b.total() for b in full), collections.Counter(x for b in full for x in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 50 + (50 * b.total() * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * b[x]) // (1000 * b[x] + 20 * m)) for x in set(terms(text)) if b[x])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return collections.Counter(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocab = ["The", "the", "é", "ΣΑΣ", "x1", "don't", "a_b", "42"] + [f"w{k}" for k in range(60)]
    text = lambda: " ".join(vocab[min(int(rnd.expovariate(0.08)), len(vocab) - 1)] for _ in range(rnd.randrange(1, 40)))
    docs = [(k, text()) for k in range(n)]
    docs += [(n + k, docs[5][1]) for k in range(60)]  # ties
    docs += [(None, docs[5][1]), (3, docs[3][1]), (10**9, None), (10**9 + 1, ""), (10**9 + 2, " .-_ "), (10**9 + 3, "rare " + "the " * 200_000)]
    rnd.shuffle(docs)
    items = [(k, text()) for k in range(12)] + [(12, docs[5][1]), (12, docs[5][1]), (13, None), (14, ""), (15, "unheard"), (None, "rare é"), (16, "the")]
    return docs, items


@pytest.mark.parametrize(("run_docs", "k", "blocks"), [(40, 5, 1 << 20), (7, 70, 200)])
def test_ranks_are_those_of_all_documents(spark, monkeypatch, run_docs, k, blocks):
    plain = search.index
    monkeypatch.setattr(search, "index", lambda docs, vocabulary: plain(docs, vocabulary, run_docs))
    docs, items = corpus(1, 400)
    monkeypatch.setattr(search, "TABLE_TERMS", 40)
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = search.search(d, q, k, blocks).collect()
    assert collections.Counter(tuple(r) for r in got) == by_hand(docs, items, k)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in search.search(docs, items).collect()] == [("i", 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 20 * 100)))]


def test_few_leaves_are_opened():
    """The search of a run reads the leaves that can hold a result, and not all of them."""
    n = 4096
    impacts = np.where(np.arange(n) == 1234, 1000, 10).astype(np.int64)
    run = search.Run(np.stack([np.arange(n), np.zeros(n, np.int64)], 1), None, np.arange(1, n + 1), np.zeros(n, np.int32), impacts, np.zeros(1, np.int32))
    opened, read = [], run.begin

    class Counting:
        def __getitem__(self, at):
            opened.append(at)
            return read[at]

    run.begin = Counting()
    best = []
    run.search(np.zeros(1, np.int32), np.ones(1, np.int64), 1, best, 1)
    assert best == [(1000, 0, -1234)] and len(opened) == 1
