"""Repeats, near copies and vectors against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrerium.llm import bwt, ngram_join, repeats
from orrerium.llm.components import components
from orrerium.llm.hnsw import Graph
from orrerium.llm.near_vectors import audited_beam, near_vectors, search

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats_by_hand(rows, k):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(t[i : i + k] for _, t in texts for i in range(len(t) - k + 1))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - k + 1):
            if seen[t[i : i + k]] > 1:
                gone[i : i + k] = [True] * k
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages():
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcdé ") for _ in range(600))
    rows = [(d, base[(i := rnd.randrange(500)) : i + rnd.randrange(100)] + "".join(rnd.choice("ab") for _ in range(rnd.randrange(60))) + base[rnd.randrange(300) :][: rnd.randrange(200)]) for d in range(40)]
    return [*rows, (100, None), (101, ""), (102, "a" * 45), (103, base), (104, base), (104, base)]


@pytest.mark.parametrize(("k", "hot"), [(5, 256), (12, 256), (12, 3), (41, 256)])
def test_repeats_are_those_of_brute_force(spark, monkeypatch, k, hot):
    monkeypatch.setattr(repeats, "HOT_HULLS", hot)
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("chunk", F.lit("x"))
    got = sorted(tuple(r)[:5] for r in repeats.remove_repeats(df, k).collect())
    assert got == repeats_by_hand(rows, k)


def test_repeats_of_production_length(spark):
    rnd = random.Random(7)
    base = "".join(rnd.choice("abcdefgh é") for _ in range(3000))
    rows = [(d, "".join(rnd.choice("ab ") for _ in range(rnd.randrange(300))) + base[(i := rnd.randrange(2500)) : i + rnd.randrange(300, 700)] + "".join(rnd.choice("cd ") for _ in range(rnd.randrange(300)))) for d in range(60)]
    rows += [(100, "x" * 900), (101, base[:399]), (102, base), (103, base[:2000] + "!" + base[2000:])]
    got = sorted(tuple(r)[:5] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect())
    assert got == repeats_by_hand(rows, 400)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merged_transforms_are_the_order_of_all_suffixes():
    rnd = random.Random(5)
    strings = [[rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 12))] for _ in range(30)]
    shards, where = [], []
    for part in (strings[:7], strings[7:20], strings[20:]):
        s = bwt.Shard.build(np.array([x for t in part for x in t]), np.array([len(t) for t in part]), 16)
        shards.append(s)
        closed = [[*t, 0] for t in part]
        flat = [(t, i) for t in closed for i in range(len(t))]
        where += [flat[a] for a in s.at]
    depth = 6
    order, common = bwt.merge(shards, depth)
    keys = [tuple((t[i:] + t * depth)[:depth]) for t, i in (where[k] for k in order)]
    assert keys == sorted(keys)
    for j in range(1, len(keys)):
        same = next((n for n in range(depth) if keys[j][n] != keys[j - 1][n]), depth)
        assert common[j] == same


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(1000, 1000), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def near_texts():
    rnd = random.Random(7)
    vocab = [f"w{k}" for k in range(300)]
    rows = []
    for f in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(2, 120))]
        for _ in range(rnd.randrange(1, 6)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    n = len(rows)
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, rows[0][1].upper()), (n + 7, rows[0][1])]


def joined_by_hand(rows, n, p, q):
    sets = {}
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(UPPER)) if x]
        sets[d] = {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()
    low = {d: d for d in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            low[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in sets)


@pytest.mark.parametrize(("n", "p", "q", "block"), [(3, 90, 100, 4000), (5, 80, 100, 4000), (3, 80, 100, 2)])
def test_ngram_join_is_that_of_all_pairs(spark, monkeypatch, n, p, q, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    if block < 100:  # hot keys, too
        monkeypatch.setattr(ngram_join, "FEW", 2)
        monkeypatch.setattr(ngram_join, "HOT_KEY", 2)
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("low", F.lit(2))
    assert sorted(tuple(r) for r in ngram_join.ngram_join(df, n, p, q).collect()) == joined_by_hand(rows, n, p, q)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_meet_for_every_similar_pair():
    rng = np.random.default_rng(0)
    level = rng.integers(0, 40, 1 << ngram_join.SKETCH_BITS).astype(np.uint8)
    level[rng.integers(0, len(level), len(level) // 3)] = 8 * 15
    for p, q in ((90, 100), (80, 100)):
        for _ in range(60):
            size = int(rng.integers(1, 200))
            a = rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2)
            differ = int(size * (q - p) / (q + p))
            b = np.concatenate([a[differ // 2 :], rng.integers(0, 2**63, differ - differ // 2).astype(np.uint64) * np.uint64(2)])
            both = len(np.intersect1d(a, b))
            if q * both < p * (len(a) + len(b) - both):
                continue
            row = np.repeat([0, 1], [len(a), len(b)])
            who, key = ngram_join.keys(row, np.concatenate([a, b]), np.array([len(a), len(b)]), np.array([5, 6]), level, p, q)
            assert set(key[who == 0].tolist()) & set(key[who == 1].tolist())


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 9, (40, ngram_join.DIMENSIONS))
    point = np.maximum(0, base[rng.integers(0, 40, 3000)] + rng.integers(-1, 2, (3000, ngram_join.DIMENSIONS))).astype(np.int32)
    size = point.sum(1)
    tree = ngram_join.Tree(point, size)
    assert len(tree.levels) == 3
    for k in range(0, 3000, 100):
        scan = np.flatnonzero(ngram_join.alike(point, size, point[k], size[k], 80, 100))
        assert sorted(tree.search(point[k], int(size[k]), 80, 100).tolist()) == scan.tolist()


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    rows = [(k, (base[k % 20] + rng.normal(size=16) * 0.15).tolist(), k % 3) for k in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], None), (203, [0.0] * 16, 0), (204, None, 0), (205, [float("nan")] * 16, 0), (206, [1.0, None], 0), (207, [], 0), (208, rows[0][1][:8], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)), shard_rows=16).collect()}
    good = {i: (np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    near = {i: [j for j, (b, lb) in good.items() if j != i and la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93] for i, (a, la) in good.items()}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(near.get(i, [])), min(seen), i == min(seen))


def test_graph_survives_its_dump():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph.load(Graph.build(x).dump())
    a, b = g.within(x, 0.9, 32)
    want = np.argwhere(x @ x.T >= 0.9)
    assert len(set(zip(a.tolist(), b.tolist(), strict=True)) & {tuple(w) for w in want.tolist()}) >= 0.99 * len(want)


def test_beams_widen_where_sampled_queries_have_no_links():
    class Narrow:
        """Finds nothing below a beam of 256."""

        def __init__(self, x):
            self.x = x

        def within(self, q, least, beam):
            a, b = np.nonzero(q @ self.x.T >= least)
            return (a, b) if beam >= 256 else (a[:0], b[:0])

    rnd = np.random.default_rng(9)
    own, queries = rnd.normal(size=(1000, 32)), rnd.normal(size=(2000, 32))
    queries[701] = own[5] + 0.01 * rnd.normal(size=32)
    graph = Narrow((own / np.linalg.norm(own, axis=1, keepdims=True)).astype(np.float32))
    beam = audited_beam(graph, own, 0.93)
    a, b = search(graph, own, queries, 0.93, beam)
    assert beam == 256 and (a.tolist(), b.tolist()) == ([701], [5])


def test_vectors_of_any_magnitude(spark):
    """Cosines of tiny and huge vectors, against exact fractions."""
    from fractions import Fraction

    rnd = random.Random(4)
    base = [[1.0] * 8, [1.0, 0.01, 0, 0, 0, 0, 0, 0], [rnd.gauss(0, 1) for _ in range(8)]]
    vectors = [[x * scale * (1 + rnd.uniform(-0.2, 0.2)) for x in b] for b in base for scale in (1e-300, 1e-200, 1.0, 1e200, 1e300) for _ in range(2)] + [[1e300, 1e-300] + [0.0] * 6, [5e-324] * 8]
    rows = list(enumerate(vectors))

    def linked(a, b):
        a, b = [Fraction(x) for x in a], [Fraction(x) for x in b]
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        return dot > 0 and dot * dot >= Fraction(0.93) ** 2 * sum(x * x for x in a) * sum(x * x for x in b)

    want = {i: sum(linked(a, b) for j, b in rows if j != i) for i, a in rows}
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, label string")).collect()}
    assert got == want
    none = near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label string"))
    assert none.count() == 0


def test_keys_that_sets_share_by_chance_go_nowhere():
    """A key sends two sets on only if it can be the first that they share: their sizes, and what is left of both, allow the overlap."""

    def sent(*sets):
        size, place = (np.array(x) for x in zip(*sets, strict=True))
        columns = {"keys": np.full(len(sets), 7, np.uint64).tobytes(), "names": np.arange(len(sets)).tobytes(), "sizes": ngram_join.planes(size), "places": ngram_join.planes(place)}
        return sorted(ngram_join.shared(pa.table({"bucket": pa.array([0], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in columns.items()}}), 80, 100).column("name").to_pylist())

    assert sent((100, 3), (100, 11)) == [0, 1]
    assert sent((100, 3), (100, 12)) == sent((100, 0), (79, 0)) == sent((100, 0)) == []
    assert sent((100, 0), (60, 0), (81, 0)) == [0, 2]
    assert sent(*[(100, 20)] * 20, (70, 0)) == list(range(20))


def test_first_shared_keys_of_similar_sets_are_sent():
    rng = np.random.default_rng(1)
    level = rng.integers(0, 40, 1 << ngram_join.SKETCH_BITS).astype(np.uint8)
    for k in range(200):
        p, size = (90, 80)[k % 2], int(rng.integers(1, 200))
        fresh = rng.integers(0, 2**63, 2 * size).astype(np.uint64) * np.uint64(2)
        differ = int(size * (100 - p) / (100 + p))
        a, b = fresh[:size], np.concatenate([fresh[differ // 2 : size], fresh[size : size + differ - differ // 2]])
        both = len(np.intersect1d(a, b))
        if 100 * both < p * (len(a) + len(b) - both):
            continue
        sizes, names = np.array([len(a), len(b)]), np.array([5, 6])
        who, key, place = ngram_join.placed_keys(np.repeat([0, 1], sizes), np.concatenate([a, b]), sizes, names, level, p, 100)
        columns = {"keys": key.tobytes(), "names": names[who].tobytes(), "sizes": ngram_join.planes(sizes[who]), "places": ngram_join.planes(place)}
        got = ngram_join.shared(pa.table({"bucket": pa.array([0], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in columns.items()}}), p, 100)
        held = [set(np.frombuffer(x, np.uint64).tolist()) for x in got.column("keys").to_pylist()]
        assert len(held) == 2 and held[0] & held[1]
