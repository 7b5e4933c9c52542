"""Near-duplicate embeddings: a small-world graph per shard, every shard of a label queried, exact
verification, and components by union.

Equal vectors of a label are one class, so copies cost one search. Shards hold a bounded number of
classes, so a label that a third of the rows bear is many shards; each pair of shards of a label is
one task (the blocks of one against the graph of the other).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrerium.llm.common import materialise
from orrerium.llm.components import components, forest
from orrerium.llm.hnsw import Graph

#: Classes of a shard; the first beam; queries of an audit, planted ones of a shard's audit, and the recall that both ask for.
SHARD_ROWS = 4096
BEAM = 32
AUDIT = 64
PLANTS = 1024
RECALL = 0.999
#: What the search's single precision may be off.
SLACK = 1e-4

_BLOB = "label {kind}, dim int, shard int, ids binary, weights binary, vectors binary, graph binary, beam int"


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in the directions of v's; scaled by their largest components first, so that no norm under- or overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def plant(base: np.ndarray, least: float, n: int = PLANTS) -> np.ndarray:
    """Unit vectors of cosine `least` to 1 to a row of base each: half of them lie towards another row, half anywhere."""
    rnd = np.random.default_rng(len(base))
    b = base[rnd.integers(len(base), size=n)]
    to = np.where(np.arange(n)[:, None] % 2, base[rnd.integers(len(base), size=n)], rnd.normal(size=b.shape))
    to = to - (to * b).sum(1, keepdims=True) * b
    long = np.linalg.norm(to, axis=1, keepdims=True)
    cos = rnd.uniform(min(least + SLACK, 1), 1, (n, 1))
    out = cos * b + np.sqrt(1 - cos**2) * np.where(long > 1e-9, to / np.maximum(long, 1e-9), 0)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def audited_beam(graph: Graph, own: np.ndarray, least: float, beam: int = BEAM, recall: float = RECALL) -> int:
    """The narrowest beam (of those doubled from `beam`) that finds `recall` of the links of planted queries.

    Every plant has a link, so no shard passes on an audit without any, however sparse the links of the other shards to it.
    """
    base = unit(own)
    if beam >= len(base):
        return beam
    plants = plant(base, least)
    truth = int((plants @ base.T >= least).sum())
    while beam < len(base):
        a, b = graph.within(plants.astype(np.float32), least - SLACK, beam)
        if (np.einsum("ad,ad->a", plants[a], base[b]) >= least).sum() >= recall * truth:
            break
        beam *= 2
    return beam


def search(graph: Graph, own: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of cosine >= least in double precision. Beams widen until an audit against a scan finds `recall`.

    The audit's queries may have no link at all, so `beam` is to be that of audited_beam().
    """
    rows, base = unit(queries), unit(own)
    q = rows.astype(np.float32)
    sample = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    truth = rows[sample] @ base.T >= least
    while True:
        a, b = graph.within(q, least - SLACK, beam)
        ok = np.einsum("ad,ad->a", rows[a], base[b]) >= least
        a, b = a[ok], b[ok]
        found = np.isin(a, sample).sum()
        if beam >= len(base) or found >= recall * truth.sum():
            return a, b
        beam *= 2


def near_vectors(vectors: DataFrame, least: float = 0.93, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every vector with its links and component: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding, label; other columns are left aside. Vectors of one label and one length are
    compared. Rows whose label, id or vector is null, whose vector is empty or zero or holds null or
    non-finite components link with nothing and are their own component. Repeated rows count as other vectors. Components
    may be as small or as large as doubles are.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), "label")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    fine &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("k1", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("v"))).withColumn("k2", F.xxhash64(F.lit(7), "v", "label"))
    kind = vectors.schema["label"].dataType.simpleString()
    classes = rows.where("k1 is not null").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min_by("v", "vec_id").alias("v"))
    classes = materialise(classes.withColumn("dim", F.size("v")), "vector-classes")
    counts = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("c")).select("label", "dim", F.ceil(F.col("c") / shard_rows).cast("int").alias("shards"))
    sharded = classes.join(materialise(counts, "labels"), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(group["v"].to_list()).astype(np.float64)
        graph = Graph.build(unit(v).astype(np.float32))
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "ids": [group["rep"].to_numpy(np.int64).tobytes()], "weights": [group["n"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()], "graph": [graph.dump()], "beam": [audited_beam(graph, v, least)]})

    graphs = materialise(sharded.select("label", "dim", "shard", "rep", "n", "v").groupBy("label", "dim", "shard").applyInPandas(build, _BLOB.format(kind=kind)), "graphs")
    other = graphs.select("label", "dim", F.col("shard").alias("q"), F.col("ids").alias("q_ids"), F.col("weights").alias("q_weights"), F.col("vectors").alias("q_vectors"))
    # Dealt out anew: grouping would else keep all pairs of a label where the join has put them.
    pairs = graphs.join(other, ["label", "dim"]).where("q >= shard").repartition("label", "dim", "shard", "q")

    def probe(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        r = group.iloc[0]
        ids, weights, qi, qw = (np.frombuffer(x, np.int64) for x in (r.ids, r.weights, r.q_ids, r.q_weights))
        own, queries = (np.frombuffer(x).reshape(-1, r.dim) for x in (r.vectors, r.q_vectors))
        a, b = search(Graph.load(r.graph), own, queries, least, int(r.beam))
        if r.q == r.shard:
            # Both ways of a pair, found by either.
            a, b = a[a != b], b[a != b]
            both = np.unique(np.concatenate([a * len(own) + b, b * len(own) + a]))
            a, b = both // len(own), both % len(own)
            links = [(ids, np.bincount(a, weights[b], minlength=len(own)))]
        else:
            links = [(qi, np.bincount(a, weights[b], minlength=len(qi))), (ids, np.bincount(b, qw[a], minlength=len(ids)))]
        out = [(i, None, int(c)) for who, n in links for i, c in zip(who.tolist(), n.tolist(), strict=True) if c]
        out += [(i, j, 0) for i, j in zip(*(x.tolist() for x in forest(qi[a], ids[b])), strict=True)]
        return pd.DataFrame(out, columns=["id", "low", "n"]).astype({"id": "Int64", "low": "Int64", "n": "int64"})

    found = materialise(pairs.groupBy("label", "dim", "shard", "q").applyInPandas(probe, "id long, low long, n long"), "vector-links")
    linked = found.where("low is null").groupBy("id").agg(F.sum("n").alias("others"))
    roots = components(found.where("low is not null").select("id", "low"))
    top = classes.select("label", "k1", "k2", "rep", "n").join(linked.withColumnRenamed("id", "rep"), "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    top = materialise(top.select("label", "k1", "k2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-tops")
    # A null key never joins: such rows go past the join.
    joined = rows.where("k1 is not null").select("vec_id", "label", "k1", "k2").join(top, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

