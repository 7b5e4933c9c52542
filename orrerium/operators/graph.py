"""Graphs as edge tables (config_id, source, target), undirected and simple."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrerium.sources.tables import written

KEY = "config_id"


def simple(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, no loops."""
    return edges.where("source <> target").select(KEY, F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(KEY, "source", "target").unionByName(edges.select(KEY, F.col("target").alias("source"), F.col("source").alias("target")))


def signatures(membership: DataFrame, sums: Sequence[str] = (), used: str = "true", id_column: str = "row_index") -> DataFrame:
    """config_id, nodes, n, n_used, sum_<column>: rows by the set of nodes they stand in, each row once.

    What nodes share, and sums over unions of nodes, follow from this table alone, and its size follows the overlaps of
    the cover: one shuffle of the members serves them all. Sums and n_used are over rows that pass `used`; its value and the columns
    are the row's own, equal in all of its nodes.
    """
    kept = F.coalesce(F.expr(used), F.lit(False))
    rows = membership.groupBy(KEY, id_column).agg(F.sort_array(F.collect_set("node_id")).alias("nodes"), F.max(kept).alias("used"), *[F.max(F.when(kept, F.col(c))).alias(c) for c in sums])
    return rows.groupBy(KEY, "nodes").agg(F.count(F.lit(1)).alias("n"), F.count_if("used").alias("n_used"), *[F.sum(c).alias(f"sum_{c}") for c in sums])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """config_id, node_id, component_id: the least node of its component. Least labels spread, and pointers are halved each round."""
    near = written(both_ways(simple(edges)), "graph-edges")
    labels = written(nodes.select(KEY, "node_id").distinct().withColumn("component_id", F.col("node_id")), "graph-labels")
    while True:
        seen = near.join(labels.select(KEY, F.col("node_id").alias("target"), F.col("component_id").alias("c")), [KEY, "target"]).groupBy(KEY, F.col("source").alias("node_id")).agg(F.min("c").alias("c"))
        step = labels.join(seen, [KEY, "node_id"], "left").select(KEY, "node_id", F.least("component_id", "c").alias("component_id"), F.col("component_id").alias("old"))
        step = written(step, "graph-step")
        jump = step.select(KEY, F.col("node_id").alias("component_id"), F.col("component_id").alias("j"))
        new = written(step.join(jump, [KEY, "component_id"], "left").select(KEY, "node_id", F.least("component_id", "j").alias("component_id"), "old"), "graph-labels")
        if not new.where("component_id <> old").limit(1).count():
            return new.drop("old")
        labels = new.drop("old")


def component_stats(nodes: DataFrame, edges: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """config_id, component_id, n_nodes, n_edges, beta_1."""
    comps = comps if comps is not None else components(nodes, edges)
    e = simple(edges).join(comps.withColumnRenamed("node_id", "source"), [KEY, "source"]).groupBy(KEY, "component_id").agg(F.count(F.lit(1)).alias("n_edges"))
    out = comps.groupBy(KEY, "component_id").agg(F.count(F.lit(1)).alias("n_nodes")).join(e, [KEY, "component_id"], "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return out.withColumn("beta_1", F.greatest(F.col("n_edges") - F.col("n_nodes") + 1, F.lit(0)))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """config_id, node_id, degree, triangles, clustering. Triangles are counted from the end of lesser degree."""
    e = simple(edges)
    degree = both_ways(e).groupBy(KEY, F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    rank = degree.withColumn("r", F.struct("degree", "node_id"))
    e = e.join(rank.select(KEY, F.col("node_id").alias("source"), F.col("r").alias("rs")), [KEY, "source"]).join(rank.select(KEY, F.col("node_id").alias("target"), F.col("r").alias("rt")), [KEY, "target"])
    out = e.select(KEY, F.when(F.col("rs") < F.col("rt"), F.col("source")).otherwise(F.col("target")).alias("a"), F.when(F.col("rs") < F.col("rt"), F.col("target")).otherwise(F.col("source")).alias("b"), F.greatest("rs", "rt").alias("rb"))
    wedges = out.alias("x").join(out.alias("y"), [F.col(f"x.{KEY}") == F.col(f"y.{KEY}"), F.col("x.a") == F.col("y.a"), F.col("x.rb") < F.col("y.rb")]).select(F.col(f"x.{KEY}").alias(KEY), F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    closed = wedges.join(out.select(KEY, F.col("a").alias("b"), F.col("b").alias("c")), [KEY, "b", "c"])
    t = closed.select(KEY, F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy(KEY, "node_id").agg(F.count(F.lit(1)).alias("triangles"))
    out = nodes.select(KEY, "node_id").distinct().join(degree, [KEY, "node_id"], "left").join(t, [KEY, "node_id"], "left").na.fill(0, ["degree", "triangles"])
    return out.withColumn("clustering", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each configuration: nodes, edges, beta_0, beta_1, density, degrees, clustering, isolates, largest component."""
    comps = components(nodes, edges)
    per_node = clustering(nodes, edges)
    d, t = F.col("degree"), F.col("triangles")
    node = per_node.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(d).alias("_d"), F.avg(d).alias("average_degree"), F.max(d).alias("max_degree"), F.avg("clustering").alias("average_clustering"), F.count_if(d == 0).alias("n_isolates"), F.try_divide(2.0 * F.sum(t), F.sum(d * (d - 1))).alias("_t"))
    comp = comps.groupBy(KEY, "component_id").agg(F.count(F.lit(1)).alias("n")).groupBy(KEY).agg(F.count(F.lit(1)).alias("beta_0"), F.max("n").alias("largest_component"))
    out = node.join(comp, KEY).withColumn("n_edges", (F.col("_d") / 2).cast("long"))
    n = F.col("n_nodes")
    return out.select(KEY, "n_nodes", "n_edges", "beta_0", (F.col("n_edges") - n + F.col("beta_0")).alias("beta_1"), F.coalesce(F.try_divide(2.0 * F.col("n_edges"), n * (n - 1)), F.lit(0.0)).alias("density"), "average_degree", "max_degree", "average_clustering", F.coalesce("_t", F.lit(0.0)).alias("transitivity"), "n_isolates", "largest_component")


def neighbourhoods(edges: DataFrame) -> DataFrame:
    """config_id, node_id, neighbour, ring: 1 for neighbours, 2 for theirs that are neither."""
    near = both_ways(simple(edges)).select(KEY, F.col("source").alias("node_id"), F.col("target").alias("neighbour"))
    far = near.select(KEY, "node_id", F.col("neighbour").alias("mid")).join(near.select(KEY, F.col("node_id").alias("mid"), "neighbour"), [KEY, "mid"]).where("node_id <> neighbour").select(KEY, "node_id", "neighbour").distinct()
    far = far.join(near, [KEY, "node_id", "neighbour"], "left_anti")
    return near.withColumn("ring", F.lit(1)).unionByName(far.withColumn("ring", F.lit(2)))


#: Sources whose shortest paths a task counts.
SOURCES = 256


def _paths_from(s: int, begin: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance of every node from s, -1 if there is none; share of the shortest paths from s that each node lies within)."""
    n = len(begin) - 1
    dist, paths, owed = np.full(n, -1), np.zeros(n), np.zeros(n)
    dist[s], paths[s] = 0, 1.0
    front, steps = np.array([s]), []
    while len(front):
        degree = begin[front + 1] - begin[front]
        tail = np.repeat(front, degree)
        head = to[np.repeat(begin[front] - np.concatenate([[0], np.cumsum(degree)[:-1]]), degree) + np.arange(degree.sum())]
        on = dist[head] < 0
        tail, head = tail[on], head[on]
        front = np.unique(head)
        dist[front] = dist[tail[0]] + 1 if len(tail) else 0
        np.add.at(paths, head, paths[tail])
        steps.append((tail, head))
    for tail, head in reversed(steps):
        np.add.at(owed, tail, paths[tail] / paths[head] * (1 + owed[head]))
    owed[s] = 0.0
    return dist, owed


def centrality(nodes: DataFrame, edges: DataFrame, sources: int = SOURCES) -> DataFrame:
    """Betweenness, closeness, eccentricity (in its component) and articulation of every node.

    A configuration's graph is packed as compressed rows, which go to the tasks of its batches of sources; each adds up the
    shortest paths from its own, and sums are added by node. A task holds a graph (its edges, which follow the cover and not the
    data) and a few numbers a node.
    """
    rows = nodes.select(KEY, F.col("node_id").cast("string").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(simple(edges).select(KEY, F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b")))
    kind = nodes.schema[KEY].dataType.simpleString()

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["a"].to_numpy(object), rows["b"].to_numpy(object)
        there = np.array([x is not None for x in b], bool)
        ids = np.array(sorted({*a.tolist(), *b[there].tolist()}), object)
        at = {x: k for k, x in enumerate(ids)}
        one, two = np.array([at[x] for x in a[there]], np.int64), np.array([at[x] for x in b[there]], np.int64)
        tail, head = np.concatenate([one, two]), np.concatenate([two, one])
        order = np.lexsort((head, tail))
        begin = np.searchsorted(tail[order], np.arange(len(ids) + 1))
        return pd.DataFrame({KEY: [key[0]], "n": [len(ids)], "ids": [ids.tolist()], "begin": [begin.astype(np.int64).tobytes()], "to": [head[order].tobytes()]})

    packed = written(rows.groupBy(KEY).applyInPandas(pack, f"{KEY} {kind}, n long, ids array<string>, begin binary, to binary"), "graphs")
    batches = packed.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(sources).cast("long")))).repartition(KEY, "first")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for part in parts for r in part.itertuples()):
            begin, to, ids = np.frombuffer(r.begin, np.int64), np.frombuffer(r.to, np.int64), np.array(list(r.ids), object)
            total, close, far = np.zeros(r.n), np.full(r.n, np.nan), np.zeros(r.n, np.int64)
            for s in range(r.first, min(r.first + sources, r.n)):
                dist, owed = _paths_from(s, begin, to)
                total += owed
                reach, length = (dist > 0).sum(), dist[dist > 0].sum()
                close[s] = (reach / length) * (reach / (r.n - 1)) if length else 0.0
                far[s] = dist.max()
            cut = np.zeros(r.n, bool)
            if not r.first:
                cut[list(_cut_nodes({v: to[begin[v] : begin[v + 1]].tolist() for v in range(r.n)}))] = True
            pairs = (r.n - 1) * (r.n - 2)
            yield pd.DataFrame({KEY: r.config_id, "node_id": ids, "betweenness": total / pairs if pairs else total * 0, "closeness": close, "eccentricity": far, "cut": cut})

    out = batches.mapInPandas(run, f"{KEY} {kind}, node_id string, betweenness double, closeness double, eccentricity long, cut boolean")
    near = F.max(F.when(~F.isnan("closeness"), F.col("closeness")))
    return out.groupBy(KEY, "node_id").agg(F.sum("betweenness").alias("betweenness"), near.alias("closeness"), F.max("eccentricity").alias("eccentricity"), F.max("cut").alias("is_articulation"))


def _cut_nodes(near: dict[int, list[int]]) -> set[int]:
    """Nodes whose removal splits their component (depth first, without recursion)."""
    seen: dict[int, int] = {}
    low: dict[int, int] = {}
    cut: set[int] = set()
    for root in near:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        stack, branches = [(root, None, iter(near[root]))], 0
        while stack:
            v, parent, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[v])
                    if p != root and low[v] >= seen[p]:
                        cut.add(p)
            elif w not in seen:
                seen[w] = low[w] = len(seen)
                branches += v == root
                stack.append((w, v, iter(near[w])))
            elif w != parent:
                low[v] = min(low[v], seen[w])
        if branches > 1:
            cut.add(root)
    return cut
