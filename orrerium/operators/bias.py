"""How far a graph's composition follows the way that its members were found: audits and label permutations.

Membership: config_id, node_id, row_index and a label column. A member may stand in several nodes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrerium.functions import stats
from orrerium.functions.numeric import ratio
from orrerium.operators.graph import both_ways, simple
from orrerium.sources.tables import written

#: A node is peripheral with at most this degree, or in a component of at most so many nodes.
PERIPHERAL_DEGREE, PERIPHERAL_NODES = 1, 3


def crosstab(membership: DataFrame, label: str, labels: list[str] | None = None) -> DataFrame:
    """A row for each node and a column of counts for each label."""
    keyed = membership.groupBy("config_id", "node_id")
    return (keyed.pivot(label, labels) if labels else keyed.pivot(label)).count().na.fill(0)


def node_metrics(membership: DataFrame, label: str, universe: int | None = None) -> DataFrame:
    """Per node: members, top label, purity, entropy (nats) and its share of the greatest possible (null for one label in all)."""
    size = membership.groupBy("config_id", "node_id").agg(F.count(F.lit(1)).alias("n_members"))
    out = size.join(stats.summary(membership, ["config_id", "node_id"], label), ["config_id", "node_id"], "left")
    if universe is None:
        kinds = membership.where(F.col(label).isNotNull()).groupBy("config_id").agg(F.count_distinct(label).alias("_k"))
        out = out.join(F.broadcast(kinds), "config_id", "left")
    else:
        out = out.withColumn("_k", F.lit(universe))
    return out.withColumn("entropy_norm", F.when(F.col("_k") > 1, F.col("entropy") / F.log(F.col("_k").cast("double")))).drop("_k")


def peripheral(nodes: DataFrame, degrees: DataFrame, comps: DataFrame) -> DataFrame:
    """is_peripheral by degree and size of component."""
    size = comps.groupBy("config_id", "component_id").agg(F.count(F.lit(1)).alias("component_size"))
    known = comps.join(size, ["config_id", "component_id"]).join(degrees.select("config_id", "node_id", "degree"), ["config_id", "node_id"], "left")
    out = nodes.join(known, ["config_id", "node_id"], "left").na.fill({"degree": 0})
    return out.withColumn("is_peripheral", (F.col("degree") <= PERIPHERAL_DEGREE) | (F.coalesce("component_size", F.lit(1)) <= PERIPHERAL_NODES))


def central_and_peripheral(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("config_id", "is_peripheral").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("purity").alias("mean_purity"), F.avg("entropy").alias("mean_entropy"), F.sum("n_members").alias("n_members"))


def global_bias(membership: DataFrame, label: str) -> DataFrame:
    """A row for each configuration: size-weighted purity and entropy of its nodes."""
    n = node_metrics(membership, label)
    w = F.col("n_labelled")
    return n.groupBy("config_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(w).alias("n_memberships"), F.try_divide(F.sum(w * F.col("purity")), F.sum(w)).alias("weighted_purity"), F.try_divide(F.sum(w * F.col("entropy")), F.sum(w)).alias("weighted_entropy"))


def hard_assignment(membership: DataFrame) -> DataFrame:
    """Each member's largest node, ties to the lesser id."""
    size = membership.groupBy("config_id", "node_id").agg(F.count(F.lit(1)).alias("_n"))
    best = membership.join(size, ["config_id", "node_id"]).groupBy("config_id", "row_index").agg(F.min_by("node_id", F.struct(-F.col("_n"), F.col("node_id"))).alias("node_id"))
    return best


def divergence(membership: DataFrame, label: str) -> DataFrame:
    """Each node's composition against its configuration's: Jensen-Shannon and Kullback-Leibler divergence in bits."""
    local = stats.composition(membership, ["config_id", "node_id"], label).select("config_id", "node_id", label, F.col("share").alias("p"))
    whole = stats.composition(membership.select("config_id", "row_index", label).distinct(), ["config_id"], label).select("config_id", label, F.col("share").alias("q"))
    nodes = local.select("config_id", "node_id").distinct()
    every = nodes.join(whole, "config_id").join(local, ["config_id", "node_id", label], "left")
    return every.groupBy("config_id", "node_id").agg(stats.js_divergence(F.col("p"), F.col("q")).alias("js_bits"), stats.kl_divergence(F.col("p"), F.col("q")).alias("kl_bits"))


def years(membership: DataFrame, year: str) -> DataFrame:
    """Median and interquartile range of a year by node."""
    q = F.percentile(F.col(year).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return membership.groupBy("config_id", "node_id").agg(q[1].alias("median_year"), (q[2] - q[0]).alias("iqr_year"))


def component_summary(membership: DataFrame, comps: DataFrame, label: str) -> DataFrame:
    """Composition of each component over its distinct members."""
    members = membership.join(comps, ["config_id", "node_id"]).select("config_id", "component_id", "row_index", label).distinct()
    size = members.groupBy("config_id", "component_id").agg(F.count_distinct("row_index").alias("n_members"))
    return size.join(stats.summary(members, ["config_id", "component_id"], label), ["config_id", "component_id"], "left")


#: Counts (entries of node and signature, by label and draw) that a task holds at a time; members that numpy's draws allow.
DRAW_CELLS, MOST_MEMBERS = 4_000_000, 10**9


def signatures(membership: DataFrame, label: str) -> DataFrame:
    """config_id, nodes, label, n: labelled members by the set of nodes they stand in, which is all that dealing labels out needs.

    Rows follow the overlaps of the cover, whatever the number of members. A member has one label; of several, the first in order.
    """
    members = membership.where(F.col(label).isNotNull()).groupBy("config_id", "row_index").agg(F.sort_array(F.collect_set("node_id")).alias("nodes"), F.min(label).alias("label"))
    return members.groupBy("config_id", "nodes", "label").agg(F.count(F.lit(1)).alias("n"))


class Urn:
    """One configuration: signatures with their members, labels with theirs, and which nodes a signature stands in."""

    def __init__(self, table: pd.DataFrame, edges: pd.DataFrame | None):
        keys = [tuple(x) for x in table["nodes"]]
        sets = sorted(set(keys))
        self.labels = np.array(sorted(set(table["label"])), object)
        self.nodes = np.array(sorted({x for s in sets for x in s}), object)
        at, node = {s: k for k, s in enumerate(sets)}, {x: k for k, x in enumerate(self.nodes)}
        self.observed = np.zeros((len(sets), len(self.labels)), np.int64)
        np.add.at(self.observed, ([at[s] for s in keys], np.searchsorted(self.labels, table["label"].to_numpy(object))), table["n"].to_numpy())
        self.sizes, self.totals = self.observed.sum(1), self.observed.sum(0)
        if self.totals.sum() >= MOST_MEMBERS:
            raise ValueError(f"a configuration of {self.totals.sum()} labelled members is more than one urn deals out")
        entry = sorted((node[x], k) for k, s in enumerate(sets) for x in s)
        self.entry = np.array([k for _, k in entry])
        self.begin = np.searchsorted([x for x, _ in entry], np.arange(len(self.nodes)))
        pairs = [(node[a], node[b]) for a, b in zip(edges["source"], edges["target"], strict=True) if a in node and b in node] if edges is not None else []
        self.edges = np.array(pairs, np.int64).reshape(-1, 2)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """n tables of signatures by labels with the margins of the observed one, as dealing out the labels to members gives them.

        Signature by signature and label by label, each count is hypergeometric given those before it.
        """
        left = np.repeat(self.totals[None], n, 0)
        out = np.zeros((n, *self.observed.shape), np.int32)
        for s, size in enumerate(self.sizes.tolist()):
            want = np.full(n, size)
            rest = left.sum(1)
            for k in range(len(self.labels)):
                rest -= left[:, k]
                out[:, s, k] = got = rng.hypergeometric(left[:, k], rest, want)
                want -= got
            left -= out[:, s]
        return out

    def counts(self, tables: np.ndarray) -> np.ndarray:
        """Draw by node by label."""
        return np.add.reduceat(tables[:, self.entry], self.begin, axis=1, dtype=np.int64)

    def metrics(self, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Purity, entropy, NMI and assortativity of each draw, as global_metrics() states them."""
        def nlogn(x: np.ndarray) -> np.ndarray:
            return x * np.log(np.maximum(x, 1))

        m, c, t = counts.sum(2), counts.sum(1), counts.sum((1, 2))
        inner = nlogn(counts).sum(2)
        out = {"weighted_purity": counts.max(2).sum(1) / t, "weighted_entropy": (nlogn(m) - inner).sum(1) / t}
        ha, hb = np.log(t) - nlogn(m).sum(1) / t, np.log(t) - nlogn(c).sum(1) / t
        mi = (inner.sum(1) - nlogn(m).sum(1) - nlogn(c).sum(1)) / t + np.log(t)
        mean = (ha + hb) / 2
        out["node_method_nmi"] = np.where(mean <= 0, 1.0, np.maximum(mi / np.where(mean <= 0, 1, mean), 0))
        if len(self.edges):
            top = counts.argmax(2)  # the first of equal counts, by label
            la, lb = top[:, self.edges[:, 0]], top[:, self.edges[:, 1]]
            margin = (la[:, :, None] == np.arange(len(self.labels))).sum(1)
            ab = (margin.astype(float) ** 2).sum(1) / len(self.edges) ** 2
            same = (la == lb).mean(1)
            out["dominant_method_assortativity"] = np.where(ab < 1, (same - ab) / np.where(ab < 1, 1 - ab, 1), np.nan)
        return out


def _urns(membership: DataFrame, label: str, edges: DataFrame | None) -> DataFrame:
    """config_id, urn, cells: an urn for each configuration; what makes it follows the graph and not its members."""
    table = signatures(membership, label)
    kind = dict(membership.dtypes)["config_id"]
    schema = f"config_id {kind}, urn binary, cells long"

    def pack(config: object, table: pd.DataFrame, edges: pd.DataFrame | None) -> pd.DataFrame:
        if not len(table):
            return pd.DataFrame({"config_id": [], "urn": [], "cells": []})
        urn = Urn(table, edges)
        return pd.DataFrame({"config_id": [config], "urn": [pickle.dumps(urn)], "cells": [len(urn.entry) * len(urn.labels)]})

    if edges is None:
        return written(table.groupBy("config_id").applyInPandas(lambda key, t: pack(key[0], t, None), schema), "urns")
    links = both_ways(simple(edges)).select(F.col("config_id").alias("linked"), "source", "target")
    return written(table.groupBy("config_id").cogroup(links.groupBy("linked")).applyInPandas(lambda key, t, e: pack(key[0], t, e), schema), "urns")


def _dealt(urns: DataFrame, n: int, seed: int) -> DataFrame:
    """config_id, urn, first, last: the draws of each configuration in blocks of bounded size, dealt out."""
    per = F.greatest(F.lit(1), F.least(F.lit(n), F.floor(F.lit(DRAW_CELLS) / F.col("cells")))).cast("int")
    blocks = urns.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n - 1), per))).withColumn("last", F.least(F.col("first") + per, F.lit(n)))
    return blocks.withColumn("seed", F.xxhash64(F.lit(seed), F.col("config_id").cast("string"), "first")).drop("cells").repartition("config_id", "first")


def draws(membership: DataFrame, label: str, n: int = 1000, seed: int = 42, edges: DataFrame | None = None) -> DataFrame:
    """config_id, perm_id, metric, null: metrics of n deals of the labels among the members (not among memberships).

    A draw deals out a table of signatures by labels, so that its cost follows the graph, however many members there are.
    """
    urns = _urns(membership, label, edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for batch in batches for r in batch.itertuples()):
            urn = pickle.loads(r.urn)
            got = urn.metrics(urn.counts(urn.draw(np.random.default_rng(r.seed & (2**63 - 1)), r.last - r.first)))
            for metric, value in got.items():
                yield pd.DataFrame({"config_id": r.config_id, "perm_id": np.arange(r.first, r.last), "metric": metric, "null": value})

    drawn = _dealt(urns, n, seed).mapInPandas(run, f"config_id {dict(membership.dtypes)['config_id']}, perm_id int, metric string, `null` double")
    return drawn.withColumn("null", F.when(~F.isnan("null"), F.col("null")))


def drawn_counts(membership: DataFrame, label: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """config_id, node_id, label, s, s2, over: sums over the draws of each node's count of a label that it has, of its square, and
    the draws in which it is as large as observed."""
    kinds = dict(membership.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for batch in batches for r in batch.itertuples()):
            urn = pickle.loads(r.urn)
            seen = urn.counts(urn.observed[None])[0]
            got = urn.counts(urn.draw(np.random.default_rng(r.seed & (2**63 - 1)), r.last - r.first))
            node, k = np.nonzero(seen)
            got = got[:, node, k]
            yield pd.DataFrame({"config_id": r.config_id, "node_id": urn.nodes[node], "label": urn.labels[k], "s": got.sum(0), "s2": (got * got).sum(0), "over": (got >= seen[node, k]).sum(0)})

    parts = _dealt(_urns(membership, label, None), n, seed).mapInPandas(run, f"config_id {kinds['config_id']}, node_id {kinds['node_id']}, label {kinds[label]}, s long, s2 long, over long")
    return parts.groupBy("config_id", "node_id", F.col("label").alias(label)).agg(*[F.sum(c).alias(c) for c in ("s", "s2", "over")])


def expected_counts(membership: DataFrame, label: str) -> DataFrame:
    """config_id, node_id, label, observed, null_mean, null_std, z_score in closed form: a node's count of a label is hypergeometric
    when labels are dealt out among members."""
    has = membership.where(F.col(label).isNotNull()).select("config_id", "node_id", "row_index", label).distinct()
    members = has.select("config_id", "row_index", label).distinct()
    seen = has.groupBy("config_id", "node_id", label).agg(F.count(F.lit(1)).alias("observed"))
    size = seen.groupBy("config_id", "node_id").agg(F.sum("observed").alias("m"))
    held = members.groupBy("config_id", label).agg(F.count(F.lit(1)).alias("c"))
    whole = held.groupBy("config_id").agg(F.sum("c").alias("t"))
    out = seen.join(size, ["config_id", "node_id"]).join(held, ["config_id", label]).join(whole, "config_id")
    share = F.col("c") / F.col("t")
    mean = F.col("m") * share
    out = out.withColumns({"null_mean": mean, "null_std": F.sqrt(F.when(F.col("t") > 1, mean * (1 - share) * (F.col("t") - F.col("m")) / (F.col("t") - 1)).otherwise(0.0))})
    return out.select("config_id", "node_id", label, "observed", "null_mean", "null_std", F.when(F.col("null_std") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_std")).alias("z_score"))


def _global(counts: DataFrame, keys: list[str]) -> DataFrame:
    node = counts.groupBy(*keys, "node_id").agg(F.sum("n").alias("m"), F.max("n").alias("top"), (-F.sum(F.col("n") * F.log("n"))).alias("nlogn"))
    h = F.log("m") + F.col("nlogn") / F.col("m")
    return node.groupBy(*keys).agg((F.sum("top") / F.sum("m")).alias("weighted_purity"), (F.sum(F.col("m") * h) / F.sum("m")).alias("weighted_entropy"))


def _nmi(counts: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, node_method_nmi: mutual information over the mean of both entropies, from counts by node and label."""
    def over(*more: str) -> Column:
        return F.sum("n").over(Window.partitionBy(*keys, *more))

    rows = counts.withColumns({"t": over(), "r": over("node_id"), "c": over(label)})
    mi = rows.groupBy(*keys).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("r") * F.col("c")))).alias("mi"), F.max("t").alias("t"))
    for side, name in (("node_id", "ha"), (label, "hb")):
        m = counts.groupBy(*keys, side).agg(F.sum("n").alias("m")).groupBy(*keys).agg((F.log(F.sum("m")) - F.sum(F.col("m") * F.log("m")) / F.sum("m")).alias(name))
        mi = mi.join(m, keys)
    mean = (F.col("ha") + F.col("hb")) / 2.0
    return mi.select(*keys, F.when(mean <= 0, 1.0).otherwise(F.greatest(F.col("mi") / mean, F.lit(0.0))).alias("node_method_nmi"))


def _assortativity(counts: DataFrame, edges: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, dominant_method_assortativity of the nodes' most frequent labels (ties in label order); null if it has no meaning."""
    tops = counts.groupBy(*keys, "node_id").agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("top"))
    both = both_ways(simple(edges))
    a = tops.withColumnsRenamed({"node_id": "source", "top": "la"}).join(both, ["config_id", "source"])
    cells = a.join(tops.withColumnsRenamed({"node_id": "target", "top": "lb"}), [*keys, "target"]).groupBy(*keys, "la", "lb").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)).alias("same"))
    margin = cells.groupBy(*keys, "la").agg(F.sum("n").alias("m")).groupBy(*keys).agg(F.sum(F.col("m") * F.col("m")).alias("m2"))
    rows = total.join(margin, keys).withColumn("ab", F.col("m2") / (F.col("t") * F.col("t")))
    return rows.select(*keys, F.when(F.col("ab") < 1.0, (F.col("same") / F.col("t") - F.col("ab")) / (1.0 - F.col("ab"))).alias("dominant_method_assortativity"))


#: Metrics of an audit, and whether a high one is extreme.
METRICS = {"weighted_purity": True, "weighted_entropy": False, "node_method_nmi": True, "dominant_method_assortativity": True}


def global_metrics(counts: DataFrame, keys: list[str], label: str, edges: DataFrame | None = None) -> DataFrame:
    """keys, metric, value: purity, entropy and NMI of node by label counts, and with edges the assortativity of their top labels."""
    out = _global(counts, keys).join(_nmi(counts, keys, label), keys)
    if edges is not None:
        out = out.join(_assortativity(counts, edges, keys, label), keys, "left")
    return out.unpivot(keys, [m for m in METRICS if m in out.columns], "metric", "value")


def label_counts(membership: DataFrame, label: str) -> DataFrame:
    return membership.where(F.col(label).isNotNull()).groupBy("config_id", "node_id", label).agg(F.count(F.lit(1)).alias("n"))


def permutation_tests(membership: DataFrame, label: str, n: int = 1000, seed: int = 42, edges: DataFrame | None = None) -> DataFrame:
    """config_id, metric, observed, null_mean, null_std, z_score, p_value of purity, NMI and (with edges) assortativity, of which high
    values are extreme, and of entropy, of which low ones are."""
    observed = global_metrics(label_counts(membership, label), ["config_id"], label, edges).withColumnRenamed("value", "observed")
    null = draws(membership, label, n, seed, edges)
    rows = null.join(observed, ["config_id", "metric"])
    high = stats.empirical(F.col("observed"), F.col("null"))
    low = stats.empirical(F.col("observed"), F.col("null"), high=False)
    out = rows.groupBy("config_id", "metric").agg(F.first("observed").alias("observed"), F.avg("null").alias("null_mean"), F.stddev_pop("null").alias("null_std"), high.alias("_high"), low.alias("_low"))
    up = F.col("metric").isin(*[m for m, high in METRICS.items() if high])
    return out.select("config_id", "metric", "observed", "null_mean", "null_std", F.when(F.col("null_std") > 0, F.try_divide(F.col("observed") - F.col("null_mean"), "null_std")).alias("z_score"), F.when(up, F.col("_high")).otherwise(F.col("_low")).alias("p_value"))


def enrichment(membership: DataFrame, label: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """config_id, node_id, label, observed, null_mean, ratio, z_score, p_value, q_value: labels that a node has more of than by chance."""
    seen = membership.where(F.col(label).isNotNull()).groupBy("config_id", "node_id", label).agg(F.count(F.lit(1)).alias("observed"))
    out = seen.join(drawn_counts(membership, label, n, seed), ["config_id", "node_id", label])
    mean = F.col("s") / n
    sd = F.sqrt(F.greatest(F.col("s2") / n - mean * mean, F.lit(0.0)))
    out = out.withColumns({"null_mean": mean, "enrichment_ratio": ratio("observed", mean), "z_score": F.when(sd > 0, F.try_divide(F.col("observed") - mean, sd)), "p_value": (F.col("over") + 1) / (n + 1.0)})
    return stats.fdr(out.drop("s", "s2", "over"), "p_value", "q_value", ["config_id"])
