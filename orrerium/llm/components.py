"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrerium.llm.common import materialise


def _done(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, and that on none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("hangs")))
    split = ends.groupBy("x").agg(F.sum("hangs").alias("s"), F.min("hangs").alias("m")).where("s > 1 or (s = 1 and m = 0)")
    return split.agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """edges: two id columns. Returns (id, component): each linked id but the roots, with its component's smallest id.

    Null ends and self-links are left aside; repeated edges count once; no edges give no rows. Minima are
    written before they are joined, so that a hub's side of the join can be split.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = materialise(edges, "edges")
    while not _done(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component under the links a-b, with the least."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = np.minimum(new, new[new])
        if (new == low).all():
            break
        low = new
    k = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[k], nodes[low[k]]
