"""Clusters without lists of all pairs."""

import tracemalloc

import numpy as np

from orrerium.operators import knn
from orrerium.operators.mapper import Close, dbscan, spread_clusters


def test_rows_that_are_all_close_hold_no_pairs():
    x = np.random.default_rng(2).random((5000, 2))
    tracemalloc.start()
    got = dbscan(x, 2.0, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == 0).all() and peak < 60e6


def test_clusters_are_those_of_all_distances():
    rng = np.random.default_rng(4)
    for wide in (1, 2, 6):
        x = np.round(rng.normal(size=(150, wide)) * 2) / 2
        near = ((x[:, None] - x) ** 2).sum(2) <= 0.25 + 1e-12
        core = near.sum(1) >= 4
        want = np.full(len(x), -1)
        for s in np.flatnonzero(core):
            if want[s] < 0:
                own = np.arange(len(x)) == s
                while (more := own | (near[own & core].any(0) & core)).sum() > own.sum():
                    own = more
                want[own] = want.max() + 1
        for i in np.flatnonzero(~core & (near & core).any(1)):
            want[i] = want[near[i] & core].min()
        assert dbscan(x, 0.5, 4).tolist() == want.tolist()


def test_tasks_hold_a_pair_of_blocks_and_no_batch_of_them(spark):
    x = np.random.default_rng(6).normal(size=(300, 6))
    cols = [f"f{i}" for i in range(6)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())], "id long, " + ", ".join(f"{c} double" for c in cols))
    near = knn.nearest(rows, rows, cols, 3, block=40)
    assert "FlatMapGroupsInPandas" in near._jdf.queryExecution().toString()
    got = {(r["query"], r["rank"]): r["neighbour"] for r in near.collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, k + 1): j for i, js in enumerate(np.argsort(d, axis=1)[:, :3].tolist()) for k, j in enumerate(js)}
    assert knn.nearest(rows.limit(0), rows, cols, 3, block=40).count() == 0


def test_rows_that_are_all_close_are_met_in_small_parts():
    x = np.random.default_rng(2).random((20_000, 2))
    tracemalloc.start()
    dbscan(x, 2.0, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_leaves_that_are_wholly_close_are_not_measured(monkeypatch):
    x = np.random.default_rng(2).random((3000, 3))
    parts = []
    met = Close.met
    monkeypatch.setattr(Close, "met", lambda self, *a, **k: (parts.append(r[2].size) or r for r in met(self, *a, **k)))
    assert (dbscan(x, 3.0, 4) == 0).all() and sum(parts) == 0


def test_boxes_as_wide_as_eps_are_all_joined(spark):
    x = np.round(np.random.default_rng(1).random((120, 2)) * 12, 3)
    x[:2] = [[0, 0], [12, 12]]
    rows = [("c", 0, k, v.tolist(), 1.0, 2) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "config_id string, cube_id int, row_index long, x array<double>, eps double, min_samples int")
    got = {r.row_index: r.cluster_id for r in spread_clusters(df, most=2).collect()}  # a core stands in nine boxes
    assert got == {k: int(c) for k, c in enumerate(dbscan(x, 1.0, 2)) if c >= 0}
