"""Donors found in boxes are those of a scan, ties by value."""

import numpy as np
import pytest

from orrerium.operators import impute, knn


@pytest.mark.parametrize(("block", "search"), [(10**6, 500), (17, 500), (17, 0)])
def test_equal_distances_go_by_value(spark, monkeypatch, block, search):
    monkeypatch.setattr(impute, "SEARCH", search)
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 4, 300), rng.integers(0, 3, 300), rng.normal(size=300)], 1).astype(float)
    x[rng.random(x.shape) < 0.3] = np.nan
    df = spark.createDataFrame([(k, *[None if np.isnan(v) else float(v) for v in row]) for k, row in enumerate(x)], "row_index long, a double, b double, c double")
    got = {r.row_index: [r.a, r.b, r.c] for r in impute.knn_fill(df, ["a", "b", "c"], 5, block).collect()}
    assert len(got) == 300
    for i, row in enumerate(x):
        for j in range(3):
            want = None if np.isnan(row[j]) else row[j]
            if want is None and not np.isnan(row).all():
                both = ~np.isnan(x) & ~np.isnan(row)
                n = both.sum(1)
                d = np.sqrt(np.where(both, (x - row) ** 2, 0).sum(1) * 3 / np.maximum(n, 1))
                able = np.flatnonzero((n > 0) & ~np.isnan(x[:, j]))
                near = able[np.lexsort((x[able, j], d[able]))[:5]]
                here = near[d[near] == 0]
                want = x[here, j].mean() if len(here) else (x[near, j] / d[near]).sum() / (1 / d[near]).sum()
            assert got[i][j] == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("copies", [1, 40])
def test_leaves_find_what_all_distances_show(copies):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.integers(0, 30, (200, 2)).astype(float), copies, 0)
    ki, qi, q = rng.permutation(len(x)), np.arange(90) - 50, rng.integers(0, 30, (90, 2)).astype(float)
    far, ids = knn._nearest_by_leaves(qi, q, ki, x, 6, True, scale=(3.0, 2.0))
    d = np.sqrt(((x - q[:, None]) ** 2).sum(2) * 3.0 / 2.0)
    d[qi[:, None] == ki] = np.inf
    for i in range(len(q)):
        best = np.lexsort((ki, d[i]))[:6]
        assert ids[i].tolist() == ki[best].tolist() and far[i].tolist() == d[i, best].tolist()


def test_boxes_hold_all_neighbours(spark):
    rng = np.random.default_rng(8)
    x, q = np.round(rng.normal(size=(900, 2)), 1), np.round(rng.normal(size=(200, 2)) * 2, 1)
    known = spark.createDataFrame([(f"g{i % 2}", i, *map(float, r)) for i, r in enumerate(x)], "g string, id long, a double, b double")
    asked = spark.createDataFrame([(f"g{i % 3}", i, *map(float, r)) for i, r in enumerate(q)], "g string, id long, a double, b double")
    rows = knn.nearest_in_boxes(asked, known, ["a", "b"], 5, dict.fromkeys(("g0", "g1"), (1.0, 1.0)), box=40).collect()
    for i in range(len(q)):
        got = sorted((r.distance, r.neighbour) for r in rows if r.query == i)[:5]
        d = np.sqrt(((x - q[i]) ** 2).sum(1))
        assert got == sorted((d[j], j) for j in range(len(x)) if j % 2 == i % 3)[:5]
