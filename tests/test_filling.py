import numpy as np
import pytest

from orrerium.functions.stats import exact_quantiles
from orrerium.operators import impute


def _holes(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 2))
    x = np.column_stack([base[:, 0], base[:, 1], base @ [1.0, -2.0] + rng.normal(size=n) / 10])
    x[rng.random(x.shape) < 0.25] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_index long, a double, b double, c double")


def test_iterative_rounds_come_from_sums_and_equal_those_over_rows(spark, monkeypatch):
    df = _holes(spark)
    monkeypatch.setattr(impute, "PATTERNS", 0)
    by_rows = {r.row_index: r for r in impute.iterative_fill(df, ["a", "b", "c"], spread=True).collect()}

    def no_table(*_):
        raise AssertionError("a table was written for a round")

    monkeypatch.setattr(impute, "PATTERNS", 4096)
    monkeypatch.setattr(impute, "written", no_table)
    got = impute.iterative_fill(df, ["a", "b", "c"], spread=True).collect()
    assert len(got) == 400
    for r in got:
        for c, v in r.asDict().items():
            assert v == pytest.approx(by_rows[r.row_index][c], rel=1e-8, abs=1e-8) if v is not None else by_rows[r.row_index][c] is None, c


def test_quantiles_are_exact_without_a_map_of_all_values(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=20_000), np.full(9_000, 0.25), [1e300, -1e300]])
    df = spark.createDataFrame([(float(v), None, float(v > 0)) for v in x], "x double, gone double, two double")
    ps = [0.0, 0.15, 0.25, 0.5, 0.6123, 0.75, 1.0]
    got = exact_quantiles(df, {"x": ps, "gone": [0.5], "two": [0.5]})
    assert got["x"] == pytest.approx(np.quantile(x, ps).tolist(), rel=1e-12) and got["gone"] == [None] and got["two"] == [np.quantile((x > 0).astype(float), 0.5)]


def test_masked_validation_doesn_t_join_cells(spark, monkeypatch):
    df = _holes(spark)
    hidden = {(r.row_index, r.feature) for r in impute.masks(df, ["a", "b", "c"]).collect()}
    known = {f: df.where(f"{f} is not null").count() for f in "abc"}
    assert all(sum(f == g for _, g in hidden) == int(0.15 * (known[f] - 1)) + 1 for f in "abc")
    # An id that stands twice once multiplied its pairs.
    twice = df.unionByName(df.where("row_index = 7 or row_index = 8"))
    assert impute.masked_validation(twice, ["a", "b", "c"], "median").agg({"n": "sum"}).first()[0] == impute.masks(twice, ["a", "b", "c"]).count()
    assert {r.feature: r.n for r in impute.masked_validation(df, ["a", "b", "c"], "median").collect()} == {f: sum(g == f for _, g in hidden) for f in "abc"}


def test_methods_hide_the_same_cells_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 7), i % 5 + 0.5, i % 3 * 2.0 + i % 7) for i in range(400)], "row_index long, a double, b double, c double")
    chosen, units = [], []
    hidden, row = impute._hidden, impute.robust_row
    monkeypatch.setattr(impute, "_hidden", lambda *a: chosen.append(1) or hidden(*a))
    monkeypatch.setattr(impute, "robust_row", lambda *a: units.append(1) or row(*a))
    methods = ("median", "knn", "iterative")
    together = {tuple(r) for r in impute.masked_validations(rows, ["a", "b", "c"], methods).collect()}
    assert (len(chosen), len(units)) == (1, 1)
    alone = {tuple(r) for m in methods for r in impute.masked_validation(rows, ["a", "b", "c"], m).collect()}
    key = {(r[0], r[-1]): r[1:-1] for r in alone}
    assert len(together) == len(key) == 9
    for r in together:
        for a, b in zip(r[1:-1], key[r[0], r[-1]], strict=True):
            assert a == b if None in (a, b) else a == pytest.approx(b, rel=1e-9)
