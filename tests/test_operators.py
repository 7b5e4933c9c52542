import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrerium.operators import bias, graph, impute, knn, mapper, profile, regions
from orrerium.plans.registry import Context, Pipeline, Registry, merged, override
from orrerium.sources import graphs, tables


def test_derivation_has_sources(spark):
    df = spark.createDataFrame([(8.0, 2.0, None, 365.25, 1.0, None), (8.0, 2.0, 9.0, 1.0, None, 0.5)], "pl_bmasse double, pl_rade double, pl_dens double, pl_orbper double, st_mass double, pl_orbsmax double")
    a, b = impute.derive(df).collect()
    assert (a.pl_dens, a.pl_dens_source, a.pl_orbsmax_source) == (pytest.approx(5.514), "derived_density", "derived_kepler") and a.pl_orbsmax == pytest.approx(1.0)
    assert (b.pl_dens, b.pl_dens_source, b.pl_orbsmax) == (9.0, "observed", 0.5)


@pytest.mark.parametrize("method", ["median", "knn", "iterative"])
def test_imputation_keeps_what_is_observed(spark, method):
    rng = np.random.default_rng(0)
    x = rng.lognormal(size=60)
    rows = [(k, float(v), None if k % 5 == 0 else float(2 * v)) for k, v in enumerate(x)]
    got = impute.impute(spark.createDataFrame(rows, "row_index long, pl_rade double, pl_bmasse double"), ["pl_rade", "pl_bmasse"], method).collect()
    assert len(got) == 60 and all(r.pl_bmasse > 0 for r in got)
    assert all(r.pl_bmasse == pytest.approx(2 * r.pl_rade) for r in got if not r.pl_bmasse_was_imputed)
    assert sum(r.pl_bmasse_was_imputed for r in got) == 12
    if method == "iterative":
        assert max(abs(r.pl_bmasse / (2 * r.pl_rade) - 1) for r in got) < 0.01


def test_masks_take_their_share(spark):
    df = spark.range(1000).select(F.col("id").alias("row_index"), F.col("id").cast("double").alias("x"))
    assert abs(impute.masks(df, ["x"], 0.15).count() - 150) <= 2


def test_graph_by_hand(spark):
    nodes = spark.createDataFrame([("c", n) for n in ("n1", "n2", "n3", "n4", "n5")], "config_id string, node_id string")
    edges = spark.createDataFrame([("c", "n1", "n2"), ("c", "n2", "n1"), ("c", "n3", "n4"), ("c", "n4", "n4"), ("c", "n2", "n3"), ("c", "n1", "n3")], "config_id string, source string, target string")
    m = graph.graph_metrics(nodes, edges).first()
    assert (m.n_nodes, m.n_edges, m.beta_0, m.beta_1, m.n_isolates, m.largest_component) == (5, 4, 2, 1, 1, 4)
    cut = {r.node_id for r in graph.centrality(nodes, edges).collect() if r.is_articulation}
    assert cut == {"n3"}
    rings = {(r.node_id, r.neighbour): r.ring for r in graph.neighbourhoods(edges).collect()}
    assert rings["n1", "n4"] == 2 and rings["n1", "n2"] == 1


def test_nerve_by_hand(spark):
    held = {"n1": [0, 1, 2, 3], "n2": [3, 4, 5], "n3": [6, 7, 8], "n4": [8, 9]}
    m = spark.createDataFrame([("c", n, r) for n, rs in held.items() for r in rs], "config_id string, node_id string, row_index long")
    got = {(r.source, r.target): r.jaccard_members for r in mapper.nerve(m).collect()}
    assert got == {("n1", "n2"): pytest.approx(1 / 6), ("n3", "n4"): pytest.approx(1 / 4)}


def test_cover_holds_every_point(spark):
    rng = np.random.default_rng(1)
    pts = rng.random((300, 2))
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(pts)], "row_index long, lens_0 double, lens_1 double")
    got = {(r.row_index, r.cube_id) for r in mapper.cover(df, 5, 0.35).select("row_index", "cube_id").collect()}
    lo, span = pts.min(0), pts.max(0) - pts.min(0)
    w, r = span / 5, span / (2 * 5 * 0.65)
    want = {(k, i * 5 + j) for k, p in enumerate(pts) for i in range(5) for j in range(5) if (np.abs(p - lo - w * (np.array([i, j]) + 0.5)) <= r + 1e-12).all()}
    assert got == want


def test_dbscan():
    x = np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [5.2], [9.0], [0.35]])
    assert mapper.dbscan(x, 0.16, 3).tolist() == [0, 0, 0, 1, 1, 1, -1, 0]


def test_knn_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "id long, a double, b double, c double")
    got = {}
    for r in knn.nearest(df, df, ["a", "b", "c"], 4, block=64).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r.neighbour
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, 1)[:, :4]
    assert all([got[k][i] for i in (1, 2, 3, 4)] == want[k].tolist() for k in range(200))


def test_shadow_needs_neighbours(spark):
    rows = spark.createDataFrame([("c", "a", 10, 1.0, 0.0, 2.0, False), ("c", "b", 5, 0.5, 1.0, 1.0, False), ("c", "d", 5, 1.0, 0.0, None, True)], "config_id string, node_id string, n_members long, top_method_fraction double, method_entropy_norm double, method_l1_boundary double, no_neighbors boolean")
    got = {r.node_id: r for r in regions.shadow_classes(regions.shadow_scores(rows)).collect()}
    assert got["a"].shadow_score == pytest.approx(2.0) and got["b"].shadow_score == 0 and got["d"].shadow_score is None
    assert (got["a"].shadow_class, got["d"].shadow_class) == ("high_confidence_shadow", "no_neighbor_information")


def test_deficit_is_at_most_the_anchor(spark):
    rng = np.random.default_rng(3)
    rows = [("c", n, i, *map(float, rng.normal(size=3)), True) for n, ids in {"a": range(12), "b": range(8, 22), "d": range(20, 34)}.items() for i in ids]
    m = spark.createDataFrame(rows, "config_id string, node_id string, row_index long, z_0 double, z_1 double, z_2 double, r3_valid boolean")
    a = regions.anchors(m)
    out = regions.deficits(a, m, mapper.nerve(m)).collect()
    assert len(out) == 9 and max(r.delta_N_neighbors for r in out) <= 1


def overlapping(n, seed=5):
    """Members of one or two of six nodes, of three labels that go with nodes; some bear no label."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        at = rnd.randrange(6)
        label = rnd.choice("xyz") if rnd.random() < 0.6 else "xyz"[at // 2]
        rows += [("c", f"n{x}", k, label if k % 17 else None) for x in {at, min(at + (rnd.random() < 0.3), 5)}]
    return rows


MEMBERS = "config_id string, node_id string, row_index long, label string"


def test_draws_keep_margins(spark):
    m = spark.createDataFrame(overlapping(300), MEMBERS)
    table = bias.signatures(m, "label").toPandas()
    urn = bias.Urn(table, None)
    drawn = urn.draw(np.random.default_rng(1), 200)
    assert (drawn.sum(2) == urn.sizes).all() and (drawn.sum(1) == urn.totals).all() and (drawn >= 0).all()
    assert len(np.unique(drawn.reshape(200, -1), axis=0)) == 200
    got = {r.metric: r for r in bias.permutation_tests(m, "label", 30).collect()}
    assert got["weighted_purity"].p_value == pytest.approx(1 / 31) and got["weighted_entropy"].z_score < -3


def test_draws_have_the_moments_of_the_closed_form(spark, monkeypatch):
    monkeypatch.setattr(bias, "DRAW_CELLS", 5000)
    rows = overlapping(400)
    m = spark.createDataFrame(rows, MEMBERS)
    drawn = {(r.node_id, r.label): r for r in bias.enrichment(m, "label", 2000).collect()}
    closed = {(r.node_id, r.label): r for r in bias.expected_counts(m, "label").collect()}
    assert drawn.keys() == closed.keys()
    members = {k: lab for _, _, k, lab in rows if lab}
    for key, e in closed.items():
        inside = {k for _, n, k, lab in rows if n == key[0] and lab}
        share = sum(lab == key[1] for lab in members.values()) / len(members)
        var = len(inside) * share * (1 - share) * (len(members) - len(inside)) / (len(members) - 1)
        assert e.null_mean == pytest.approx(len(inside) * share) and e.null_std == pytest.approx(var**0.5)
        d = drawn[key]
        assert d.observed == e.observed and abs(d.null_mean - e.null_mean) < 5 * e.null_std / 2000**0.5
        assert d.z_score == pytest.approx(e.z_score, abs=0.35 + 0.1 * abs(e.z_score))


def test_metrics_of_a_table_are_those_of_its_counts(spark):
    m = spark.createDataFrame(overlapping(250, 9) + [("d", "only", 1, "x"), ("d", "only", 2, "x")], MEMBERS)
    edges = mapper.nerve(m)
    want = {(r.config_id, r.metric): r.value for r in bias.global_metrics(bias.label_counts(m, "label"), ["config_id"], "label", edges).collect()}
    pairs = graph.both_ways(graph.simple(edges)).toPandas()
    for config, table in bias.signatures(m, "label").toPandas().groupby("config_id"):
        urn = bias.Urn(table, pairs[pairs["config_id"] == config])
        for metric, value in urn.metrics(urn.counts(urn.observed[None])).items():
            assert value[0] == pytest.approx(want[config, metric])


def test_an_audits_cost_follows_the_graph(spark):
    few, many = (bias._urns(spark.createDataFrame(overlapping(n), MEMBERS), "label", None).first() for n in (2000, 20000))
    assert few.cells == many.cells and len(many.urn) < 1.1 * len(few.urn)
    assert bias.permutation_tests(spark.createDataFrame([], MEMBERS), "label", 5).count() == 0


def test_alignment_refuses_repeated_keys(spark):
    with pytest.raises(ValueError, match="repeat"):
        profile.align(spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1,)], "k int"), ["k"])


def test_registry():
    reg = Registry.of({"size": ["pl_rade", "pl_bmasse"], "star": ["st_mass"], "how": [{"name": "discoverymethod", "role": "audit"}]}, {"all": "size + star"}, {"pl_bmasse": ["pl_dens"]})
    assert reg.resolve("all - pl_rade") == ["pl_bmasse", "st_mass"]
    assert reg.without_leaks(["pl_bmasse", "log_pl_bmasse", "discoverymethod", "st_mass"], "pl_bmasse")[0] == ["st_mass"]
    with pytest.raises(ValueError, match="unknown"):
        reg.resolve("nothing")


def test_config_and_pipeline(spark):
    assert merged({"a": {"b": 1, "c": 2}}, override("a.b=5")) == {"a": {"b": 5, "c": 2}}
    p = Pipeline()

    @p.stage("one")
    def one(ctx):
        return {"t": ctx.spark.range(3)}

    @p.stage("two")
    def two(ctx):
        raise RuntimeError("no")

    ctx = p.run(Context(spark, {"fail_fast": False}))
    assert [s["status"] for s in ctx.manifest["stages"]] == ["done", "failed"] and ctx.tables["t"].count() == 3
    with pytest.raises(RuntimeError):
        p.run(Context(spark, {}))


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("# COLUMN pl_name: Name\n# COLUMN x: A value\n# note\npl_name,x\na,1.5\nb,\n")
    path = f"file://{tmp_path}/c.csv"
    assert [(r.pl_name, r.x) for r in tables.read_table(spark, path, "pl_name string, x double").collect()] == [("a", 1.5), ("b", None)]
    assert {r.column: r.description for r in tables.column_dictionary(spark, path).collect()} == {"pl_name": "Name", "x": "A value"}
    (tmp_path / "g.json").write_text('{"nodes": {"n1": [0, 1], "n2": [1, 9]}, "links": {"n1": ["n2"]}, "sample_id_lookup": [10, 11]}')
    g = f"file://{tmp_path}/g.json"
    assert {(r.node_id, r.row_index) for r in tables.graph_members(spark, g, "c").collect()} == {("n1", 10), ("n1", 11), ("n2", 11)}
    assert [(r.source, r.target) for r in tables.graph_edges(spark, g).collect()] == [("n1", "n2")]
    assert tables.latest(spark, f"file://{tmp_path}/*.csv").endswith("c.csv")
    assert tables.snake("Planet Name (AU)") == "planet_name_au"


def test_medoid_of_a_large_node_is_that_of_all_pairs(spark):
    # The centroid lies between the two heaps, nearest to the few rows there; the medoid is in the larger heap.
    x = [0.0] * 12_000 + [2.0] * 9_000 + [0.9]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "row_index long, z_0 double")
    m = rows.select(F.lit("c").alias(regions.KEY), F.lit("n").alias("node_id"), "row_index", "z_0", F.lit(0.0).alias("z_1"), F.lit(0.0).alias("z_2"), F.lit(True).alias("r3_valid"))
    assert [r.row_index for r in regions.medoids(m).collect()] == [0]


def test_nearest_meets_few_blocks(spark):
    """Equal to a scan, copies and ties included, and the share of block pairs that is visited falls as the rows grow."""
    rng = np.random.default_rng(8)
    shares = []
    for n in (300, 6000):
        x = rng.uniform(size=(n, 3)) * [1, 1, 0.01]
        x[: n // 6] = x[0]  # a sixth are copies
        ids = rng.permutation(len(x))
        df = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, x, strict=True)], "id long, a double, b double, c double")
        got = {}
        for r in knn.nearest(df, df, ["a", "b", "c"], 4, block=30).collect():
            got.setdefault(r.query, []).append((r["rank"], r.neighbour, r.distance))
        for i, v in list(zip(ids, x, strict=True))[:: n // 100]:
            d = np.sqrt(((x - v) ** 2).sum(1))
            order = [k for k in np.lexsort((ids, d)) if ids[k] != i][:4]
            mine = sorted(got[i])
            assert [m[1] for m in mine] == [int(ids[k]) for k in order] and np.allclose([m[2] for m in mine], d[order])
        rows = knn._complete(df, "id", ["a", "b", "c"], None)
        blocks = knn._ringed(rows, ["a", "b", "c"], *knn.pivots(rows, ["a", "b", "c"], 30), 30)
        assert max(r.n for r in blocks.collect()) <= 60 and sum(r.n for r in blocks.collect()) == n
        pairs = knn.block_pairs(blocks, blocks)
        worst = {}
        by = {i: b.block for b in blocks.collect() for i in np.frombuffer(b.ids, np.int64).tolist()}
        for q, near in got.items():
            worst[by[q]] = max(worst.get(by[q], 0), max(m[2] for m in near))
        all_pairs = pairs.collect()
        assert len(all_pairs) == blocks.count() ** 2
        shares.append(sum(p.apart <= worst[p.q_block] for p in all_pairs) / len(all_pairs))
    assert shares[1] < 0.3 * shares[0], shares


def test_nearest_of_few_groups_and_nothing(spark):
    rows = [(k, "ab"[k % 2], float(k), 0.0) for k in range(9)] + [(20, "b", None, 1.0), (21, None, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, kind string, x double, y double")
    got = {(r.query, r["rank"]): r.neighbour for r in knn.nearest(df.where("id < 4"), df, ["x", "y"], 3, group="kind").collect()}
    assert got == {(0, 1): 2, (0, 2): 4, (0, 3): 6, (1, 1): 3, (1, 2): 5, (1, 3): 7, (2, 1): 0, (2, 2): 4, (2, 3): 6, (3, 1): 1, (3, 2): 5, (3, 3): 7}
    assert knn.nearest(df.limit(0), df, ["x", "y"], 3).count() == 0 == knn.nearest(df, df.limit(0), ["x", "y"], 3).count()
    assert knn.nearest(df.where("id < 2"), df.where("id < 2"), ["x", "y"], 5).count() == 2  # fewer rows than asked for


def test_ball_counts(spark):
    rng = np.random.default_rng(1)
    d = [("a", float(x)) for x in rng.integers(0, 20, 300)] + [("b", 0.0)] * 40 + [("c", 5.0)]
    balls = [(k, r) for k in "abcz" for r in (None, -1.0, 0.0, 3.0, 4.5, 19.0, 20.0, 1e9)]
    got = regions.ball_counts(spark.createDataFrame(d, "k string, d double"), spark.createDataFrame(balls, "k string, radius double"), ["k"], 7).collect()
    assert len(got) == len(balls)
    for r in got:
        assert r.inside == (0 if r.radius is None else sum(k == r.k and x <= r.radius for k, x in d))


def test_analog_reference(spark):
    """Anchors' balls against those around analogs' medoids, by hand; too few analogs say so."""
    rng = np.random.default_rng(4)
    nodes = {"a": range(12), "b": range(9, 24), "d": range(20, 40), "e": range(38, 50), "f": range(60, 75)}
    at = {i: [float(x) for x in rng.normal(size=3)] for i in range(75)}
    m = spark.createDataFrame([("c", n, i, *at[i], True) for n, ids in nodes.items() for i in ids], "config_id string, node_id string, row_index long, z_0 double, z_1 double, z_2 double, r3_valid boolean")
    edges, a = mapper.nerve(m), regions.anchors(m)
    long = regions.deficits(a, m, edges)
    analogs = [("c", n, o) for n in ("a", "f") for o in ("b", "d", "e")] + [("c", "b", "a")]
    out = regions.analog_deficits(long, spark.createDataFrame(analogs, "config_id string, node_id string, analog_node string"), m, edges).collect()
    near = {"a": "abd", "b": "abde", "d": "abde", "e": "bde", "f": "f"}
    gap = lambda i, j: float(np.linalg.norm(np.subtract(at[i], at[j])))
    middle = {n: min(ids, key=lambda i, ids=ids: (round(sum(gap(i, j) for j in ids), 9), i)) for n, ids in nodes.items()}
    for r in out:
        others = [o for _, n, o in analogs if n == r.node_id]
        counts = [sum(gap(i, middle[o]) <= r.radius for i in {i for x in near[o] for i in nodes[x]} - {middle[o]}) for o in others]
        assert r.n_analog_nodes == len(others) and r.N_exp_analog == (float(np.median(counts)) if len(others) > 2 else None)
        assert r.reference_used == ("unavailable" if r.node_id == "f" else "N1")
        assert r.warning == ("insufficient_neighbors" if r.node_id == "f" else None if r.node_id == "a" else "insufficient_analogs")
    best = {r.node_id: r for r in regions.deficit_summary(spark.createDataFrame(out)).collect()}
    assert best["b"].delta_rel_analog_best == 0 and best["f"].delta_rel_neighbors_best == 0


def points(n, seed):
    """Blobs with copies, bridges between them and noise, in three features."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n // 4, 3)) * 0.35 + c for c in ([0, 0, 0], [3, 0, 0], [0, 4, 1])] + [rng.uniform(-3, 7, size=(n - 3 * (n // 4), 3))])
    x[: n // 6] = x[0]
    x[n // 6 : n // 5] = x[n // 6] + np.outer(np.arange(n // 5 - n // 6), [0.1, 0.05, 0])
    return x[rng.permutation(n)].round(4)


@pytest.mark.parametrize(("n", "eps", "least"), [(240, 0.4, 4), (300, 0.15, 2), (150, 30.0, 4)])
def test_large_cells_have_the_clusters_of_one_task(spark, n, eps, least):
    rows = [("c", cube, k * 7 % n, *map(float, v)) for cube in (2, 5) for k, v in enumerate(points(n, cube))]
    df = spark.createDataFrame(rows, "config_id string, cube_id int, row_index long, a double, b double, c double")
    plain = mapper.cluster(df, ["a", "b", "c"], eps, least).collect()
    spread = mapper.cluster(df, ["a", "b", "c"], eps, least, most=30).collect()
    assert sorted(map(tuple, spread)) == sorted(map(tuple, plain))
    assert eps < 0.01 or len(plain) > 10


def test_all_configurations_are_those_built_one_by_one(spark):
    x = points(160, 9)
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)] + [(1000, None, 1.0, 2.0)], "row_index long, a double, b double, c double")
    spaces = {"phys_min": ("a", "b"), "phys_density": ("a", "b", "c")}
    configs = mapper.grid(list(spaces), ["pca2", "domain"], [3], [0.2, 0.35])
    eps = {"phys_min": 0.3, "phys_density": 0.5}
    members, edges, metrics = mapper.build_all(df, configs, spaces, eps)
    got, links, rows = members.collect(), edges.collect(), {r.config_id: r for r in metrics.collect()}
    assert rows.keys() == {c.id for c in configs}
    for c in configs[1::4]:
        used = list(spaces[c.space])
        lens = mapper.pca_lens(df, used) if c.lens == "pca2" else mapper.domain_lens(df.dropna(subset=used), *used[:2])
        one, nerve = mapper.build(df, used, eps[c.space], c, lens)
        assert sorted(tuple(r) for r in got if r.config_id == c.id) == sorted(map(tuple, one.collect()))
        alone = graph.graph_metrics(one.select("config_id", "node_id").distinct(), nerve).first()
        assert {k: v for k, v in rows[c.id].asDict().items() if k in alone.asDict()} == pytest.approx(alone.asDict())
        assert sum(r.config_id == c.id for r in links) == alone.n_edges and rows[c.id].rows_used == 160
    assert mapper.build_all(df.limit(0), configs[:2], spaces, eps)[2].count() == 2


def dense_ridge(x, y):
    """Evidence updates with explicit matrices: (weights, precision of noise, posterior covariance), means taken out."""
    x, y = x - x.mean(0), y - y.mean()
    alpha, lam, before = 1 / (y.var() + np.finfo(float).eps), 1.0, None
    for _ in range(300):
        cov = np.linalg.inv(alpha * x.T @ x + lam * np.eye(x.shape[1]))
        w = alpha * cov @ x.T @ y
        known = x.shape[1] - lam * np.trace(cov)
        lam, alpha = (known + 2e-6) / (w @ w + 2e-6), (len(y) - known + 2e-6) / (((y - x @ w) ** 2).sum() + 2e-6)
        if before is not None and np.abs(w - before).sum() < 1e-3:
            break
        before = w
    cov = np.linalg.inv(alpha * x.T @ x + lam * np.eye(x.shape[1]))
    return alpha * cov @ x.T @ y, alpha, cov


@pytest.mark.parametrize("noise", [0.0, 0.1, 3.0])
def test_evidence_from_sums_is_that_of_rows(noise):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4)) + 5
    x[:, 3] = x[:, 2]  # no full rank
    y = x @ [1.0, -2.0, 0.5, 0.5] + noise * rng.normal(size=80)
    xc, yc = x - x.mean(0), y - y.mean()
    got = impute.Evidence(xc.T @ xc, xc.T @ yc, float(yc @ yc), 80)
    w, alpha, cov = dense_ridge(x, y)
    assert np.allclose(got.coef, w, atol=1e-6) and got.alpha == pytest.approx(alpha, rel=1e-3) and np.allclose(got.covariance, cov, rtol=1e-4, atol=1e-8)


def test_chained_regressions_are_those_of_rows(spark):
    rng = np.random.default_rng(7)
    full = rng.normal(size=(70, 3)) @ [[1, 0.8, -0.5], [0, 0.6, 0.2], [0, 0, 0.4]]
    gone = rng.random(full.shape) < [0.1, 0.25, 0.0]
    cells = [[None if g else float(v) for v, g in zip(r, h, strict=True)] for r, h in zip(full, gone, strict=True)]
    df = spark.createDataFrame([(k, *r, None) for k, r in enumerate(cells)], "row_index long, a double, b double, c double, void double")
    got = impute.iterative_fill(df, ["a", "b", "c", "void"], spread=True).orderBy("row_index").toPandas()
    x = np.where(gone, np.nan, full)
    x = np.where(gone, np.nanmedian(x, axis=0), x)
    spread = np.full(x.shape, np.nan)
    for _ in range(20):
        old = x.copy()
        for j in (0, 1):
            rest, at = [k for k in range(3) if k != j], gone[:, j]
            w, alpha, cov = dense_ridge(x[~at][:, rest], x[~at, j])
            away = x[at][:, rest] - x[~at][:, rest].mean(0)
            x[at, j] = x[~at, j].mean() + away @ w
            spread[at, j] = np.sqrt(1 / alpha + np.einsum("ij,jk,ik->i", away, cov, away))
        if np.abs(x - old).max() < 1e-3 * np.abs(full[~gone]).max():
            break
    assert np.allclose(got[["a", "b", "c"]].to_numpy(float), x, atol=1e-6)
    assert np.allclose(got[["a_spread", "b_spread", "c_spread"]].to_numpy(float), spread, atol=1e-5, equal_nan=True)
    assert got["void"].isna().all()


def test_centralities_are_those_of_all_paths(spark):
    """Batches of sources against sums over all shortest paths, found by walking; components, loops and lone nodes included."""
    rnd = random.Random(12)
    names = [f"n{k}" for k in range(26)]
    links = {tuple(sorted(rnd.sample(names[:20], 2))) for _ in range(30)} | {("n20", "n21"), ("n21", "n22")}
    nodes = spark.createDataFrame([(c, v) for c in ("p", "q") for v in names], "config_id string, node_id string")
    edges = spark.createDataFrame([(c, *e) for c in ("p", "q") for e in [*links, ("n3", "n3")] if c == "p" or "n0" not in e], "config_id string, source string, target string")
    got = {(r.config_id, r.node_id): r for r in graph.centrality(nodes, edges, sources=7).collect()}
    assert len(got) == 52

    def shortest(near, a):
        """Every shortest path from a, by its end."""
        found, layer = {a: [[a]]}, {a: [[a]]}
        while layer:
            ahead = {}
            for v, ways in layer.items():
                for w in near[v]:
                    if w not in found:
                        ahead.setdefault(w, []).extend([*p, w] for p in ways)
            found |= ahead
            layer = ahead
        return found

    for c in ("p", "q"):
        near = {v: {b if a == v else a for a, b in links if v in (a, b) and (c == "p" or "n0" not in (a, b))} for v in names}
        ways = {v: shortest(near, v) for v in names}
        for v in names:
            between = sum(sum(v in p[1:-1] for p in ps) / len(ps) for a in names for ps in ways[a].values())
            far = [len(ps[0]) - 1 for ps in ways[v].values()]
            reach = len(far) - 1
            r = got[c, v]
            assert r.betweenness == pytest.approx(between / (25 * 24)) and r.eccentricity == max(far)
            assert r.closeness == pytest.approx(reach / sum(far) * reach / 25 if reach else 0)
            rest = {a: near[a] - {v} for a in names if a != v}
            assert r.is_articulation == any(b not in shortest(rest, a) for a in near[v] for b in near[v])


def test_membership_comes_from_the_first_source_that_has_it(spark, tmp_path):
    (tmp_path / "graph_c.json").write_text('{"nodes": {"n1": [0, 1], "n2": [1]}, "sample_id_lookup": [10, 11]}')
    (tmp_path / "graph_bad.json").write_text('{"nodes": {"n1": [0, 5]}, "sample_id_lookup": [10, 11]}')
    (tmp_path / "table.csv").write_text("config_id,node_id,row_index\nother,n9,1\n")
    at = lambda kind, name: graphs.MemberSource(kind, f"file://{tmp_path}/{name}")
    known = spark.createDataFrame([(10,), (11,)], "row_index long")
    got, warnings = graphs.resolve_membership(spark, "c", [at("table", "none.csv"), at("table", "table.csv"), at("graph", "graph_c.json"), at("graph", "graph_bad.json")], known)
    assert {(r.node_id, r.row_index, r.source) for r in got.collect()} == {("n1", 10, "graph"), ("n1", 11, "graph"), ("n2", 11, "graph")}
    assert len(warnings) == 2 and got.first().path.endswith("graph_c.json")
    with pytest.raises(ValueError, match="out of bounds"):
        graphs.resolve_membership(spark, "c", [at("graph", "graph_bad.json")])
    with pytest.raises(ValueError, match="1 members .* row 1"):
        graphs.resolve_membership(spark, "other", [at("table", "table.csv")], known)
    loose = graphs.resolve_membership(spark, "other", [at("table", "table.csv")], known, strict=False)[0].collect()
    assert [(r.row_index, r.in_catalog) for r in loose] == [(1, False)]
    with pytest.raises(FileNotFoundError, match="none.csv"):
        graphs.resolve_membership(spark, "c", [at("table", "none.csv")])
    with pytest.raises(ValueError, match="unknown kind"):
        graphs.MemberSource("guess", "x")


def test_distances_to_neighbours_count_a_member_once(spark):
    import random

    draw = random.Random(3)
    at = {i: (draw.random(), draw.random(), draw.random() if draw.random() > 0.2 else None) for i in range(200)}
    stands = {i: sorted({f"n{draw.randrange(9)}" for _ in range(draw.randrange(1, 4))}) for i in at}
    rows = [("c", n, i, *map(float, at[i][:2]), at[i][2], at[i][2] is not None) for i in at for n in stands[i]]
    members = spark.createDataFrame(rows + rows[:20], "config_id string, node_id string, row_index long, z_0 double, z_1 double, z_2 double, r3_valid boolean")
    edges = mapper.nerve(members).where("source <> 'n0' AND target <> 'n0'")
    got = {r.node_id: r for r in regions.distance_to_neighbours(members, edges).collect()}
    near = {n: set() for n in got}
    for e in edges.collect():
        near[e.source].add(e.target)
        near[e.target].add(e.source)

    def centre(nodes):
        held = [at[i] for i in at if at[i][2] is not None and nodes & set(stands[i])]
        return [sum(x) / len(held) for x in zip(*held)] if held else None

    for n, r in got.items():
        own, other = centre({n}), centre(near[n])
        assert [r.c_0, r.c_1, r.c_2] == pytest.approx(own)
        if other is None:
            assert r.physical_distance_v_to_N1 is None
        else:
            assert r.physical_distance_v_to_N1 == pytest.approx(sum((a - b) ** 2 for a, b in zip(own, other)) ** 0.5)
    assert got["n0"].physical_distance_v_to_N1 is None and len(got) == 9
