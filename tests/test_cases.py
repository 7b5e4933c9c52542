"""Cases, synthesis, node tables, priors and context on hand-made rows, empty tables and against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrerium.functions import labels, stats
from orrerium.operators import cases, context, impute, nodes, priors, synthesis

ANCHORS = "anchor_pl_name string, node_id string, ATI double, TOI double, delta_rel_neighbors_best double, r3_imputation_score double, anchor_representativeness double"


def test_fdr_is_that_of_a_sorted_list(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(3000) ** 3, 3)
    n = len(p)
    order = np.argsort(p, kind="stable")
    want = np.empty(n)
    want[order] = np.minimum(1, np.minimum.accumulate((p[order] * n / np.arange(1, n + 1))[::-1])[::-1])
    rows = [(k, float(x), "g" if k % 2 else "h") for k, x in enumerate(p)] + [(n, None, "g")]
    df = spark.createDataFrame(rows, "id long, p double, g string")
    got = {r.id: r.q_value for r in stats.fdr(df, "p").collect()}
    assert len(got) == n + 1 and got[n] is None and all(got[k] == pytest.approx(want[k]) for k in range(n))
    alone = {r.id: r.q_value for r in stats.fdr(df.where("g = 'g'"), "p").collect()}
    grouped = {r.id: r.q_value for r in stats.fdr(df, "p", keys=["g"]).where("g = 'g'").collect()}
    assert grouped.keys() == alone.keys() and all(grouped[k] == pytest.approx(alone[k]) for k in alone if alone[k] is not None)
    assert stats.fdr(df.limit(0), "p").count() == 0


@pytest.mark.parametrize("block", [10**6, 17])
def test_nearest_donors_are_those_of_all_rows(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 3))
    x[rng.random(x.shape) < 0.25] = np.nan
    x[5], x[6] = np.nan, [1.0, np.nan, 2.0]
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(k, *[None if np.isnan(v) else float(v) for v in row]) for k, row in enumerate(x)], "row_index long, a double, b double, c double")
    got = {r.row_index: [r.a, r.b, r.c] for r in impute.knn_fill(df, names, 4, block).collect()}
    for i, row in enumerate(x):
        for j in range(3):
            want = None if np.isnan(row[j]) else row[j]
            if want is None and not np.isnan(row).all():
                both = ~np.isnan(x) & ~np.isnan(row)
                d = np.sqrt(np.where(both, (x - row) ** 2, 0).sum(1) * 3 / np.maximum(both.sum(1), 1))
                d[(both.sum(1) == 0) | np.isnan(x[:, j])] = np.inf
                near = np.argsort(d, kind="stable")[:4]
                near = near[np.isfinite(d[near])]
                w = 1 / d[near]
                want = (w * x[near, j]).sum() / w.sum()
            assert got[i][j] == (None if want is None else pytest.approx(want))


def test_profiles_of_radii(spark):
    rows = [(None, None, None), (0.1, 0.05, None), (0.5, 0.2, 0.3), (0.5, -0.2, None), (-0.1, 0.3, 0.2), (-0.1, 0.0, None)]
    got = [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a double, b double, c double").orderBy("k").select(cases.profile_class(*(F.col(c) for c in "abc"))).collect()]
    assert got == ["no_deficit_or_overpopulated", "small_but_stable_deficit", "stable_positive_deficit", "unstable_due_to_large_radius", "radius_sensitive_deficit", "no_deficit_or_overpopulated"]


def test_deficits_under_other_names(spark):
    df = spark.createDataFrame([("a", "n", "r_kNN", 1.0, 3.0)], "pl_name string, node string, radius string, n_obs double, expected_neighbors double")
    r = cases.recomputed(df).first()
    assert (r.anchor_pl_name, r.delta_N_neighbors_recomputed, r.deficit_formula_check) == ("a", 2.0, "mismatch_recomputed_used")
    with pytest.raises(ValueError, match="N_exp_neighbors"):
        cases.recomputed(df.drop("expected_neighbors"))


def test_cases_of_nothing(spark):
    anchors = spark.createDataFrame([], ANCHORS)
    deficits = cases.recomputed(spark.createDataFrame([], "anchor_pl_name string, node_id string, radius_type string, N_obs double, N_exp_neighbors double"))
    regions = spark.createDataFrame([], "node_id string, TOI double, I_R3 double, n_members long, S_net double")
    robust = cases.robust_anchors(anchors, cases.stability(deficits, anchors, regions))
    for out in (robust, cases.observational_priority(robust), cases.technical_issues(robust, deficits), cases.repeated_anchors(anchors), cases.future_cases(cases.region_robustness(regions), robust), cases.presentation_cases(regions, anchors), cases.detailed_cases(anchors), cases.registry(cases.region_robustness(regions), robust, robust), cases.by_radius(deficits)):
        assert out.count() == 0


def test_repeated_anchors_and_members_stand_for_them(spark):
    anchors = spark.createDataFrame([("a", "n2", 0.5, 0.1, 0.0, 0.0, 1.0), ("a", "n1", 0.4, None, 0.0, 0.0, 1.0), ("b", "n1", 0.9, 0.3, 0.0, 0.0, 1.0), (None, "n3", None, None, None, None, None)], ANCHORS)
    r = cases.repeated_anchors(anchors).collect()
    assert [(x.anchor_pl_name, x.n_nodes_as_anchor, x.nodes_list, x.max_ATI) for x in r] == [("a", 2, "n1, n2", 0.5)]
    regions = spark.createDataFrame([("n1", 0.2), ("n0", 0.2), ("n9", None)], "node_id string, TOI double")
    got = {x.case_type: (x.anchor_pl_name, x.node_id) for x in cases.presentation_cases(regions, anchors.where("node_id = 'n1'"), spark.createDataFrame([("m", "n5"), ("m", "n4")], "pl_name string, node_id string")).collect()}
    assert got == {"top_toi_region": (None, "n0"), "top_ati_anchor": ("b", "n1"), "repeated_anchor_multi_node": ("m", "n4")}


def test_regions_without_evidence(spark):
    r = synthesis.classified(spark.createDataFrame([("c", "node", "1", None)], "config_id string, region_type string, region_id string, n_members long")).first()
    assert (r.physical_evidence_score, r.observational_bias_score, r.imputation_risk_score, r.final_label, r.confidence) == (0.0, 0.0, 0.85, "weak", "high")
    assert r.rationale_short == "physical_score=0.00; bias_score=0.00; imputation_risk=0.85"


def test_confidence_of_unknowns(spark):
    rows = [(0.3, 0.05, 0.5), (0.3, None, 0.5), (0.16, 0.2, None), (None, 0.0, 1.0)]
    got = [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, s double, i double, d double").orderBy("k").select(labels.confidence(F.col("s"), F.col("i"), F.col("d"))).collect()]
    assert got == ["higher", "lower", "medium", "lower"]


def test_node_tables_and_rings(spark):
    members = spark.createDataFrame([("c", "n1", 1, 2.0, True), ("c", "n1", 1, 2.0, True), ("c", "n1", 2, None, False), ("c", "n2", 2, None, False), ("c", "n3", 3, 5.0, False)], "config_id string, node_id string, row_index long, x double, x_was_imputed boolean")
    edges = spark.createDataFrame([("c", "n1", "n2"), ("c", "n2", "n1"), ("c", "n2", "n3"), ("c", "n2", "n2")], "config_id string, source string, target string")
    got = {r.node_id: r for r in nodes.node_table(members, edges, ["x", "absent"]).collect()}
    assert (got["n1"].n_members, got["n1"].degree, got["n1"].mean_x, got["n1"].frac_x_imputed, got["n2"].degree) == (2, 1, 2.0, 0.5, 2)
    rings = {(r.node_id, r.region_type, r.row_index) for r in context.region_membership(members, edges).collect()}
    assert {x for x in rings if x[0] == "n1"} == {("n1", "node", 1), ("n1", "node", 2), ("n1", "N1", 2), ("n1", "N2", 3)}
    empty = members.limit(0)
    assert nodes.node_table(empty, edges.limit(0), ["x"]).count() == context.region_membership(empty, edges.limit(0)).count() == 0


def test_analogs_of_nodes_are_those_of_all_pairs(spark):
    rows = [("c", f"n{k}", float(k), 0.0, 0.0, 0.1 * k, 10, 1.0) for k in range(6)] + [("c", "x", None, 0.0, 0.0, 0.0, 10, 1.0), ("d", "one", 0.0, 0.0, 0.0, 0.0, 10, 1.0)]
    df = spark.createDataFrame(rows, "config_id string, node_id string, c_0 double, c_1 double, c_2 double, shadow_score double, n_members long, r3_valid_fraction double")
    got = {(r.node_id, r.analog_node) for r in context.analog_nodes(df, reach=0.3).collect()}
    assert got == {(f"n{a}", f"n{b}") for a in range(6) for b in range(6) if abs(a - b) == 1 and b <= 2}


def test_priors_of_flat_and_missing_scores(spark):
    flat = spark.createDataFrame([("n1", 2.0), ("n2", 2.0), ("n3", None)], "node_id string, TOI double")
    scores = {r.node_id: (r.planet_TOI_norm, r.planet_shadow_norm) for r in priors.node_scores(flat).collect()}
    assert scores == {"n1": (1.0, None), "n2": (1.0, None), "n3": (0.0, None)}
    members = spark.createDataFrame([("m", "n1"), ("m", "n9"), (None, "n1"), ("k", "n9")], "pl_name string, node_id string")
    prior = priors.member_prior(priors.node_scores(flat), members)
    assert {r.pl_name: r.topology_prior_planet for r in prior.collect()} == {"m": 1.0, "k": 0.0}
    gap = priors.attach_topology(spark.createDataFrame([(1, "m", "k"), (2, "z", None)], "id int, inner_planet string, outer_planet string"), prior)
    assert {r.id: r.topology_score for r in gap.collect()} == {1: 1.0, 2: 0.0}


def test_final_cases_do_not_go_by_the_order_of_equal_rows(spark):
    regions = cases.region_robustness(spark.createDataFrame([("n1", 0.2)], "node_id string, TOI double"))
    rows = [("a", "n1", ati, 0.0, 0.0, 3, "small_but_stable_deficit", 1 - k) for k, ati in enumerate((0.9, 0.5, 0.3, 0.1))]
    kinds = "anchor_pl_name string, node_id string, ATI_original double, ATI_conservative double, stable_deficit_score double, n_members long, deficit_stability_class string, rank_shift long"
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = {r.case_type: r.rank_shift for r in cases.future_cases(regions, spark.createDataFrame(order, kinds).coalesce(1)).collect()}
        assert got["top_ati_conservative_anchor"] == got["stable_deficit_anchor"] == 1
