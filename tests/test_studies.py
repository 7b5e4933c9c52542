import random

import pytest
from pyspark.sql import functions as F

from orrerium.operators import impute, mapper, regions, studies

CANDIDATE = "candidate_id string, hostname string, candidate_period_days double, candidate_priority_class string, dominant_discoverymethod_system string, likely_missing_due_to string, candidate_priority_score double, gap_period_ratio double, missing_detectability_score double, inner_planet string, outer_planet string"


def made(spark, n, seed, methods=("Transit", "Radial Velocity", "Mixed", None), classes=("high", "medium", None)):
    draw = random.Random(seed)
    rows = [(f"k{i:03}", draw.choice([*"abcdefg", None]), draw.choice([None, 1.0, 9.5]), draw.choice(classes), draw.choice(methods), draw.choice(["weak_RV_signal", "long_period", None]), draw.choice([0.5, 0.7, 0.9]), draw.choice([2.0, None, 5.0]), draw.random(), "b", None) for i in range(n)]
    return rows, spark.createDataFrame(rows, CANDIDATE)


@pytest.mark.parametrize("n,seed", [(0, 0), (3, 1), (40, 2), (200, 3), (200, 4)])
def test_case_studies_against_a_plain_search(spark, n, seed):
    rows, df = made(spark, n, seed)
    specs = (studies.Study(1, "top_ranked_visual_case", ("c",), ("Transit",)), studies.Study(2, "radial_velocity_like_case", ("a", "b"), ()), studies.Study(3, "mixed_or_fallback_case", (), ("Transit",)))
    systems = spark.createDataFrame([(h, k) for k, h in enumerate("abcde")], "hostname string, n_observed_planets long")
    want, used = [], set()
    for s in specs:
        fits = [r for r in rows if r[1] and r[2] is not None and r[3] == "high" and r[1] not in used]
        if s.rank == 1:
            fits = [r for r in fits if r[4] == "Transit"]
        if s.rank == 2:
            fits = [r for r in fits if r[5] == "weak_RV_signal"]
        kind = lambda r: 0 if s.rank < 3 or r[4] == "Mixed" else 1 if r[4] == "Transit" else 2
        fits.sort(key=lambda r: (kind(r), r[1] not in s.hosts, -r[6], -(r[7] or -1), -r[8], r[0]))
        if fits:
            want.append((s.rank, fits[0][0]))
            used.add(fits[0][1])
    got = studies.case_studies(df, systems, specs).orderBy("case_rank").collect()
    assert [(r.case_rank, r.candidate_id) for r in got] == want
    assert all(r.reading and r.followup and r.caution_note for r in got)
    assert all(r.n_observed_planets == (ord(r.hostname) - 97 if r.hostname < "f" else None) for r in got)


def test_decompositions_and_profiles(spark):
    rows = spark.createDataFrame([("c", "n1", 0.5, 0.2, 0.5, None, 0.3, 7), ("c", "n2", 0.5, 0.5, 0.5, 0.5, 0.07, 8), ("d", "n2", None, None, None, None, None, 9)], "config_id string, node_id string, shadow_score double, I_R3 double, C_phys double, S_net double, TOI double, n_members long")
    parts = studies.toi_parts(rows)
    a, b, c = parts.orderBy("config_id", "node_id").collect()
    assert (a.TOI_recomputed, a.TOI_abs_error, a.dominant_toi_driver) == (None, None, "bottleneck=shadow_score; strongest=low_imputation")
    assert b.TOI_recomputed == pytest.approx(0.0625) and b.TOI_abs_error == pytest.approx(0.0075) and b.dominant_toi_driver == "bottleneck=shadow_score; strongest=shadow_score"
    assert (c.TOI_recomputed, c.dominant_toi_driver) == (None, "unknown")
    got = studies.region_profiles(rows, parts, 2)
    assert got.columns == [c for c in studies.REGION_PROFILE if c in {*rows.columns, "dominant_toi_driver"}]
    assert [(r.config_id, r.node_id, r.dominant_toi_driver) for r in got.orderBy(F.desc("TOI")).collect()] == [("c", "n1", a.dominant_toi_driver), ("c", "n2", b.dominant_toi_driver)]
    held = spark.createDataFrame([("n1", "x", 0.5, -0.2, 0.0, 0.5, 0.0), ("n1", None, 0.5, None, 0.0, 0.5, 0.1)], "node_id string, anchor_pl_name string, TOI double, delta_rel_neighbors_best double, r3_imputation_score double, anchor_representativeness double, ATI double")
    x, y = studies.ati_parts(held).orderBy(F.desc_nulls_last("anchor_pl_name")).collect()
    assert (x.ATI_recomputed, x.dominant_ati_driver) == (0.0, "bottleneck=local_deficit; strongest=anchor_low_imputation")
    assert y.ATI_recomputed is None and y.dominant_ati_driver == "bottleneck=TOI_region; strongest=anchor_low_imputation"
    assert studies.anchor_profiles(held, studies.ati_parts(held)).count() == 2 and studies.region_profiles(rows.limit(0), parts).count() == 0


def test_local_cases_keep_nodes_without_anchor(spark):
    draw = random.Random(5)
    rows = []
    for i in range(90):
        m, p, a = (10 ** draw.uniform(0, 2) for _ in range(3))
        for node in sorted({f"n{draw.randrange(4)}" for _ in range(2)}):
            rows.append(("c", node, i, m, p, a if i % 9 else None, draw.choice(["Radial Velocity", "Transit", None]) if node != "n3" else "Transit", None if i % 4 else f"p{i}"))
    rows.append(("c", "empty", 500, 1.0, 1.0, None, "Transit", "q"))
    members = regions.r3(spark.createDataFrame(rows, "config_id string, node_id string, row_index long, pl_bmasse double, pl_orbper double, pl_orbsmax double, discoverymethod string, pl_name string")).cache()
    edges = mapper.nerve(members)
    nodes = members.select("config_id", "node_id").distinct().withColumns({"shadow_score": F.lit(0.3), "I_R3": F.lit(None).cast("double")})
    a = studies.local_anchors(members, nodes)
    long = regions.deficits(a, members, edges).withColumn("delta_rel_analog", F.lit(None).cast("double"))
    ways = studies.missing_direction(a, members, edges)
    got = {r.node_id: r for r in studies.compare_cases(nodes, a, long, ways).collect()}
    assert set(got) == {"n0", "n1", "n2", "n3", "empty"}
    e = got["empty"]
    assert (e.anchor, e.expected_missing_direction, e.deficit_class, e.confidence_level) == (None, "not_available", "no_deficit", "lower") and "unknown" in e.final_interpretation
    assert got["n3"].selection_reason.startswith("no_preferred") and all(got[n].selection_reason.startswith("preferred") for n in ("n0", "n1", "n2"))
    # Medians by hand: a member of several neighbours counts once.
    import math
    import statistics

    proxy = {r[2]: math.log10(r[3]) - math.log10(r[4]) / 3 for r in rows}
    stands = {}
    for r in rows:
        stands.setdefault(r[1], set()).add(r[2])
    near = {n: {m for m in stands if m != n and stands[m] & stands[n]} for n in stands}
    for r in ways.collect():
        ring = {i for m in near[r.node_id] for i in stands[m] if i % 9 and i != 500}
        assert r.node_rv_proxy == pytest.approx(statistics.median(proxy[i] for i in stands[r.node_id]))
        assert r.reference_rv_proxy == pytest.approx(statistics.median(proxy[i] for i in ring))
        assert (r.expected_missing_direction == "lower_rv_proxy_at_like_orbit") == (r.node_rv_proxy >= r.reference_rv_proxy)


def test_mapper_tables_scale_their_own_rows(spark):
    import numpy as np

    rows = [(i, float(i + 1) if i % 3 else None, 10.0 * (i + 1) if i % 5 else -1.0, "imputed_knn" if i % 4 == 0 else "observed", None if i == 7 else "observed", i % 3 == 0, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "row_index long, pl_rade double, pl_bmasse double, pl_rade_source string, pl_bmasse_source string, pl_rade_was_missing boolean, hostname string")
    tables = impute.mapper_tables(df, stellar=True, eccentricity=True)
    assert list(tables) == [f"{g}_{k}" for k in ("complete", "imputed") for g in ("phys", "orb", "joint")]
    whole = {r.row_index: r for r in tables["phys_complete"].collect()}
    assert set(whole) == {i for i in range(40) if i % 3 and i % 4 and i != 7}
    every = {r.row_index: r for r in tables["phys_imputed"].collect()}
    assert set(every) == {i for i in range(40) if i % 3}
    for held in (whole, every):
        x = {i: np.log10(i + 1) for i in held}
        lo, mid, hi = np.percentile(list(x.values()), [25, 50, 75])
        assert all(r.pl_rade == pytest.approx((x[i] - mid) / (hi - lo)) and r.original_pl_rade == i + 1 for i, r in held.items())
        # What has no logarithm is null, and its row stays.
        assert all((r.pl_bmasse is None) == (i % 5 == 0) for i, r in held.items())
    assert tables["phys_imputed"].columns == ["row_index", "hostname", "pl_rade", "pl_bmasse", "original_pl_rade", "original_pl_bmasse", "pl_rade_was_missing", "pl_rade_source", "pl_bmasse_source"]
    assert tables["orb_imputed"].columns == ["row_index", "hostname"] and tables["orb_imputed"].count() == 40
    assert impute.mapper_table(df.limit(0), impute.PHYSICAL, True).count() == 0


def test_method_comparison_equals_single_builds(spark):
    draw = random.Random(9)
    rows = [(i, draw.gauss(i % 3, 0.2), draw.gauss(i % 3, 0.2), "imputed_median" if i % 4 == 0 else "observed") for i in range(150)]
    whole = spark.createDataFrame(rows, "row_index long, a double, b double, a_source string")
    some = whole.where("a_source = 'observed'")
    spaces = {"phys_min": ("a", "b")}
    configs = mapper.grid(["phys_min"], ["pca2"], [3, 5], [0.35])
    metrics, there = mapper.compare_methods({"median": whole, "complete_case": some, "knn": None, "iterative": whole.limit(0)}, configs, spaces, {"phys_min": 0.3})
    assert {(r.input_method, r.available, r.n_rows) for r in there.collect()} == {("median", True, 150), ("complete_case", True, some.count()), ("knn", False, 0), ("iterative", False, 0)}
    got = {(r.input_method, r.config_id): r for r in metrics.collect()}
    assert set(got) == {(m, c.id) for m in ("median", "complete_case") for c in configs}
    for method, points in (("median", whole), ("complete_case", some)):
        for c in configs:
            members, edges = mapper.build(points, ["a", "b"], 0.3, c)
            r = got[method, c.id]
            nodes = {}
            for x in members.collect():
                nodes.setdefault(x.node_id, []).append(0.5 if x.row_index % 4 == 0 else 0.0)
            assert (r.n_nodes, r.n_edges) == (len(nodes), edges.count())
            assert r.mean_node_imputation_fraction == pytest.approx(sum(sum(v) / len(v) for v in nodes.values()) / len(nodes))
    empty, none = mapper.compare_methods({"knn": None}, configs, spaces)
    assert empty.columns == metrics.columns and empty.count() == 0 and none.count() == 1


def test_candidates_of_case_studies_are_worked_out_once(spark):
    _, df = made(spark, 40, 2)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    specs = (studies.Study(1, "top_ranked_visual_case", ("c",), ("Transit",)), studies.Study(2, "radial_velocity_like_case", ("a", "b"), ()), studies.Study(3, "mixed_or_fallback_case", (), ("Transit",)))
    systems = spark.createDataFrame([(h, k) for k, h in enumerate("abcde")], "hostname string, n_observed_planets long")
    assert studies.case_studies(df.mapInPandas(counted, df.schema), systems, specs).count()
    assert seen.value == 40
