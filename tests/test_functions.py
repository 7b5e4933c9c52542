import math

import pytest
from pyspark.sql import functions as F

from orrerium.functions import labels, numeric, physics, stats


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


def test_numeric_nulls(spark):
    got = one(spark, numeric.to_numeric(F.lit("abc")), numeric.to_numeric(F.lit("nan")), numeric.to_numeric(F.lit("2.5")), numeric.safe_log10(F.lit(10)), numeric.safe_log10(F.lit(0)), numeric.safe_log10(F.lit(-1)), numeric.ratio(F.lit(1), F.lit(0)), numeric.clip(F.lit(None).cast("double"), 0, 1), numeric.clip01(F.lit(3.0)))
    assert got == [None, None, 2.5, 1.0, None, None, None, None, 1.0]


def test_physics(spark):
    got = one(spark, physics.density(F.lit(8), F.lit(2)), physics.semi_major_axis(F.lit(365.25), F.lit(1)), physics.density(F.lit(1), F.lit(0)), physics.transit_probability(F.lit(1e9), F.lit(1)), physics.rv_proxy(F.lit(1), F.lit(1), F.lit(1)))
    assert got == [pytest.approx(5.514), pytest.approx(1.0), None, 1.0, 1.0]


def test_labels(spark):
    got = one(spark, labels.radius_class(F.lit(1.6)), labels.size_class(F.lit(1.6)), labels.thermal_class(F.lit(None)), labels.candidate_population(F.lit(9), F.lit(None), F.lit(None), F.lit(3)), labels.star_bin(F.lit(1.2)), labels.canonical_method(F.lit("Transit Timing Variations")), labels.method_family(F.lit("Transit Timing Variations")))
    assert got == ["sub_neptune_size", "rocky_size", "unknown", "hot_jupiter_candidate", "solar_like_star", "Transit", "Timing Variations"]


@pytest.mark.parametrize(("values", "want"), [([0.1, -0.2, -0.1], "radius_sensitive_deficit"), ([0.1, 0.2], "consistent_positive_deficit"), ([-0.1, -0.2], "no_consistent_deficit"), ([0.1, None], "undefined")])
def test_stability(spark, values, want):
    assert one(spark, labels.stability_of(F.array(*[F.lit(v).cast("double") for v in values]))) == [want]


def test_deficit_state(spark):
    got = one(spark, *[labels.deficit_state(F.lit(r).cast("double"), F.lit(e).cast("double")) for r, e in ((0.05, 5), (0.2, 5), (0.5, 5), (0.9, 5), (-0.1, 5), (0.5, 0), (None, 5))])
    assert got == ["no_deficit", "weak_deficit", "moderate_deficit", "strong_deficit", "overpopulated_reference", "undefined_reference", "undefined_reference"]


def test_entropy_and_purity(spark):
    df = spark.createDataFrame([("a", x) for x in "xxxyyz"] + [("b", "x"), ("b", None), ("b", " ")], "k string, v string")
    got = {r.k: r for r in stats.summary(df, ["k"], "v").collect()}
    assert got["a"].top == "x" and got["a"].purity == pytest.approx(0.5) and got["a"].n_kinds == 3
    assert got["a"].entropy == pytest.approx(-(0.5 * math.log(0.5) + math.log(1 / 3) / 3 + math.log(1 / 6) / 6))
    assert got["b"].entropy == 0 and got["b"].n_labelled == 1


def test_fdr(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {r.i: r.q_value for r in stats.fdr(df, "p").collect()}
    assert [got[k] for k in range(5)] == [pytest.approx(0.02), pytest.approx(0.04), pytest.approx(0.04), pytest.approx(0.02), None]


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 2.0), ("a", 9.0, 0.0)], "k string, v double, w double")
    got = stats.weighted_quantiles(df, ["k"], "v", "w", [0.05, 0.5, 0.95]).first()
    assert (got.q05, got.q50, got.q95) == (1.0, pytest.approx(2 + (0.5 - 0.375) / 0.375), 3.0)


def test_mutual_information_of_equal_columns(spark):
    df = spark.createDataFrame([(x, x) for x in "aabbc"], "a string, b string")
    assert stats.mutual_information(df, "a", "b").first().nmi == pytest.approx(1.0)


def test_derived_features_keep_what_is_there(spark):
    from orrerium.functions.derived import derived_features

    rows = [("h", "10", 0.0, None, 7.0), ("h", "x", 1.0, 5000.0, 7.0), (None, None, 2.0, 5000.0, 7.0)]
    df = spark.createDataFrame(rows, "hostname string, pl_orbper string, a_au double, st_teff double, TOI double")
    out = derived_features(df).collect()
    assert len(out) == 3 and {r.TOI for r in out} == {7.0} == {r.topo_toi for r in out}
    assert sorted((r.candidate_pl_orbper or 0, r.n_known_planets or 0) for r in out) == [(0, 0), (0, 2), (10.0, 2)]
    assert all(r.candidate_eqt is None and r.transit_probability_proxy is None and r.topo_node_size is None for r in out)
    again = derived_features(derived_features(df))
    assert len(out[0]) > 30 and again.columns[: len(out[0])] == derived_features(df).columns and again.count() == 3
    assert derived_features(df.drop("hostname").limit(0)).count() == 0
