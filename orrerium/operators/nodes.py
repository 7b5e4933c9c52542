"""Tables of a Mapper graph's nodes: what each holds and where it comes from, which stand out, and summaries of them.

Nodes of a graph follow its cover, thousands and not rows of a catalogue: thresholds over them are one-row broadcasts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrerium.functions import labels
from orrerium.functions.numeric import to_numeric, truthy
from orrerium.operators.graph import KEY, both_ways, simple

#: Main graphs with the priority and caution of their reading; classes that a node's members are shared out to.
MAIN_GRAPHS = {
    "phys_min_pca2_cubes10_overlap0p35": ("primary", "low"),
    "phys_density_pca2_cubes10_overlap0p35": ("control", "moderate"),
    "orbital_pca2_cubes10_overlap0p35": ("primary", "low"),
    "joint_no_density_pca2_cubes10_overlap0p35": ("primary", "moderate"),
    "joint_pca2_cubes10_overlap0p35": ("control", "moderate"),
    "thermal_pca2_cubes10_overlap0p35": ("cautionary", "high"),
}
CLASSES = {
    "radius_class": {"rocky_size": "frac_radius_rocky_size", "sub_neptune_size": "frac_radius_sub_neptune_size", "neptune_or_sub_jovian_size": "frac_radius_neptune_or_sub_jovian_size", "jovian_size": "frac_radius_jovian_size"},
    "density_class": {"high_density": "frac_density_high", "intermediate_density": "frac_density_intermediate", "low_density": "frac_density_low"},
    "orbit_class": {"short_period": "frac_orbit_short_period", "intermediate_period": "frac_orbit_intermediate_period", "long_period": "frac_orbit_long_period"},
    "thermal_class": {"very_hot": "frac_thermal_very_hot", "hot": "frac_thermal_hot", "warm": "frac_thermal_warm", "cool": "frac_thermal_cool"},
}
ORIGINS = ("observed", "physically_derived", "imputed")
#: Columns whose extremes are a reason to look at a node.
EXTREMES = {"mean_pl_bmasse": "extreme_mass", "mean_pl_orbper": "extreme_orbital_period", "mean_pl_eqt": "extreme_temperature", "mean_pl_insol": "extreme_insolation", "mean_pl_dens": "extreme_density"}


def flag(c: str) -> Column:
    return F.when(truthy(c), 1.0).otherwise(0.0)


def row_imputation(df: DataFrame, features: Sequence[str]) -> Column:
    """Share of the features with a was_imputed flag that are imputed; 0 without flags."""
    flags = [flag(f"{f}_was_imputed") for f in features if f"{f}_was_imputed" in df.columns]
    return sum(flags, F.lit(0.0)) / max(len(flags), 1)


def any_flag(df: DataFrame, suffix: str) -> Column:
    """Whether any column of the suffix is set; false without such columns."""
    out = F.lit(False)
    for c in df.columns:
        if c.endswith(suffix):
            out = out | truthy(c)
    return out


def most_frequent(df: DataFrame, keys: Sequence[str], label: str, out: str) -> DataFrame:
    """keys, the most frequent label of each group; ties in label order; null and blank ones don't count."""
    counts = df.where(F.trim(F.col(label).cast("string")) != "").groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias(out))


def node_table(members: DataFrame, edges: DataFrame, features: Sequence[str], components: DataFrame | None = None) -> DataFrame:
    """One row a node: size, degree, statistics and origins of each feature, traceability, most frequent classes and class shares.

    members: config_id, node_id, row_index, the features with their `_was_*` flags and `_source`, and any of lens_1, lens_2,
    disc_year, discoverymethod and the class columns; each member counts once in a node. edges: config_id, source, target.
    components: config_id, node_id, component_id. A node without neighbours has degree 0.
    """
    keys = (KEY, "node_id")
    have = set(members.columns)
    rows = members.dropDuplicates([*keys, "row_index"]).withColumns({"imputation_fraction_row": row_imputation(members, features), "_imputed": any_flag(members, "_was_imputed"), "_derived": any_flag(members, "_was_physically_derived")})
    aggs = [F.count(F.lit(1)).alias("n_members")]
    for c in ("lens_1", "lens_2"):
        if c in have:
            aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    shares: dict[str, list[Column]] = {o: [] for o in ORIGINS}
    for f in (f for f in features if f in have):
        x = to_numeric(f)
        aggs += [F.avg(x).alias(f"mean_{f}"), F.median(x).alias(f"median_{f}"), F.percentile(x, 0.25).alias(f"q25_{f}"), F.percentile(x, 0.75).alias(f"q75_{f}")]
        for o in ORIGINS:
            if f"{f}_was_{o}" in have:
                aggs.append(F.avg(flag(f"{f}_was_{o}")).alias(f"frac_{f}_{o}"))
                shares[o].append(F.col(f"frac_{f}_{o}"))
    aggs += [F.avg("imputation_fraction_row").alias("mean_imputation_fraction"), F.median("imputation_fraction_row").alias("median_imputation_fraction"), F.max("imputation_fraction_row").alias("max_imputation_fraction")]
    aggs += [F.count_if(c).alias(f"n_any_{n}") for c, n in (("_imputed", "imputed"), ("_derived", "physically_derived"))]
    if "disc_year" in have:
        year = to_numeric("disc_year")
        aggs += [F.median(year).alias("disc_year_median"), F.min(year).alias("disc_year_min"), F.max(year).alias("disc_year_max")]
    for label, kinds in CLASSES.items():
        if label in have:
            aggs += [F.avg(F.when(F.col(label) == k, 1.0).otherwise(0.0)).alias(name) for k, name in kinds.items()]
    out = rows.groupBy(*keys).agg(*aggs)
    out = out.withColumns({f"{o}_fraction": sum(s, F.lit(0.0)) / max(len(s), 1) for o, s in shares.items()})
    out = out.withColumns({f"frac_any_{n}": F.col(f"n_any_{n}") / F.col("n_members") for n in ("imputed", "physically_derived")})
    degree = both_ways(simple(edges)).groupBy(KEY, F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    out = out.join(degree, list(keys), "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    tops = {"discoverymethod": "discoverymethod_top", **{c: f"{c}_top" for c in (*CLASSES, "candidate_population")}, **{f"{f}_source": f"dominant_{f}_source" for f in features}}
    for c, name in tops.items():
        if c in have:
            out = out.join(most_frequent(rows, keys, c, name), list(keys), "left")
    return out.join(components, list(keys), "left") if components is not None else out


def main_graphs(metrics: DataFrame) -> DataFrame:
    """The graphs to read first, with the priority and caution of their reading."""
    known = metrics.sparkSession.createDataFrame([(c, p, k) for c, (p, k) in MAIN_GRAPHS.items()], "config_id string, interpretation_priority string, caution_level string")
    kept = [c for c in ("n_nodes", "n_edges", "beta_1", "mean_node_imputation_fraction", "frac_nodes_high_imputation", "mean_node_physically_derived_fraction") if c in metrics.columns]
    return metrics.select("config_id", *kept).join(F.broadcast(known), "config_id")


def highlights(nodes: DataFrame) -> DataFrame:
    """Nodes that stand out, each with its reasons in alphabetical order; thresholds are quantiles over all nodes.

    beta_1_component, if there, tells nodes of components with a cycle.
    """
    have = set(nodes.columns)
    cuts = {"size": ("n_members", 0.9), "degree": ("degree", 0.9), "large": ("mean_pl_rade", 0.95), "small": ("mean_pl_rade", 0.05)} | {name: (c, 0.95) for c, name in EXTREMES.items()}
    cuts = {k: v for k, v in cuts.items() if v[0] in have}
    ends = nodes.agg(*[F.percentile(c, q).alias(f"_{k}") for k, (c, q) in cuts.items()])
    rows = nodes.crossJoin(F.broadcast(ends))  # one row
    rules = {"size": "large_node", "degree": "central_node", "large": "extreme_large_radius"} | {name: name for name in EXTREMES.values()}
    said = [F.when(F.col(cuts[k][0]) >= F.col(f"_{k}"), name) for k, name in rules.items() if k in cuts]
    if "small" in cuts:
        said.append(F.when(F.col("mean_pl_rade") <= F.col("_small"), "extreme_small_radius"))
    if "beta_1_component" in have:
        said.append(F.when((F.col("beta_1_component") > 0) & (F.col("degree") >= 2), "cycle_component_node"))

    def number(c: str, default: float) -> Column:
        return F.coalesce(to_numeric(c), F.lit(default)) if c in have else F.lit(default)

    imputed, touched = "mean_imputation_fraction", "frac_any_imputed"
    said.append(F.when((number(imputed, 1.0) < 0.15) & (number(touched, 1.0) < 0.30), "reliable_node"))
    said.append(F.when((number(imputed, 0.0) >= 0.30) | (number(touched, 0.0) >= 0.50), "risky_node"))
    said.append(F.when(number("physically_derived_fraction", 0.0) >= 0.30, "derived_dominated_node"))
    reasons = F.array_sort(F.array_compact(F.array(*said)))
    return rows.withColumn("highlight_reason", F.array_join(reasons, ";")).where(F.col("highlight_reason") != "").drop(*ends.columns)


def component_table(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a component: nodes, distinct members, inner edges, cycles (edges - nodes + 1), mean node size, and by its distinct
    members the mean imputed and derived shares and the most frequent classes.

    members: config_id, node_id, row_index and any class, imputation_fraction and derived_fraction columns; nodes: config_id,
    node_id, component_id, n_members.
    """
    keys = (KEY, "component_id")
    at = nodes.select(KEY, "node_id", "component_id")
    inner = simple(edges).join(at.withColumnRenamed("node_id", "source"), [KEY, "source"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges_internal"))
    out = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("n_members").alias("mean_node_size")).join(inner, list(keys), "left")
    out = out.withColumn("n_edges_internal", F.coalesce("n_edges_internal", F.lit(0)).cast("long"))
    out = out.withColumn("beta_1_component", F.greatest(F.col("n_edges_internal") - F.col("n_nodes") + 1, F.lit(0)))
    rows = members.join(at, [KEY, "node_id"]).drop("node_id").dropDuplicates([*keys, "row_index"])
    means = [F.avg(to_numeric(c)).alias(f"mean_{c}") for c in ("imputation_fraction", "derived_fraction") if c in members.columns]
    out = out.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_members_unique"), *means), list(keys), "left")
    for c in (c for c in (*CLASSES, "candidate_population") if c in members.columns):
        out = out.join(most_frequent(rows, keys, c, f"dominant_{c}"), list(keys), "left")
    return out


def physical_gaps(nodes: DataFrame, edges: DataFrame, variables: Sequence[str]) -> DataFrame:
    """For each variable the mean over a node's neighbours, the node's distance from it, plain and in units of the spread of all
    nodes of the configuration, and the length of the scaled distances (null if none is known). nodes: mean_<variable> columns."""
    present = [v for v in variables if f"mean_{v}" in nodes.columns]
    near = both_ways(simple(edges)).select(KEY, F.col("source").alias("node_id"), F.col("target").alias("_other"))
    means = nodes.select(KEY, F.col("node_id").alias("_other"), *[F.col(f"mean_{v}") for v in present])
    beside = near.join(means, [KEY, "_other"]).groupBy(KEY, "node_id").agg(*[F.avg(to_numeric(f"mean_{v}")).alias(f"neighbor_mean_{v}") for v in present])
    spread = nodes.groupBy(KEY).agg(*[F.stddev_pop(to_numeric(f"mean_{v}")).alias(f"_sd_{v}") for v in present])
    out = nodes.join(beside, [KEY, "node_id"], "left").join(F.broadcast(spread), KEY)  # a row a configuration
    for v in present:
        gap = to_numeric(f"mean_{v}") - F.col(f"neighbor_mean_{v}")
        out = out.withColumns({f"delta_{v}": gap, f"scaled_delta_{v}": F.when(F.col(f"_sd_{v}") > 0, gap / F.col(f"_sd_{v}"))})
    squares = F.filter(F.array(*[F.col(f"scaled_delta_{v}") for v in present]).cast("array<double>"), lambda x: x.isNotNull())
    length = F.when(F.size(squares) > 0, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x * x)))
    return out.withColumn("physical_neighbor_distance", length).drop(*spread.columns[1:])


def shadow_by_component(nodes: DataFrame) -> DataFrame:
    """One row a configuration and component; the most frequent top method, ties in label order."""
    keys = (KEY, "component_id")
    out = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n_members").alias("n_members"), F.avg("shadow_score").alias("mean_shadow_score"), F.max("shadow_score").alias("max_shadow_score"), F.avg("mean_imputation_fraction").alias("mean_imputation_fraction"), F.avg(_high().cast("double")).alias("fraction_high_confidence_shadow"))
    return out.join(most_frequent(nodes, keys, "top_method", "dominant_method"), list(keys), "left").withColumn("dominant_method", F.coalesce("dominant_method", F.lit("Unknown")))


def _high() -> Column:
    return F.coalesce(F.col("shadow_class") == "high_confidence_shadow", F.lit(False))


def shadow_by_method(nodes: DataFrame) -> DataFrame:
    """One row a top method (null is one)."""
    return nodes.groupBy("top_method").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("shadow_score").alias("mean_shadow_score"), F.median("shadow_score").alias("median_shadow_score"), F.count_if(_high()).alias("n_high_confidence_shadow"), F.avg("mean_imputation_fraction").alias("mean_imputation_fraction"))


def shadow_by_config(nodes: DataFrame) -> DataFrame:
    """One row a configuration, with the top method of its node of the greatest score (ties by node)."""
    best = F.max_by("top_method", F.when(F.col("top_method").isNotNull(), F.struct(F.coalesce("shadow_score", F.lit(-1.0)), F.col("node_id"))))
    out = nodes.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("shadow_score").alias("mean_shadow_score"), F.median("shadow_score").alias("median_shadow_score"), F.max("shadow_score").alias("max_shadow_score"), F.count_if(_high()).alias("n_high_confidence_shadow"), F.avg("mean_imputation_fraction").alias("mean_imputation_fraction"), best.alias("dominant_shadow_method"))
    return out.withColumn("dominant_shadow_method", F.coalesce("dominant_shadow_method", F.lit("Unknown")))


def top_shadow(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.orderBy(F.col("shadow_score").desc_nulls_last(), KEY, "node_id").limit(n)


def top_methods(nodes: DataFrame, n: int = 6) -> DataFrame:
    """The n most frequent top methods among nodes of high confidence."""
    counts = nodes.where(_high()).groupBy("top_method").agg(F.count(F.lit(1)).alias("n_nodes"))
    return counts.orderBy(F.desc("n_nodes"), "top_method").limit(n)


def direction(nodes: DataFrame) -> DataFrame:
    """expected_direction by the node's top method, and which of its means bear that out against the neighbours'."""
    have = set(nodes.columns)
    m = F.lower(F.trim(F.coalesce(F.col("top_method"), F.lit(""))))

    def beyond(v: str, above: bool = True) -> Column:
        if f"mean_{v}" not in have or f"neighbor_mean_{v}" not in have:
            return F.lit(False)
        a, b = to_numeric(f"mean_{v}"), to_numeric(f"neighbor_mean_{v}")
        return F.coalesce(a > b if above else a < b, F.lit(False))

    signs = [
        F.when((m == "transit") & beyond("pl_rade"), "larger_radius"),
        F.when((m == "transit") & beyond("pl_orbper", above=False), "shorter_period"),
        F.when((m == "radial velocity") & beyond("pl_bmasse"), "larger_mass"),
        F.when((m == "imaging") & beyond("pl_orbsmax"), "wider_orbit"),
    ]
    return nodes.withColumns({"expected_direction": labels.expected_direction(F.col("top_method")), "direction_signs": F.concat_ws(";", *signs)})


# Tests beside nodes -----------------------------------------------------------------------------------------------


def best_enrichment(tests: DataFrame) -> DataFrame:
    """Each node's best test: least q, then greatest z, then method."""
    order = F.struct(F.coalesce("fdr_q_value", F.lit(float("inf"))), -F.coalesce("z_score", F.lit(float("-inf"))), F.col("method"))
    kept = [c for c in ("method", "z_score", "empirical_p_value", "fdr_q_value") if c in tests.columns]
    best = tests.groupBy(KEY, "node_id").agg(F.min_by(F.struct(*kept), order).alias("b"))
    return best.select(KEY, "node_id", *[F.col(f"b.{c}").alias("enriched_method" if c == "method" else c) for c in kept])


def top_enriched(nodes: DataFrame, tests: DataFrame, n: int = 25) -> DataFrame:
    """The n nodes of the least q (then the greatest z) with what they hold."""
    kept = [c for c in ("n_members", "top_method", "top_method_fraction", "mean_imputation_fraction", "is_peripheral") if c in nodes.columns]
    rows = best_enrichment(tests).join(nodes.select(KEY, "node_id", *kept), [KEY, "node_id"], "left")
    return rows.orderBy(F.col("fdr_q_value").asc_nulls_last(), F.col("z_score").desc_nulls_last(), KEY, "node_id").limit(n)


def peripheral_bias(nodes: DataFrame, tests: DataFrame, purity: float = 0.75) -> DataFrame:
    """Peripheral nodes of one method mostly, with their best test."""
    rows = nodes.where(F.coalesce(F.col("is_peripheral"), F.lit(False)) & (to_numeric("top_method_fraction") >= purity))
    return rows.join(best_enrichment(tests).select(KEY, "node_id", "enriched_method", "z_score", "fdr_q_value"), [KEY, "node_id"], "left")


def with_tests(summary: DataFrame, tests: DataFrame) -> DataFrame:
    """Global metrics of each configuration beside the null tests of two of them."""
    wide = tests.groupBy(KEY).agg(
        F.max(F.when(F.col("metric") == "node_method_nmi", F.col("z_score"))).alias("global_nmi_z_score"),
        F.max(F.when(F.col("metric") == "node_method_nmi", F.col("empirical_p_value"))).alias("global_nmi_empirical_p_value"),
        F.max(F.when(F.col("metric") == "weighted_mean_purity", F.col("z_score"))).alias("global_purity_z_score"),
    )
    return summary.join(wide, KEY, "left")


def z_matrix(tests: DataFrame, n: int) -> DataFrame:
    """z of the n methods of the greatest z as columns `z_<k>` in their order, a row a node; `methods` names them."""
    top = tests.groupBy("method").agg(F.max("z_score").alias("m")).orderBy(F.col("m").desc_nulls_last(), "method").limit(n)
    ranked = top.withColumn("k", F.row_number().over(Window.orderBy(F.col("m").desc_nulls_last(), "method")))
    rows = tests.join(F.broadcast(ranked.select("method", "k")), "method")
    return rows.groupBy(KEY, "node_id").agg(*[F.max(F.when(F.col("k") == k, F.col("z_score"))).alias(f"z_{k}") for k in range(1, n + 1)])


# Graphs beside each other -----------------------------------------------------------------------------------------


def lens_sensitivity(metrics: DataFrame, base: str = "pca2") -> DataFrame:
    """Each graph with the lenses of its feature space and cover, and its distance from the base lens's graph."""
    group = ["feature_space", "n_cubes", "overlap"]
    measured = [c for c in ("n_nodes", "n_edges", "beta_0", "beta_1", "mean_node_size", "mean_node_imputation_fraction") if c in metrics.columns]
    lenses = metrics.groupBy(*group).agg(F.array_sort(F.collect_set("lens")).alias("_l"), *[F.min_by(c, "config_id").alias(f"_{c}") for c in ()])
    start = metrics.where(F.col("lens") == base).groupBy(*group).agg(F.min_by(F.struct(*measured), "config_id").alias("_b"))
    out = metrics.join(lenses, group).join(start, group, "left")
    out = out.withColumns({"available_lenses_in_group": F.array_join("_l", ", "), "n_lenses_in_group": F.size("_l").cast("long")})
    return out.withColumns({f"delta_{c}_vs_{base}": F.col(c) - F.col(f"_b.{c}") for c in measured}).drop("_l", "_b")


def space_comparison(metrics: DataFrame) -> DataFrame:
    """Each graph with the feature spaces of its lens and cover."""
    group = ["lens", "n_cubes", "overlap"]
    spaces = metrics.groupBy(*group).agg(F.array_sort(F.collect_set("feature_space")).alias("_s"))
    return metrics.join(spaces, group).withColumns({"available_spaces_in_group": F.array_join("_s", ", "), "n_spaces_in_group": F.size("_s").cast("long")}).drop("_s")


def density_sensitivity(metrics: DataFrame, pairs: Sequence[tuple[str, str]] = (("phys_min", "phys_density"), ("joint_no_density", "joint")), lens: str = "pca2") -> DataFrame:
    """What the density feature changes: differences of each pair's graphs of one lens (the first by config_id)."""
    measured = [c for c in ("n_nodes", "n_edges", "beta_1", "average_degree", "mean_node_imputation_fraction", "mean_node_physically_derived_fraction") if c in metrics.columns]
    first = metrics.where(F.col("lens") == lens).groupBy("feature_space").agg(F.min_by(F.struct(*measured), "config_id").alias("_m"))
    known = metrics.sparkSession.createDataFrame(list(pairs), "without_density string, with_density string")
    a = first.select(F.col("feature_space").alias("without_density"), F.col("_m").alias("_a"))
    b = first.select(F.col("feature_space").alias("with_density"), F.col("_m").alias("_b"))
    rows = known.join(F.broadcast(a), "without_density").join(F.broadcast(b), "with_density")  # a row a feature space
    return rows.select(F.concat_ws("_vs_", "without_density", "with_density").alias("comparison"), "without_density", "with_density", *[(F.col(f"_b.{c}") - F.col(f"_a.{c}")).cast("double").alias(f"delta_{c}") for c in measured])


def split_node_id(node_id: Column) -> tuple[Column, Column]:
    """(cube, cluster) of `<cube>_cluster<n>`; both null without the mark, the cluster null if it is no whole number."""
    parts = F.split(node_id, "_cluster", 2)
    marked = F.size(parts) == 2
    return F.when(marked, parts[0]), F.when(marked, F.try_element_at(parts, F.lit(2))).try_cast("int")
