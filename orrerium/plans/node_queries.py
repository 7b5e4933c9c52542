"""Queries of node tables, summaries and priors. Their inputs are parts in the role of members, the same expressions in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerium.functions import physics
from orrerium.operators import gaps, nodes, priors
from orrerium.plans.case_queries import Query, but, columns, listed, rounded, share, shown
from orrerium.plans.tables import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


MEMBERS = {
    "config_id": "concat('c', CAST(p_partkey % 2 AS STRING))",
    "node_id": "concat('n', CAST(p_partkey % 40 AS STRING))",
    "row_index": "p_partkey",
    "pl_name": "concat('m', CAST(p_partkey % 300 AS STRING))",
    "pl_rade": but(7, f"{share(37)} * 12"),
    "pl_orbper": but(11, "p_retailprice / 10e0"),
    "pl_rade_was_observed": "p_partkey % 3 = 1",
    "pl_rade_was_physically_derived": "p_partkey % 3 = 2",
    "pl_rade_was_imputed": "p_partkey % 3 = 0",
    "pl_orbper_was_imputed": "p_partkey % 5 = 0",
    "pl_rade_source": "CASE p_partkey % 3 WHEN 0 THEN 'imputed' WHEN 1 THEN 'observed' ELSE 'derived' END",
    "lens_1": share(41),
    "lens_2": share(43),
    "disc_year": "CAST(1990 + p_partkey % 31 AS DOUBLE)",
    "discoverymethod": but(13, "p_brand"),
    "radius_class": "CASE p_partkey % 5 WHEN 0 THEN 'jovian_size' WHEN 1 THEN 'rocky_size' WHEN 2 THEN 'sub_neptune_size' WHEN 3 THEN 'neptune_or_sub_jovian_size' END",
    "orbit_class": "CASE p_partkey % 4 WHEN 0 THEN 'long_period' ELSE 'short_period' END",
}
EDGES = {"config_id": MEMBERS["config_id"], "source": MEMBERS["node_id"], "target": "concat('n', CAST(p_partkey * 7 % 40 AS STRING))"}
MEM = f"me AS (SELECT {', '.join(listed(MEMBERS))} FROM part), e0 AS (SELECT {', '.join(listed(EDGES))} FROM part WHERE p_partkey % 6 < 2), ed AS (SELECT DISTINCT config_id, least(source, target) AS a, greatest(source, target) AS b FROM e0 WHERE source <> target), bw AS (SELECT config_id, a AS node_id, b AS other FROM ed UNION ALL SELECT config_id, b, a FROM ed)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*listed(MEMBERS))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 6 < 2").selectExpr(*listed(EDGES))


_N1 = "config_id node_id n_members degree n_any_imputed n_any_physically_derived discoverymethod_top radius_class_top orbit_class_top dominant_pl_rade_source"
_N2 = "lens_1_mean lens_1_std lens_2_mean lens_2_std mean_pl_rade median_pl_rade q25_pl_rade q75_pl_rade mean_pl_orbper frac_pl_rade_observed frac_pl_rade_imputed frac_pl_orbper_imputed observed_fraction physically_derived_fraction imputed_fraction mean_imputation_fraction median_imputation_fraction max_imputation_fraction frac_any_imputed disc_year_median disc_year_min disc_year_max frac_radius_jovian_size frac_orbit_long_period"


def _top(label: str, out: str, keys: str = "config_id, node_id", rows: str = "me") -> str:
    return f"(SELECT {keys}, arg_min({label}, (-n, {label})) AS {out} FROM (SELECT {keys}, {label}, count(*) AS n FROM {rows} WHERE trim({label}) <> '' GROUP BY ALL) GROUP BY ALL)"


NODES = f"""{MEM}, mf AS (SELECT *, (CAST(pl_rade_was_imputed AS INTEGER) + CAST(pl_orbper_was_imputed AS INTEGER)) / 2 AS f FROM me),
dg AS (SELECT config_id, node_id, count(*) AS degree FROM bw GROUP BY ALL),
nt AS (SELECT config_id, node_id, count(*) AS n_members, avg(lens_1) AS lens_1_mean, stddev_pop(lens_1) AS lens_1_std, avg(lens_2) AS lens_2_mean, stddev_pop(lens_2) AS lens_2_std, avg(pl_rade) AS mean_pl_rade, median(pl_rade) AS median_pl_rade, quantile_cont(pl_rade, 0.25) AS q25_pl_rade, quantile_cont(pl_rade, 0.75) AS q75_pl_rade, avg(pl_orbper) AS mean_pl_orbper,
  avg(CAST(pl_rade_was_observed AS INTEGER)) AS frac_pl_rade_observed, avg(CAST(pl_rade_was_imputed AS INTEGER)) AS frac_pl_rade_imputed, avg(CAST(pl_orbper_was_imputed AS INTEGER)) AS frac_pl_orbper_imputed, avg(CAST(pl_rade_was_observed AS INTEGER)) AS observed_fraction, avg(CAST(pl_rade_was_physically_derived AS INTEGER)) AS physically_derived_fraction,
  (avg(CAST(pl_rade_was_imputed AS INTEGER)) + avg(CAST(pl_orbper_was_imputed AS INTEGER))) / 2 AS imputed_fraction, avg(f) AS mean_imputation_fraction, median(f) AS median_imputation_fraction, max(f) AS max_imputation_fraction,
  count(*) FILTER (pl_rade_was_imputed OR pl_orbper_was_imputed) AS n_any_imputed, count(*) FILTER (pl_rade_was_physically_derived) AS n_any_physically_derived, count(*) FILTER (pl_rade_was_imputed OR pl_orbper_was_imputed) / count(*) AS frac_any_imputed,
  median(disc_year) AS disc_year_median, min(disc_year) AS disc_year_min, max(disc_year) AS disc_year_max, count(*) FILTER (radius_class = 'jovian_size') / count(*) AS frac_radius_jovian_size, count(*) FILTER (orbit_class = 'long_period') / count(*) AS frac_orbit_long_period FROM mf GROUP BY ALL),
no AS (SELECT nt.*, coalesce(degree, 0) AS degree, discoverymethod_top, radius_class_top, orbit_class_top, dominant_pl_rade_source FROM nt LEFT JOIN dg USING (config_id, node_id) LEFT JOIN {_top('discoverymethod', 'discoverymethod_top')} USING (config_id, node_id) LEFT JOIN {_top('radius_class', 'radius_class_top')} USING (config_id, node_id)
  LEFT JOIN {_top('orbit_class', 'orbit_class_top')} USING (config_id, node_id) LEFT JOIN {_top('pl_rade_source', 'dominant_pl_rade_source')} USING (config_id, node_id))"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.node_table(_members(spark, sf_dir), _edges(spark, sf_dir), ["pl_rade", "pl_orbper"])


@query(f"WITH {NODES} SELECT {columns(_N1, _N2)} FROM no")
def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_nodes(spark, sf_dir), _N1, _N2)


@query(f"""WITH {NODES}, q AS (SELECT quantile_cont(n_members, 0.9) AS s, quantile_cont(degree, 0.9) AS d, quantile_cont(mean_pl_rade, 0.95) AS l, quantile_cont(mean_pl_rade, 0.05) AS m, quantile_cont(mean_pl_orbper, 0.95) AS o FROM no),
h AS (SELECT config_id, node_id, array_to_string(list_sort([x FOR x IN [CASE WHEN n_members >= s THEN 'large_node' END, CASE WHEN degree >= d THEN 'central_node' END, CASE WHEN mean_pl_rade >= l THEN 'extreme_large_radius' END, CASE WHEN mean_pl_rade <= m THEN 'extreme_small_radius' END, CASE WHEN mean_pl_orbper >= o THEN 'extreme_orbital_period' END,
  CASE WHEN mean_imputation_fraction < 0.15 AND frac_any_imputed < 0.3 THEN 'reliable_node' END, CASE WHEN mean_imputation_fraction >= 0.3 OR frac_any_imputed >= 0.5 THEN 'risky_node' END, CASE WHEN physically_derived_fraction >= 0.3 THEN 'derived_dominated_node' END] IF x IS NOT NULL]), ';') AS highlight_reason FROM no, q) SELECT * FROM h WHERE highlight_reason <> ''""")
def node_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.highlights(_nodes(spark, sf_dir)).select("config_id", "node_id", "highlight_reason")


COMP = f"{NODES}, ac AS (SELECT config_id, node_id, n_members, CAST(regexp_extract(node_id, '[0-9]+') AS BIGINT) % 3 AS component_id FROM no), ix AS (SELECT config_id, component_id, count(*) AS n FROM ed JOIN ac ON ac.config_id = ed.config_id AND ac.node_id = ed.a GROUP BY ALL)".replace("SELECT config_id, component_id, count(*) AS n FROM ed", "SELECT ac.config_id, component_id, count(*) AS n FROM ed")


@query(f"""WITH {COMP}, cm AS (SELECT me.*, component_id FROM me JOIN ac USING (config_id, node_id)), cn AS (SELECT config_id, component_id, count(*) AS n_nodes, avg(n_members) AS mean_node_size FROM ac GROUP BY ALL), cu AS (SELECT config_id, component_id, count(DISTINCT row_index) AS n_members_unique FROM cm GROUP BY ALL)
SELECT config_id, component_id, n_nodes, round(mean_node_size, 6) AS mean_node_size, coalesce(n, 0) AS n_edges_internal, greatest(coalesce(n, 0) - n_nodes + 1, 0) AS beta_1_component, n_members_unique, dominant_radius_class FROM cn LEFT JOIN ix USING (config_id, component_id) JOIN cu USING (config_id, component_id) LEFT JOIN {_top('radius_class', 'dominant_radius_class', 'config_id, component_id', 'cm')} USING (config_id, component_id)""")
def component_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _nodes(spark, sf_dir).select("config_id", "node_id", "n_members", (F.regexp_extract("node_id", "[0-9]+", 0).cast("long") % 3).alias("component_id"))
    out = nodes.component_table(_members(spark, sf_dir), at, _edges(spark, sf_dir))
    return shown(out, "config_id component_id n_nodes n_edges_internal beta_1_component n_members_unique dominant_radius_class", "mean_node_size")


@query(f"""WITH {NODES}, nb AS (SELECT bw.config_id, bw.node_id, avg(o.mean_pl_rade) AS nr, avg(o.mean_pl_orbper) AS np FROM bw JOIN no o ON o.config_id = bw.config_id AND o.node_id = bw.other GROUP BY ALL), sd AS (SELECT config_id, stddev_pop(mean_pl_rade) AS sr, stddev_pop(mean_pl_orbper) AS sp FROM no GROUP BY ALL),
g AS (SELECT config_id, node_id, nr, np, mean_pl_rade - nr AS dr, mean_pl_orbper - np AS dp, (mean_pl_rade - nr) / nullif(sr, 0) AS zr, round((mean_pl_orbper - np) / nullif(sp, 0), 9) + 0.0 AS zp FROM no LEFT JOIN nb USING (config_id, node_id) JOIN sd USING (config_id))
SELECT config_id, node_id, round(nr, 6) AS neighbor_mean_pl_rade, round(dr, 6) AS delta_pl_rade, round(zr, 6) AS scaled_delta_pl_rade, round(zp, 6) AS scaled_delta_pl_orbper, round(CASE WHEN zr IS NOT NULL OR zp IS NOT NULL THEN sqrt(coalesce(zr * zr, 0) + coalesce(zp * zp, 0)) END, 6) AS physical_neighbor_distance FROM g""")
def physical_neighbor_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nodes.physical_gaps(_nodes(spark, sf_dir), _edges(spark, sf_dir), ["pl_rade", "pl_orbper", "absent"])
    return shown(out, "config_id node_id", "neighbor_mean_pl_rade delta_pl_rade scaled_delta_pl_rade scaled_delta_pl_orbper physical_neighbor_distance")


SHADOWED = {
    "config_id": "concat('c', CAST(p_partkey % 5 AS STRING))",
    "node_id": "concat('n', CAST(p_partkey AS STRING))",
    "component_id": "p_partkey % 4",
    "n_members": "CAST(p_size AS BIGINT)",
    "top_method": "CASE p_partkey % 6 WHEN 0 THEN 'Transit' WHEN 1 THEN 'Radial Velocity' WHEN 2 THEN 'Imaging' WHEN 3 THEN 'Microlensing' WHEN 4 THEN 'Astrometry' END",
    "top_method_fraction": share(47, 100),
    "shadow_score": but(9, share(31)),
    "shadow_class": "CASE WHEN p_partkey % 7 = 0 THEN 'high_confidence_shadow' WHEN p_partkey % 7 = 1 THEN NULL ELSE 'mixed_or_low_shadow' END",
    "mean_imputation_fraction": but(8, share(29, 100)),
    "is_peripheral": but(10, "p_partkey % 3 = 0"),
    "mean_pl_rade": share(37),
    "neighbor_mean_pl_rade": share(41),
    "mean_pl_bmasse": share(43),
    "neighbor_mean_pl_bmasse": but(4, share(47)),
    "TOI": share(53),
}
SHA = f"s AS (SELECT {', '.join(listed(SHADOWED))} FROM part)"
HIGH = "coalesce(shadow_class = 'high_confidence_shadow', false)"


def _shadowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*listed(SHADOWED))


@query(f"WITH {SHA} SELECT config_id, component_id, count(*) AS n_nodes, CAST(sum(n_members) AS BIGINT) AS n_members, round(avg(shadow_score), 6) AS mean_shadow_score, round(max(shadow_score), 6) AS max_shadow_score, round(avg(mean_imputation_fraction), 6) AS mean_imputation_fraction, round(avg(CAST({HIGH} AS INTEGER)), 6) AS fraction_high_confidence_shadow, coalesce(max(dominant_method), 'Unknown') AS dominant_method FROM s LEFT JOIN {_top('top_method', 'dominant_method', 'config_id, component_id', 's')} USING (config_id, component_id) GROUP BY ALL")
def shadow_by_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nodes.shadow_by_component(_shadowed(spark, sf_dir)))


@query(f"WITH {SHA} SELECT top_method, count(*) AS n_nodes, round(avg(shadow_score), 6) AS mean_shadow_score, round(median(shadow_score), 6) AS median_shadow_score, count(*) FILTER ({HIGH}) AS n_high_confidence_shadow, round(avg(mean_imputation_fraction), 6) AS mean_imputation_fraction FROM s GROUP BY ALL")
def shadow_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nodes.shadow_by_method(_shadowed(spark, sf_dir)))


@query(f"WITH {SHA} SELECT config_id, count(*) AS n_nodes, round(avg(shadow_score), 6) AS mean_shadow_score, round(median(shadow_score), 6) AS median_shadow_score, round(max(shadow_score), 6) AS max_shadow_score, count(*) FILTER ({HIGH}) AS n_high_confidence_shadow, round(avg(mean_imputation_fraction), 6) AS mean_imputation_fraction, coalesce(arg_max(top_method, (coalesce(shadow_score, -1), node_id)) FILTER (top_method IS NOT NULL), 'Unknown') AS dominant_shadow_method FROM s GROUP BY ALL")
def shadow_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nodes.shadow_by_config(_shadowed(spark, sf_dir)))


@query(f"WITH {SHA} SELECT config_id, node_id, round(shadow_score, 6) AS shadow_score FROM s ORDER BY s.shadow_score DESC NULLS LAST, config_id, node_id LIMIT 25")
def top_shadow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(nodes.top_shadow(_shadowed(spark, sf_dir), 25), "config_id node_id", "shadow_score")


@query(f"WITH {SHA} SELECT top_method, count(*) AS n_nodes FROM s WHERE {HIGH} GROUP BY ALL ORDER BY n_nodes DESC, top_method NULLS FIRST LIMIT 6")
def top_shadow_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.top_methods(_shadowed(spark, sf_dir))


@query(f"""WITH {SHA} SELECT node_id, CASE top_method WHEN 'Transit' THEN 'smaller radius or longer period' WHEN 'Radial Velocity' THEN 'lower mass or longer period' WHEN 'Imaging' THEN 'closer or fainter companions' WHEN 'Microlensing' THEN 'unrepeatable geometry' ELSE 'compatible neighbours under a local reference' END AS expected_direction,
  CASE WHEN top_method = 'Transit' AND mean_pl_rade > neighbor_mean_pl_rade THEN 'larger_radius' WHEN top_method = 'Radial Velocity' AND mean_pl_bmasse > neighbor_mean_pl_bmasse THEN 'larger_mass' ELSE '' END AS direction_signs FROM s""")
def node_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.direction(_shadowed(spark, sf_dir)).select("node_id", "expected_direction", "direction_signs")


TESTED = {"config_id": SHADOWED["config_id"], "node_id": SHADOWED["node_id"], "method": "concat('m', CAST(r AS STRING))", "z_score": "CASE WHEN (p_partkey + r) % 9 <> 0 THEN (p_partkey * 67 + r * 13) % 90 / 10e0 - 4 END", "empirical_p_value": "((p_partkey * 89 + r * 7) % 100 + 1) / 101e0", "fdr_q_value": "CASE WHEN (p_partkey + r) % 11 <> 0 THEN (p_partkey * 31 + r * 17) % 20 / 20e0 END"}
TES = f"{SHA}, te AS (SELECT {', '.join(listed(TESTED))} FROM (SELECT *, unnest([0, 1, 2]) AS r FROM part WHERE p_partkey % 4 <> 0)), be AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY config_id, node_id ORDER BY coalesce(fdr_q_value, 'inf'::DOUBLE), -coalesce(z_score, '-inf'::DOUBLE), method) AS k FROM te) WHERE k = 1)"


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 4 <> 0").selectExpr("*", "explode(array(0, 1, 2)) AS r").selectExpr(*listed(TESTED))


@query(f"WITH {TES} SELECT config_id, node_id, method AS enriched_method, round(z_score, 6) AS z_score, round(empirical_p_value, 6) AS empirical_p_value, round(fdr_q_value, 6) AS fdr_q_value FROM be")
def best_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nodes.best_enrichment(_tests(spark, sf_dir)))


@query(f"WITH {TES} SELECT config_id, node_id, method AS enriched_method, round(z_score, 6) AS z_score, n_members, top_method, round(top_method_fraction, 6) AS top_method_fraction, is_peripheral FROM be LEFT JOIN s USING (config_id, node_id) ORDER BY fdr_q_value NULLS LAST, be.z_score DESC NULLS LAST, config_id, node_id LIMIT 25")
def top_enriched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(nodes.top_enriched(_shadowed(spark, sf_dir), _tests(spark, sf_dir)), "config_id node_id enriched_method n_members top_method is_peripheral", "z_score top_method_fraction")


@query(f"WITH {TES} SELECT config_id, node_id, n_members, top_method, round(top_method_fraction, 6) AS top_method_fraction, method AS enriched_method, round(z_score, 6) AS z_score, round(fdr_q_value, 6) AS fdr_q_value FROM s LEFT JOIN be USING (config_id, node_id) WHERE is_peripheral AND top_method_fraction >= 0.75")
def peripheral_bias_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(nodes.peripheral_bias(_shadowed(spark, sf_dir), _tests(spark, sf_dir)), "config_id node_id n_members top_method enriched_method", "top_method_fraction z_score fdr_q_value")


@query(f"""WITH {TES}, tm AS (SELECT method, row_number() OVER (ORDER BY max(z_score) DESC NULLS LAST, method) AS k FROM te GROUP BY method) SELECT config_id, node_id, round(max(z_score) FILTER (k = 1), 6) AS z_1, round(max(z_score) FILTER (k = 2), 6) AS z_2 FROM te JOIN tm USING (method) WHERE k <= 2 GROUP BY ALL""")
def enrichment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nodes.z_matrix(_tests(spark, sf_dir), 2))


GRAPHS = {
    "config_id": "concat('g', CAST(s_suppkey AS STRING))",
    "feature_space": "CASE s_suppkey % 4 WHEN 0 THEN 'phys_min' WHEN 1 THEN 'phys_density' WHEN 2 THEN 'joint' ELSE 'joint_no_density' END",
    "lens": "CASE s_suppkey % 3 WHEN 0 THEN 'pca2' WHEN 1 THEN 'density' ELSE 'domain' END",
    "n_cubes": "s_nationkey % 3 * 5 + 5",
    "overlap": "0.25e0 + s_nationkey % 2 * 0.1e0",
    "n_nodes": "s_suppkey * 7 % 101",
    "n_edges": "s_suppkey * 11 % 211",
    "beta_1": "s_suppkey * 3 % 17",
    "mean_node_size": "s_acctbal / 100e0",
}
GRA = f"g AS (SELECT {', '.join(listed(GRAPHS))} FROM supplier)"


def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*listed(GRAPHS))


@query(f"""WITH {GRA}, l AS (SELECT feature_space, n_cubes, overlap, string_agg(DISTINCT lens, ', ' ORDER BY lens) AS ls, count(DISTINCT lens) AS n FROM g GROUP BY ALL), b AS (SELECT feature_space, n_cubes, overlap, arg_min(n_nodes, config_id) AS bn, arg_min(mean_node_size, config_id) AS bs FROM g WHERE lens = 'pca2' GROUP BY ALL)
SELECT config_id, ls AS available_lenses_in_group, n AS n_lenses_in_group, n_nodes - bn AS delta_n_nodes_vs_pca2, round(mean_node_size - bs, 6) AS delta_mean_node_size_vs_pca2 FROM g JOIN l USING (feature_space, n_cubes, overlap) LEFT JOIN b USING (feature_space, n_cubes, overlap)""")
def lens_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(nodes.lens_sensitivity(_graphs(spark, sf_dir)), "config_id available_lenses_in_group n_lenses_in_group delta_n_nodes_vs_pca2", "delta_mean_node_size_vs_pca2")


@query(f"WITH {GRA}, l AS (SELECT lens, n_cubes, overlap, string_agg(DISTINCT feature_space, ', ' ORDER BY feature_space) AS ls, count(DISTINCT feature_space) AS n FROM g GROUP BY ALL) SELECT config_id, ls AS available_spaces_in_group, n AS n_spaces_in_group FROM g JOIN l USING (lens, n_cubes, overlap)")
def space_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.space_comparison(_graphs(spark, sf_dir)).select("config_id", "available_spaces_in_group", "n_spaces_in_group")


@query(f"""WITH {GRA}, f AS (SELECT feature_space, arg_min(n_nodes, config_id) AS n, arg_min(beta_1, config_id) AS b FROM g WHERE lens = 'pca2' GROUP BY ALL), p AS (SELECT * FROM (VALUES ('phys_min', 'phys_density'), ('joint_no_density', 'joint')) AS t(without_density, with_density))
SELECT without_density || '_vs_' || with_density AS comparison, without_density, with_density, CAST(y.n - x.n AS DOUBLE) AS delta_n_nodes, CAST(y.b - x.b AS DOUBLE) AS delta_beta_1 FROM p JOIN f x ON x.feature_space = without_density JOIN f y ON y.feature_space = with_density""")
def density_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.density_sensitivity(_graphs(spark, sf_dir)).select("comparison", "without_density", "with_density", "delta_n_nodes", "delta_beta_1")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 2 THEN 'cube' || s_nationkey END AS cube_id, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS INTEGER) END AS cluster_id FROM supplier")
def node_id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE s_suppkey % 3 WHEN 0 THEN concat('cube', CAST(s_nationkey AS STRING), '_cluster', CAST(s_suppkey AS STRING)) WHEN 1 THEN concat('cube', CAST(s_nationkey AS STRING), '_clusterx') ELSE 'other' END")
    cube, cluster = nodes.split_node_id(name)
    return table(spark, sf_dir, "supplier").select("s_suppkey", cube.alias("cube_id"), cluster.alias("cluster_id"))


# Priors and candidates --------------------------------------------------------------------------------------------

PRIOR = f"""{MEM}, {SHA}, sr AS (SELECT min(TOI) AS tl, max(TOI) AS th, min(shadow_score) AS sl, max(shadow_score) AS sh FROM s), ns AS (SELECT node_id, TOI AS t, shadow_score AS w, (TOI - tl) / (th - tl) AS tn, coalesce((shadow_score - sl) / (sh - sl), 0) AS wn FROM s, sr),
mb AS (SELECT pl_name, max(t) AS planet_TOI_score, max(w) AS planet_shadow_score, max(tn) AS tn, max(wn) AS wn, count(DISTINCT me.node_id) AS topology_node_count FROM me LEFT JOIN ns USING (node_id) GROUP BY ALL),
a0 AS (SELECT concat('m', CAST(p_partkey % 400 AS STRING)) AS pl_name, {but(5, share(61))} AS ati FROM part WHERE p_partkey % 2 = 0), ar AS (SELECT min(ati) AS l, max(ati) AS h FROM a0), aa AS (SELECT pl_name, max(ati) AS planet_ATI_score, max(coalesce((ati - l) / (h - l), 0)) AS an FROM a0, ar GROUP BY ALL),
pp AS (SELECT *, coalesce(greatest(tn, wn, an), 0) AS topology_prior_planet FROM mb FULL JOIN aa USING (pl_name))"""


def _prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shadowed(spark, sf_dir)
    ati = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").selectExpr("concat('m', CAST(p_partkey % 400 AS STRING)) AS pl_name", f"{but(5, share(61))} AS ATI")
    return priors.member_prior(priors.node_scores(s.select("node_id", "TOI"), s.select("node_id", "shadow_score")), _members(spark, sf_dir), ati)


@query(f"WITH {PRIOR} SELECT {columns('pl_name topology_node_count', 'planet_TOI_score planet_shadow_score planet_ATI_score topology_prior_planet')} FROM pp")
def topology_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_prior(spark, sf_dir), "pl_name topology_node_count", "planet_TOI_score planet_shadow_score planet_ATI_score topology_prior_planet")


@query(f"""WITH {PRIOR}, c AS (SELECT p_partkey AS candidate_id, concat('m', CAST(p_partkey % 450 AS STRING)) AS inner_planet, concat('m', CAST(p_partkey * 3 % 450 AS STRING)) AS outer_planet FROM part),
j AS (SELECT candidate_id, coalesce(i.topology_prior_planet, 0) AS pi, coalesce(o.topology_prior_planet, 0) AS po, greatest(i.planet_shadow_score, o.planet_shadow_score) AS gs, greatest(i.planet_TOI_score, o.planet_TOI_score) AS gt FROM c LEFT JOIN pp i ON i.pl_name = inner_planet LEFT JOIN pp o ON o.pl_name = outer_planet)
SELECT candidate_id, round(pi, 6) AS topology_prior_inner, round(po, 6) AS topology_prior_outer, round(greatest(pi, po), 6) AS topology_prior_gap, round(gs, 6) AS gap_shadow_score, round(gt, 6) AS gap_TOI_score, round(least(greatest(pi, po), 1), 6) AS topology_score FROM j""")
def gap_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").selectExpr("p_partkey AS candidate_id", "concat('m', CAST(p_partkey % 450 AS STRING)) AS inner_planet", "concat('m', CAST(p_partkey * 3 % 450 AS STRING)) AS outer_planet")
    return shown(priors.attach_topology(c, _prior(spark, sf_dir)), "candidate_id", "topology_prior_inner topology_prior_outer topology_prior_gap gap_shadow_score gap_TOI_score topology_score")


_CLASS = {"s": but(9, share(37)), "r": f"8 * {share(41)}", "g": but(6, share(43)), "t": share(47), "d": share(53), "w": "CASE WHEN p_partkey % 4 = 0 THEN 'unknown' WHEN p_partkey % 4 = 1 THEN 'long_period' WHEN p_partkey % 4 = 2 THEN 'weak_RV_signal' END"}


@query(f"WITH c AS (SELECT p_partkey, {', '.join(listed(_CLASS))} FROM part) SELECT p_partkey, CASE WHEN coalesce(s, 0) >= 0.7 AND (r >= 4 OR coalesce(g, 0) >= 0.75) AND t >= 0.35 AND d >= 0.35 AND coalesce(w, 'unknown') <> 'unknown' THEN 'high' WHEN coalesce(s, 0) >= 0.4 THEN 'medium' ELSE 'low' END AS candidate_priority_class FROM c")
def priority_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").selectExpr("p_partkey", *listed(_CLASS))
    return c.select("p_partkey", priors.priority_class(*(F.col(x) for x in ("s", "r", "g", "t", "d", "w"))).alias("candidate_priority_class"))


_CAND = {"candidate_id": "p_partkey", "node_id": "concat('n', CAST(p_partkey % 500 AS STRING))", "toi": but(3, share(37)), "ati": but(2, share(41))}


@query(f"""WITH c AS (SELECT {', '.join(listed(_CAND))} FROM part), r AS (SELECT concat('n', CAST(p_partkey AS STRING)) AS node_id, {share(53)} AS toi, {share(31)} AS shadow_score FROM part WHERE p_partkey % 4 <> 0),
a AS (SELECT concat('n', CAST(p_partkey % 300 AS STRING)) AS node_id, max({but(7, share(59))}) AS ati, max({share(61)}) AS toi, min(p_brand) AS anchor_pl_name FROM part GROUP BY ALL)
SELECT candidate_id, round(coalesce(c.toi, r.toi, a.toi), 6) AS toi, round(r.shadow_score, 6) AS shadow_score, round(coalesce(c.ati, a.ati), 6) AS ati, anchor_pl_name FROM c LEFT JOIN r USING (node_id) LEFT JOIN a USING (node_id)""")
def candidate_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    regions = part.where("p_partkey % 4 <> 0").selectExpr("concat('n', CAST(p_partkey AS STRING)) AS node_id", f"{share(53)} AS toi", f"{share(31)} AS shadow_score")
    anchors = part.selectExpr("concat('n', CAST(p_partkey % 300 AS STRING)) AS node_id", f"{but(7, share(59))} AS ati", f"{share(61)} AS toi", "p_brand AS anchor_pl_name")
    return shown(priors.attach_indices(part.selectExpr(*listed(_CAND)), regions, anchors), "candidate_id anchor_pl_name", "toi shadow_score ati")


@query("""WITH k AS (SELECT o_custkey AS hostname, median(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1000 END) AS st_mass, median(CAST(o_orderkey % 9 AS DOUBLE)) AS st_teff FROM orders GROUP BY ALL)
SELECT c_custkey AS hostname, round(coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal / 5000 END, st_mass), 6) AS st_mass, round(st_teff, 6) AS st_teff FROM customer LEFT JOIN k ON k.hostname = c_custkey""")
def host_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").selectExpr("o_custkey AS hostname", "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1000e0 END AS st_mass", "CAST(o_orderkey % 9 AS DOUBLE) AS st_teff")
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS hostname", "CASE WHEN c_custkey % 4 = 0 THEN c_acctbal / 5000e0 END AS st_mass")
    return shown(priors.enrich_from_hosts(c, known), "hostname", "st_mass st_teff")


@query("""WITH e AS (SELECT p_partkey, p_size * 1.0::DOUBLE AS pl_rade, p_retailprice AS pl_orbper FROM part)
SELECT p_partkey, round(log10(pl_orbper), 6) AS log_pl_orbper, CAST(NULL AS DOUBLE) AS log_pl_insol, round(log10(pl_rade), 6) AS log_pl_rade, CAST(NULL AS DOUBLE) AS toi,
  CASE WHEN pl_rade <= 1.6 THEN 'rocky_size' WHEN pl_rade <= 2.5 THEN 'super_earth_size' WHEN pl_rade <= 4 THEN 'sub_neptune_size' WHEN pl_rade <= 8 THEN 'neptune_sub_jovian_size' ELSE 'jovian_size' END AS radius_class,
  CASE WHEN pl_orbper < 10 THEN 'short_period' WHEN pl_orbper < 100 THEN 'intermediate_period' WHEN pl_orbper < 1000 THEN 'long_period' ELSE 'very_long_period' END AS orbit_class, round(pow(10, log10(pl_rade)), 6) AS pl_rade_log_pl_rade FROM e""")
def engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS pl_rade", "p_retailprice AS pl_orbper")
    out = priors.unlogged(priors.engineered(e), ["log_pl_rade"], "pl_rade")
    return shown(out, "p_partkey radius_class orbit_class", "log_pl_orbper log_pl_insol log_pl_rade toi pl_rade_log_pl_rade")


@query(f"""WITH c AS (SELECT p_partkey, {but(3, 'CAST(p_size AS DOUBLE)')} AS a, p_retailprice AS b, {but(4, share(37))} AS f, p_partkey % 40 AS n, {but(5, share(41))} AS r FROM part)
SELECT p_partkey, round(log10(a) + f * (log10(b) - log10(a)), 6) AS log_mass, round(0.6 * least(n / 35, 1) + CASE WHEN a IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN r IS NOT NULL THEN 0.2 ELSE 0 END, 6) AS analog_support_score, round(coalesce(a, r, -1), 6) AS known FROM c""")
def analog_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{but(3, 'CAST(p_size AS DOUBLE)')} AS a", "p_retailprice AS b", f"{but(4, share(37))} AS f", "p_partkey % 40 AS n", f"{but(5, share(41))} AS r")
    return rounded(c.select("p_partkey", priors.interpolated(F.col("a"), F.col("b"), F.col("f")).alias("log_mass"), priors.analog_support(F.col("n"), F.col("a"), F.col("r"), 35).alias("analog_support_score"), priors.first_known(c, ["A", "missing", "r"], F.lit(-1.0)).alias("known")))


@query("SELECT CAST(o_custkey AS VARCHAR) AS hostname, round(median(o_totalprice / 1000), 6) AS validation_error_if_available FROM orders GROUP BY ALL")
def validation_error_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS STRING) AS hostname", "o_totalprice / 1000e0 AS abs_logP_error")
    return rounded(priors.error_by_system(rows))


_KNOWN = {"hostname": "concat('h', CAST(c_custkey % 50 AS STRING))", "pl_name": "concat('m', CAST(c_custkey AS STRING))", "pl_orbper": "CAST(1 + c_custkey % 37 AS DOUBLE)", "pl_orbsmax": "CASE WHEN c_custkey % 5 <> 0 THEN 0.05e0 + c_custkey % 9 / 10e0 END", "pl_rade": "CASE WHEN c_custkey % 7 <> 0 THEN 1e0 + c_custkey % 11 END", "pl_bmasse": "1e0 + c_custkey % 23", "st_mass": "0.5e0 + c_custkey % 50 / 40e0", "st_rad": "0.6e0 + c_custkey % 50 / 50e0"}
_ASKED = {
    "candidate_id": "p_partkey",
    "hostname": "concat('h', CAST(p_partkey % 53 AS STRING))",
    "dominant_method_group": "CASE p_partkey % 3 WHEN 0 THEN 'Transit' WHEN 1 THEN 'Radial Velocity' ELSE 'Mixed' END",
    "candidate_period_days": "1e0 + p_partkey % 211",
    "candidate_semimajor_au": but(6, "0.02e0 + p_partkey % 31 / 12e0"),
    "candidate_radius_median": but(8, "0.4e0 + p_partkey % 13"),
    "candidate_mass_median": but(9, "0.3e0 + p_partkey % 29"),
    "candidate_stellar_mass": "0.5e0 + p_partkey % 50 / 40e0",
    "candidate_stellar_radius": "0.6e0 + p_partkey % 50 / 50e0",
    "gap_period_ratio": "1e0 + p_partkey % 8",
    "gap_score": share(37),
    "topology_score": but(5, share(41)),
    "analog_support_score": share(43),
    "data_quality_score": share(47),
}
_HARD = f"""k AS (SELECT {', '.join(listed(_KNOWN))} FROM customer), a AS (SELECT {', '.join(listed(_ASKED))} FROM part),
o AS (SELECT hostname, median(pl_orbper) AS ot, median(st_rad * {physics.SUN_RADIUS_AU} / pl_orbsmax) AS op, median(pow(pl_rade / (st_rad * {physics.SUN_RADIUS_EARTHS}), 2)) AS od, median(pl_bmasse / (pow(st_mass, 2.0 / 3.0) * pow(pl_orbper, 1.0 / 3.0))) AS ov FROM k GROUP BY ALL),
r AS (SELECT a.*, candidate_stellar_radius * {physics.SUN_RADIUS_AU} / candidate_semimajor_au / op AS rp, pow(candidate_radius_median / (candidate_stellar_radius * {physics.SUN_RADIUS_EARTHS}), 2) / od AS rd, candidate_mass_median / (pow(candidate_stellar_mass, 2.0 / 3.0) * pow(candidate_period_days, 1.0 / 3.0)) / ov AS rv, candidate_period_days / ot AS rt FROM a LEFT JOIN o USING (hostname)),
h AS (SELECT *, coalesce(1 - least(rp, 1), 0) AS p, coalesce(1 - least(rd, 1), 0) AS d, coalesce(1 - least(rv, 1), 0) AS v, CASE WHEN rt > 1 THEN least(log10(rt), 1) ELSE 0 END AS t FROM (SELECT * REPLACE (CASE WHEN rp IS NULL THEN 1 ELSE rp END AS rp, CASE WHEN rd IS NULL THEN 1 ELSE rd END AS rd, CASE WHEN rv IS NULL THEN 1 ELSE rv END AS rv) FROM r)),
e AS (SELECT *, CASE dominant_method_group WHEN 'Transit' THEN 0.45 * p + 0.35 * d + 0.2 * t WHEN 'Radial Velocity' THEN 0.6 * v + 0.4 * t ELSE 0.3 * p + 0.2 * d + 0.3 * v + 0.2 * t END AS s,
  CASE dominant_method_group WHEN 'Transit' THEN CASE WHEN d >= greatest(p, t) AND d >= 0.25 THEN 'shallow_transit_depth' WHEN p >= greatest(d, t) AND p >= 0.25 THEN 'low_transit_probability' WHEN t >= 0.35 THEN 'long_period' ELSE 'unknown' END
  WHEN 'Radial Velocity' THEN CASE WHEN v >= t AND v >= 0.25 THEN 'weak_RV_signal' WHEN t >= 0.35 THEN 'long_period' ELSE 'unknown' END
  ELSE CASE WHEN greatest(p, d, v, t) < 0.25 THEN 'unknown' WHEN v = greatest(p, d, v, t) THEN 'weak_RV_signal' WHEN d = greatest(p, d, v, t) THEN 'shallow_transit_depth' WHEN p = greatest(p, d, v, t) THEN 'low_transit_probability' ELSE 'long_period' END END AS why FROM h),
f AS (SELECT *, {' + '.join(f"{w} * coalesce({'s' if c == 'missing_detectability_score' else c}, 0)" for c, w in gaps.WEIGHTS.items())} AS score FROM e)"""


@query(f"WITH {_HARD} SELECT candidate_id, round(s, 6) AS missing_detectability_score, why AS likely_missing_due_to, round(score, 6) AS candidate_priority_score, CASE WHEN score >= 0.7 AND (gap_period_ratio >= 4 OR gap_score >= 0.75) AND topology_score >= 0.35 AND s >= 0.35 AND why <> 'unknown' THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS candidate_priority_class FROM f")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectability and priority where every part of them is known somewhere and unknown elsewhere."""
    asked = table(spark, sf_dir, "part").selectExpr(*listed(_ASKED))
    out = gaps.priority(gaps.detectability(asked, table(spark, sf_dir, "customer").selectExpr(*listed(_KNOWN))))
    return shown(out, "candidate_id likely_missing_due_to candidate_priority_class", "missing_detectability_score candidate_priority_score")


@query(f"""WITH {_HARD}, m AS (SELECT hostname, count(*) AS n_observed_planets FROM k GROUP BY ALL), c AS (SELECT *, CASE WHEN score >= 0.7 AND (gap_period_ratio >= 4 OR gap_score >= 0.75) AND topology_score >= 0.35 AND s >= 0.35 AND why <> 'unknown' THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS class FROM f),
g AS (SELECT hostname, count(*) AS n_gaps, max(gap_period_ratio) AS mg FROM a GROUP BY ALL), b AS (SELECT hostname, count(*) AS n, max(score) AS mx, avg(score) AS mn, arg_min(candidate_id, (-score, candidate_id)) AS best, arg_min(class, (-score, candidate_id)) AS class FROM c GROUP BY ALL)
SELECT hostname, n_observed_planets, coalesce(n_gaps, 0) AS n_gaps, mg AS max_gap_ratio, coalesce(n, 0) AS n_candidates, round(mx, 6) AS max_priority_score, round(mn, 6) AS mean_priority_score, best AS best_candidate_id, coalesce(class, 'low') AS system_priority_class FROM m LEFT JOIN g USING (hostname) LEFT JOIN b USING (hostname)""")
def system_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems whose best candidates are of every class."""
    asked, known = table(spark, sf_dir, "part").selectExpr(*listed(_ASKED)), table(spark, sf_dir, "customer").selectExpr(*listed(_KNOWN))
    scored = gaps.priority(gaps.detectability(asked, known))
    meta = known.groupBy("hostname").agg(F.count(F.lit(1)).alias("n_observed_planets"))
    return rounded(gaps.systems(meta, scored, asked.select("hostname", F.col("gap_period_ratio").alias("gap_ratio"))))
