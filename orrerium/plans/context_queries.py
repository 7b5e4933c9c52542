"""Queries of nodes against their rings, of imputations against each other, and of small column rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrerium.functions import derived
from orrerium.operators import context, impute, profile
from orrerium.plans.case_queries import Query, but, listed, rounded, share, shown
from orrerium.plans.node_queries import EDGES, MEM
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


#: A member lives in two nodes.
MEMBERS = {
    "config_id": "concat('c', CAST(p_partkey % 2 AS STRING))",
    "node_id": "concat('n', CAST(CASE r WHEN 0 THEN p_partkey % 40 ELSE p_partkey * 3 % 40 END AS STRING))",
    "row_index": "p_partkey",
    "discoverymethod": but(13, "p_brand"),
    "z_0": but(9, f"4 * {share(37)} - 2"),
    "z_1": f"4 * {share(41)} - 2",
    "z_2": f"4 * {share(43)} - 2",
    "r3_valid": "p_partkey % 9 <> 0",
    "pl_bmasse_was_imputed": "p_partkey % 4 = 0",
    "pl_bmasse_was_physically_derived": "p_partkey % 6 = 1",
    "pl_orbper_was_imputed": "p_partkey % 7 = 0",
}
VARIABLES = ("pl_bmasse", "pl_orbper", "pl_orbsmax")
_ROWS = f"{MEM}, m AS (SELECT DISTINCT {', '.join(listed(MEMBERS))} FROM (SELECT *, unnest([0, 1]) AS r FROM part))"
RING = f"""{_ROWS}, n2 AS (SELECT DISTINCT a.config_id, a.node_id, b.other FROM bw a JOIN bw b ON b.config_id = a.config_id AND b.node_id = a.other WHERE a.node_id <> b.other AND NOT EXISTS (SELECT 1 FROM bw c WHERE c.config_id = a.config_id AND c.node_id = a.node_id AND c.other = b.other)),
rn AS (SELECT DISTINCT config_id, node_id, node_id AS source_node, 'node' AS region_type FROM m UNION ALL SELECT config_id, node_id, other, 'N1' FROM bw UNION ALL SELECT config_id, node_id, other, 'N2' FROM n2),
rg AS (SELECT * EXCLUDE (k) FROM (SELECT rn.*, m.* EXCLUDE (config_id, node_id), row_number() OVER (PARTITION BY rn.config_id, rn.node_id, region_type, row_index ORDER BY source_node) AS k FROM rn JOIN m ON m.config_id = rn.config_id AND m.node_id = rn.source_node) WHERE k = 1),
cp AS (SELECT *, count / sum(count) OVER (PARTITION BY config_id, node_id, region_type) AS fraction FROM (SELECT config_id, node_id, region_type, coalesce(discoverymethod, 'Unknown') AS method, count(*) AS count FROM rg GROUP BY ALL))"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("*", "explode(array(0, 1)) AS r").selectExpr(*listed(MEMBERS)).distinct()


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "part").where("p_partkey % 6 < 2").selectExpr(*listed(EDGES))
    return context.region_membership(_members(spark, sf_dir), edges)


@query(f"WITH {RING} SELECT config_id, node_id, region_type, source_node, row_index FROM rg")
def region_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).select("config_id", "node_id", "region_type", "source_node", "row_index")


@query(f"WITH {RING} SELECT config_id, node_id, region_type, method, count, round(fraction, 6) AS fraction FROM cp")
def region_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.composition(_regions(spark, sf_dir), "discoverymethod"))


def _against(ring: str, out: str) -> str:
    return f"""{out} AS (SELECT config_id, node_id, sum(abs(p - q)) AS l1, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js, sum(q) AS there
  FROM (SELECT coalesce(a.config_id, b.config_id) AS config_id, coalesce(a.node_id, b.node_id) AS node_id, coalesce(a.fraction, 0) AS p, coalesce(b.fraction, 0) AS q FROM (SELECT * FROM cp WHERE region_type = 'node') a FULL JOIN (SELECT * FROM cp WHERE region_type = '{ring}') b ON a.config_id = b.config_id AND a.node_id = b.node_id AND a.method = b.method) GROUP BY ALL)"""


@query(f"""WITH {RING}, {_against('N1', 'x1')}, {_against('N2', 'x2')}, o AS (SELECT config_id, node_id, arg_min(method, (-count, method)) AS top_method, max(fraction) AS f, CASE WHEN count(*) > 1 THEN -sum(fraction * ln(fraction)) / ln(count(*)) ELSE 0 END AS h FROM cp WHERE region_type = 'node' GROUP BY ALL)
SELECT config_id, node_id, top_method, round(f, 6) AS top_method_fraction, round(h, 6) AS method_entropy_norm, round(CASE WHEN x1.there > 0 THEN x1.l1 END, 6) AS method_l1_boundary_N1, round(CASE WHEN x2.there > 0 THEN x2.l1 END, 6) AS method_l1_boundary_N2, round(CASE WHEN x1.there > 0 THEN x1.js END, 6) AS method_js_boundary_N1, round(CASE WHEN x2.there > 0 THEN x2.js END, 6) AS method_js_boundary_N2
FROM o LEFT JOIN x1 USING (config_id, node_id) LEFT JOIN x2 USING (config_id, node_id)""")
def method_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.method_context(_regions(spark, sf_dir), "discoverymethod"))


@query(f"""WITH {RING}, v AS (SELECT * FROM rg WHERE r3_valid), c AS (SELECT config_id, node_id, region_type, avg(z_0) AS a, avg(z_1) AS b, avg(z_2) AS c FROM v GROUP BY ALL), o AS (SELECT * FROM c WHERE region_type = 'node'),
n AS (SELECT config_id, node_id, count(*) FILTER (r3_valid) AS n_r3_valid, avg(CAST(r3_valid AS INTEGER)) AS f FROM rg WHERE region_type = 'node' GROUP BY ALL), w AS (SELECT config_id, node_id, var_samp(z_0) AS v0 FROM v WHERE region_type = 'node' GROUP BY ALL),
d AS (SELECT v.config_id, v.node_id, v.region_type, sqrt((z_0 - a) ** 2 + (z_1 - b) ** 2 + (z_2 - c) ** 2) AS d FROM v JOIN o ON o.config_id = v.config_id AND o.node_id = v.node_id), s AS (SELECT config_id, node_id, avg(d) AS spread FROM d WHERE region_type = 'node' GROUP BY ALL),
p AS (SELECT config_id, node_id, avg(CASE WHEN d <= spread THEN 1 ELSE 0 END) AS near FROM d JOIN s USING (config_id, node_id) WHERE region_type = 'N1' GROUP BY ALL),
f AS (SELECT o.config_id, o.node_id, max(sqrt((c.a - o.a) ** 2 + (c.b - o.b) ** 2 + (c.c - o.c) ** 2)) FILTER (c.region_type = 'N1') AS d1, max(sqrt((c.a - o.a) ** 2 + (c.b - o.b) ** 2 + (c.c - o.c) ** 2)) FILTER (c.region_type = 'N2') AS d2 FROM o JOIN c ON c.config_id = o.config_id AND c.node_id = o.node_id GROUP BY ALL)
SELECT config_id, node_id, n_r3_valid, round(f, 6) AS r3_valid_fraction, round(v0, 6) AS var_z_0, round(spread, 6) AS spread_r3, round(d1, 6) AS physical_distance_v_to_N1, round(d2, 6) AS physical_distance_v_to_N2, round(near, 6) AS neighbor_overlap_score FROM n LEFT JOIN w USING (config_id, node_id) LEFT JOIN s USING (config_id, node_id) LEFT JOIN p USING (config_id, node_id) LEFT JOIN f USING (config_id, node_id)""".replace("round(f, 6)", "round(n.f, 6)"))
def case_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(context.case_geometry(_regions(spark, sf_dir)), "config_id node_id n_r3_valid", "r3_valid_fraction var_z_0 spread_r3 physical_distance_v_to_N1 physical_distance_v_to_N2 neighbor_overlap_score")


@query(f"""WITH {_ROWS} SELECT config_id, node_id, round(avg((CAST(pl_bmasse_was_imputed AS INTEGER) + CAST(pl_orbper_was_imputed AS INTEGER)) / 3) FILTER (r3_valid), 6) AS I_R3, round(avg(CAST(pl_bmasse_was_imputed AS INTEGER)), 6) AS imputed_fraction_pl_bmasse,
  round(avg(CAST(pl_bmasse_was_physically_derived AND NOT pl_bmasse_was_imputed AS INTEGER)), 6) AS physically_derived_fraction_pl_bmasse, CAST(1 AS DOUBLE) AS observed_fraction_pl_orbsmax FROM m GROUP BY ALL""")
def r3_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(context.r3_imputation(_members(spark, sf_dir), VARIABLES), "config_id node_id", "I_R3 imputed_fraction_pl_bmasse physically_derived_fraction_pl_bmasse observed_fraction_pl_orbsmax")


@query(f"WITH {_ROWS} SELECT config_id, node_id, row_index, CASE WHEN pl_bmasse_was_imputed THEN 2 WHEN pl_bmasse_was_physically_derived THEN 1 ELSE 0 END + CASE WHEN pl_orbper_was_imputed THEN 2 ELSE 0 END AS points FROM m")
def anchor_imputation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    return m.select("config_id", "node_id", "row_index", context.imputation_points(m, VARIABLES).alias("points"))


_NODE = {"config_id": "concat('c', CAST(s_suppkey % 3 AS STRING))", "node_id": "concat('n', CAST(s_suppkey AS STRING))", "c_0": "s_acctbal / 5000e0", "c_1": "s_suppkey * 7 % 11 / 5e0", "c_2": "CASE WHEN s_suppkey % 8 <> 0 THEN s_nationkey / 10e0 END", "shadow_score": "s_suppkey * 3 % 10 / 10e0", "n_members": "s_suppkey * 13 % 40", "r3_valid_fraction": "s_suppkey * 17 % 10 / 9e0"}


@query(f"""WITH n AS (SELECT {', '.join(listed(_NODE))} FROM supplier), k AS (SELECT config_id, quantile_cont(shadow_score, 0.5) AS cut FROM n GROUP BY ALL), v AS (SELECT * FROM n WHERE c_2 IS NOT NULL),
d AS (SELECT a.config_id, a.node_id, b.node_id AS analog_node, b.shadow_score, b.n_members, b.r3_valid_fraction, sqrt((a.c_0 - b.c_0) ** 2 + (a.c_1 - b.c_1) ** 2 + (a.c_2 - b.c_2) ** 2) AS d FROM v a JOIN v b ON a.config_id = b.config_id AND a.node_id <> b.node_id), t AS (SELECT config_id, quantile_cont(d, 0.25) AS tau FROM d WHERE d > 0 AND node_id < analog_node GROUP BY ALL)
SELECT config_id, node_id, analog_node, round(d, 6) AS distance FROM d JOIN t USING (config_id) JOIN k USING (config_id) WHERE d <= tau AND shadow_score <= cut AND n_members >= 5 AND r3_valid_fraction >= 0.5""")
def analog_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.analog_nodes(table(spark, sf_dir, "supplier").selectExpr(*listed(_NODE))))


# Imputations and profiles -----------------------------------------------------------------------------------------

_CELLS = {"row_index": "p_partkey", "a": but(7, f"{share(37)} * 100"), "b": but(5, "p_retailprice")}


def _complete_sql(f: str) -> str:
    return f"""SELECT 'median' AS method, '{f}' AS feature, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS complete_case_rows, count(*) FILTER ({f} IS NULL) AS missing_cells_imputed, round(median({f}) FILTER (a IS NOT NULL AND b IS NOT NULL), 6) AS complete_case_median, round(median(f{f}), 6) AS imputed_all_rows_median,
  round(median(f{f}) FILTER ({f} IS NULL), 6) AS imputed_missing_cells_median, round((median(f{f}) - median({f}) FILTER (a IS NOT NULL AND b IS NOT NULL)) / abs(median({f}) FILTER (a IS NOT NULL AND b IS NOT NULL)), 6) + 0.0 AS relative_median_delta_vs_complete_cases, round(quantile_cont(f{f}, 0.95), 6) AS imputed_all_rows_p95 FROM x"""


@query(f"WITH c AS (SELECT {', '.join(listed(_CELLS))} FROM part), q AS (SELECT median(a) AS ma, median(b) AS mb FROM c), x AS (SELECT a, b, coalesce(a, ma) AS fa, coalesce(b, mb) AS fb FROM c, q) {_complete_sql('a')} UNION ALL {_complete_sql('b')}")
def complete_case_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").selectExpr(*listed(_CELLS))
    out = context.complete_case_comparison(c, {"median": impute.median_fill(c, ["a", "b"])}, ["a", "b"])
    return shown(out, "method feature complete_case_rows missing_cells_imputed", "complete_case_median imputed_all_rows_median imputed_missing_cells_median relative_median_delta_vs_complete_cases imputed_all_rows_p95")


_ERRORS = {"method": "p_brand", "masked_cells": "CAST(p_size AS BIGINT)", "mae": share(37), "rmse": share(41), "median_relative_abs_error": but(4, share(43))}


@query(f"WITH e AS (SELECT {', '.join(listed(_ERRORS))} FROM part) SELECT method, CAST(sum(masked_cells) AS BIGINT) AS masked_cells, round(avg(mae), 6) AS mean_feature_mae, round(avg(rmse), 6) AS mean_feature_rmse, round(median(median_relative_abs_error), 6) AS median_feature_relative_abs_error FROM e GROUP BY ALL")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.validation_summary(table(spark, sf_dir, "part").selectExpr(*listed(_ERRORS))))


@query("SELECT unnest(['p_retailprice', 'p_size']) AS \"column\"")
def candidate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", "p_retailprice", "p_retailprice AS p_retailpriceerr1", "p_size % 2 AS two", "CASE WHEN p_partkey % 2 = 0 THEN p_size END AS half")
    return spark.createDataFrame([(c,) for c in context.candidate_columns(rows, ["p_partkey"])], "column string")


@query("SELECT 'pl_rade' AS \"column\", 'planet radius' AS role, count(p_size) AS n, round(avg(p_size), 6) AS mean FROM part UNION ALL SELECT 'other', NULL, count(p_retailprice), round(avg(p_retailprice), 6) FROM part")
def key_variable_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("CAST(p_size AS DOUBLE) AS pl_rade", "p_retailprice AS other")
    return shown(context.with_role(profile.numeric_profile(rows, ["pl_rade", "other"])), "column role n", "mean")


_HOLES = {"row_index": "p_partkey", "a": but(7, "sin(p_partkey)"), "b": but(5, "cos(p_partkey * 1.7e0)"), "c": but(4, "sin(p_partkey * 2.3e0)")}
_SQUARES = " + ".join(f"coalesce((q.{f} - r.{f}) ** 2, 0)" for f in "abc")
_SHARED = " + ".join(f"CAST(q.{f} IS NOT NULL AND r.{f} IS NOT NULL AS INTEGER)" for f in "abc")


def _donors(f: str) -> str:
    return f"""n{f} AS (SELECT row_index, sum(v / d) / sum(1 / d) AS {f} FROM (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY d, v) AS k FROM (SELECT q.row_index, r.{f} AS v, sqrt(({_SQUARES}) * 3 / ({_SHARED})) AS d FROM x q JOIN x r ON q.{f} IS NULL AND r.{f} IS NOT NULL AND {_SHARED} > 0)) WHERE k <= 7 GROUP BY row_index)"""


@query(f"WITH x AS (SELECT {', '.join(listed(_HOLES))} FROM part), {', '.join(_donors(f) for f in 'abc')} SELECT x.row_index, {', '.join(f'round(coalesce(x.{f}, n{f}.{f}), 6) + 0.0 AS {f}' for f in 'abc')} FROM x LEFT JOIN na ON na.row_index = x.row_index LEFT JOIN nb ON nb.row_index = x.row_index LEFT JOIN nc ON nc.row_index = x.row_index")
def nearest_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells from the nearest rows that have them; rows without any value stay as they are."""
    return rounded(impute.knn_fill(table(spark, sf_dir, "part").selectExpr(*listed(_HOLES)), ["a", "b", "c"], block=700))


_CANDIDATE = {"p_partkey": "p_partkey", "hostname": "CASE WHEN p_partkey % 6 <> 0 THEN p_brand END", "pl_orbper": "CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice / 10e0 END", "a_au": "p_size / 20e0", "st_rad": "p_partkey % 4 * 0.5e0", "st_mass": "0.2e0 + p_size / 40e0", "st_lum": "CASE WHEN p_partkey % 5 <> 0 THEN p_size / 9e0 END", "st_teff": "4000e0 + p_partkey % 3000", "neighbor_mass": "p_partkey % 9 * 1e0", "p_inner": "p_retailprice / 25e0", "outer_period": "p_partkey % 3 * p_retailprice / 4e0", "gap_toi_score": "p_partkey % 10 / 10e0", "node_degree": "p_partkey % 12 * 1e0", "candidate_eqt": "CASE WHEN p_partkey % 2 = 0 THEN 300e0 END"}


@query(f"""WITH n AS (SELECT {', '.join(listed(_CANDIDATE))} FROM part), k AS (SELECT hostname, count(*) AS c FROM n WHERE hostname IS NOT NULL GROUP BY 1)
SELECT p_partkey, round(pl_orbper, 6) AS candidate_pl_orbper, a_au AS candidate_pl_orbsmax, CASE WHEN st_rad > 0 THEN round(st_rad * 0.00465047::DOUBLE / a_au, 6) END AS proxy_transit_probability_proxy,
  CASE WHEN neighbor_mass > 0 THEN round(neighbor_mass / (pow(st_mass, 2 / 3) * pow(pl_orbper, 1 / 3)), 6) END AS rv_amplitude_proxy, round(st_lum / (a_au * a_au), 6) AS candidate_insol, candidate_eqt, CASE WHEN st_rad > 0 THEN round(st_teff * sqrt(st_rad * 0.00465047::DOUBLE / (2 * a_au)), 6) END AS proxy_candidate_eqt,
  c AS n_known_planets, round(pl_orbper / p_inner, 6) AS period_ratio_inner, CASE WHEN outer_period > 0 THEN round(outer_period / pl_orbper, 6) END AS period_ratio_outer, CASE WHEN outer_period > 0 THEN round(log10(outer_period) - log10(p_inner), 6) END AS log_gap_width,
  CASE WHEN outer_period > 0 THEN round((log10(pl_orbper) - log10(p_inner)) / (log10(outer_period) - log10(p_inner)), 6) END AS normalized_gap_position, gap_toi_score AS "TOI", gap_toi_score AS topo_toi, CAST(NULL AS DOUBLE) AS shadow_score, node_degree AS topo_node_degree, CAST(NULL AS DOUBLE) AS topo_node_size
FROM n LEFT JOIN k USING (hostname)""")
def derived_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derived.derived_features(table(spark, sf_dir, "part").selectExpr(*listed(_CANDIDATE)))
    return rounded(out.select("p_partkey", "candidate_pl_orbper", "candidate_pl_orbsmax", "proxy_transit_probability_proxy", "rv_amplitude_proxy", "candidate_insol", "candidate_eqt", "proxy_candidate_eqt", "n_known_planets", "period_ratio_inner", "period_ratio_outer", "log_gap_width", "normalized_gap_position", "TOI", "topo_toi", "shadow_score", "topo_node_degree", "topo_node_size"))
