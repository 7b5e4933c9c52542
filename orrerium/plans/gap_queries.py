"""Queries of system gaps and their candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerium.operators import gaps, studies
from orrerium.plans.tables import CATALOG, catalog


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def system_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.system_metadata(catalog(spark, sf_dir))


def adjacent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.adjacent(catalog(spark, sf_dir)).drop("a_in", "a_out")


def _pairs(cat: DataFrame) -> DataFrame:
    return gaps.adjacent(cat).join(gaps.system_metadata(cat).select("hostname", "dominant_method_group", "stellar_mass_bin"), "hostname")


def gap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.statistics(_pairs(catalog(spark, sf_dir)))


def candidate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.candidate_gaps(catalog(spark, sf_dir)).drop("a_in", "a_out")


_CANDIDATE = ("candidate_id", "hostname", "candidate_rank_in_gap", "candidate_fraction", "candidate_period_days", "candidate_semimajor_au", "candidate_position_method", "expected_missing_count", "gap_score", "gap_period_ratio")


def expand_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.expand(gaps.candidate_gaps(catalog(spark, sf_dir))).select(*_CANDIDATE)


def loo_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.leave_one_out(catalog(spark, sf_dir))


def loo_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.recall(gaps.leave_one_out(catalog(spark, sf_dir)))


def nearest_inner_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = catalog(spark, sf_dir)
    return gaps.nearest_neighbours(gaps.expand(gaps.candidate_gaps(cat)), cat)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = catalog(spark, sf_dir)
    found = gaps.expand(gaps.candidate_gaps(cat)).withColumns({"candidate_radius_median": F.lit(2.0), "candidate_mass_median": F.lit(5.0)})
    return gaps.priority(gaps.data_quality(gaps.detectability(found, cat), cat))


def detectability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir).select("candidate_id", "dominant_method_group", "missing_detectability_score", "likely_missing_due_to"))


def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir).select("candidate_id", "data_quality_score", "candidate_priority_score", "candidate_priority_class"))


def system_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = catalog(spark, sf_dir)
    found = gaps.candidate_gaps(cat)
    out = gaps.systems(gaps.system_metadata(cat), gaps.priority(gaps.expand(found)), found)
    return _rounded(out.select("hostname", "n_observed_planets", "n_gaps", "n_candidates", "max_gap_ratio", "max_priority_score", "mean_priority_score", "system_priority_class"))


#: Hosts of the tables in place of named ones; the third study's methods come second to mixed systems.
_STUDIES = (studies.Study(1, "top_ranked_visual_case", ("1147", "33"), ("Transit",)), studies.Study(2, "radial_velocity_like_case", (), ("Radial Velocity",)), studies.Study(3, "mixed_or_fallback_case", ("7",), ("Mixed", "Transit")))


def gap_case_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = studies.case_studies(_scored(spark, sf_dir), gaps.system_metadata(catalog(spark, sf_dir)), _STUDIES, ("medium",))
    return _rounded(out.select("case_rank", "case_type", "hostname", "candidate_id", "candidate_period_days", "gap_period_ratio", "candidate_priority_score", "likely_missing_due_to", "followup", F.col("n_observed_planets").cast("long").alias("n_observed_planets")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (system_metadata, adjacent_gaps, gap_statistics, candidate_gaps, expand_candidates, loo_validation, loo_recall, nearest_inner_outer, detectability, priority_score, system_summary, gap_case_studies)}

_META = (
    CATALOG
    + """,
mc AS (SELECT hostname, discoverymethod AS m, count(*) AS n FROM cat WHERE pl_orbper > 0 GROUP BY ALL),
mt AS (SELECT hostname, arg_min(m, (-n, m)) AS top, max(n) AS c FROM mc GROUP BY hostname),
med AS (SELECT hostname, count(*) AS n_observed_planets, median(st_mass) FILTER (st_mass > 0) AS system_st_mass_median, median(st_rad) FILTER (st_rad > 0) AS system_st_rad_median FROM cat WHERE pl_orbper > 0 GROUP BY hostname HAVING count(*) >= 2),
meta AS (SELECT hostname, n_observed_planets,
  CASE WHEN top IN ('Transit', 'Radial Velocity') AND c / n_observed_planets >= 0.60 THEN top WHEN top NOT IN ('Transit', 'Radial Velocity') AND c / n_observed_planets >= 0.75 THEN top ELSE 'Mixed' END AS dominant_discoverymethod_system,
  CASE WHEN top IN ('Transit', 'Radial Velocity') AND c / n_observed_planets >= 0.60 THEN top ELSE 'Mixed' END AS dominant_method_group,
  c / n_observed_planets AS dominant_method_fraction, system_st_mass_median, system_st_rad_median,
  CASE WHEN system_st_mass_median > 0 THEN CASE WHEN system_st_mass_median < 0.8 THEN 'low_mass_star' WHEN system_st_mass_median <= 1.2 THEN 'solar_like_star' ELSE 'high_mass_star' END ELSE 'unknown_mass_star' END AS stellar_mass_bin
  FROM med JOIN mt USING (hostname))"""
)


def _adjacent(step: int) -> str:
    more = ", lead(pl_name, 1) OVER w AS hidden_planet, lead(pl_orbper, 1) OVER w AS P_hidden" if step == 2 else ""
    keep = ", hidden_planet, P_hidden" if step == 2 else ""
    return f"""adj{step} AS (SELECT hostname, inner_planet, outer_planet, P_in, P_out, inner_discoverymethod, outer_discoverymethod, P_out / P_in AS gap_ratio, log10(P_out) - log10(P_in) AS gap_log_width{keep}
  FROM (SELECT hostname, pl_name AS inner_planet, lead(pl_name, {step}) OVER w AS outer_planet, pl_orbper AS P_in, lead(pl_orbper, {step}) OVER w AS P_out,
    discoverymethod AS inner_discoverymethod, lead(discoverymethod, {step}) OVER w AS outer_discoverymethod{more} FROM cat WHERE pl_orbper > 0 WINDOW w AS (PARTITION BY hostname ORDER BY pl_orbper, pl_name)) WHERE P_out IS NOT NULL)"""


_STATS = (
    _META
    + ",\n"
    + _adjacent(1)
    + """,
pairs AS (SELECT a.*, dominant_discoverymethod_system, dominant_method_group, stellar_mass_bin, system_st_mass_median AS candidate_stellar_mass, system_st_rad_median AS candidate_stellar_radius FROM adj1 a JOIN meta USING (hostname)),
stats AS (SELECT CASE WHEN grouping(dominant_method_group) = 1 THEN 'global' WHEN grouping(stellar_mass_bin) = 1 THEN 'method_group' ELSE 'method_plus_mass_bin' END AS level, dominant_method_group, stellar_mass_bin, median(gap_log_width) AS median_log_gap, count(*) AS n_gaps
  FROM pairs GROUP BY GROUPING SETS ((), (dominant_method_group), (dominant_method_group, stellar_mass_bin)))"""
)


def _expected(pairs: str, out: str) -> str:
    return f"""{out}0 AS (SELECT p.*, coalesce(f.median_log_gap, g.median_log_gap, a.median_log_gap) AS typical_gap_log_width,
  CASE WHEN f.median_log_gap IS NOT NULL THEN 'method_plus_mass_bin' WHEN g.median_log_gap IS NOT NULL THEN 'method_group' ELSE 'global' END AS typical_gap_source
  FROM {pairs} p LEFT JOIN stats f ON f.level = 'method_plus_mass_bin' AND f.n_gaps >= 20 AND f.dominant_method_group = p.dominant_method_group AND f.stellar_mass_bin = p.stellar_mass_bin
  LEFT JOIN stats g ON g.level = 'method_group' AND g.n_gaps >= 20 AND g.dominant_method_group = p.dominant_method_group LEFT JOIN stats a ON a.level = 'global'),
{out}1 AS (SELECT *, CAST(CASE WHEN gap_ratio >= 2.8 THEN greatest(1, least(4, floor(ln(gap_ratio) / ln(2.8)))) ELSE 0 END AS INTEGER) AS expected_missing_count_heuristic,
  CAST(CASE WHEN typical_gap_log_width > 0 THEN greatest(0, least(4, round_even(gap_log_width / typical_gap_log_width, 0) - 1)) ELSE 0 END AS INTEGER) AS expected_missing_count_empirical FROM {out}0),
{out} AS (SELECT *, greatest(expected_missing_count_heuristic, expected_missing_count_empirical) AS expected_missing_count FROM {out}1)"""


_CAND = (
    _STATS
    + ",\n"
    + _expected("pairs", "ex")
    + """,
gaps AS (SELECT * FROM (SELECT *, cume_dist() OVER (ORDER BY gap_log_width) AS gap_score FROM ex) WHERE gap_ratio >= 2.8),
cand AS (SELECT hostname || '::' || inner_planet || '::' || outer_planet || '::' || k AS candidate_id, hostname, inner_planet, outer_planet, CAST(k AS INTEGER) AS candidate_rank_in_gap, k / (expected_missing_count + 1) AS candidate_fraction,
  pow(10, log10(P_in) + k / (expected_missing_count + 1) * (log10(P_out) - log10(P_in))) AS candidate_period_days, candidate_stellar_mass, candidate_stellar_radius, dominant_method_group, expected_missing_count, gap_score, gap_ratio AS gap_period_ratio
  FROM gaps, unnest(range(1, expected_missing_count + 1)) AS t(k)),
axes AS (SELECT *, CASE WHEN candidate_stellar_mass > 0 THEN pow(candidate_stellar_mass * (candidate_period_days / 365.25) * (candidate_period_days / 365.25), 1.0 / 3.0) END AS candidate_semimajor_au FROM cand)"""
)

_LOO = (
    _STATS
    + ",\n"
    + _adjacent(2)
    + ",\nheld AS (SELECT a.*, dominant_method_group, stellar_mass_bin FROM adj2 a JOIN meta USING (hostname)),\n"
    + _expected("held", "hx")
    + """,
pred AS (SELECT hostname, hidden_planet, P_hidden, k, log10(P_in) + k / (expected_missing_count + 1) * (log10(P_out) - log10(P_in)) AS lp FROM hx, unnest(range(1, expected_missing_count + 1)) AS t(k)),
best AS (SELECT hostname, hidden_planet, arg_min(pow(10, lp), (abs(lp - log10(P_hidden)), k)) AS predicted_period_best, min(abs(lp - log10(P_hidden))) AS abs_logP_error FROM pred GROUP BY ALL),
loo AS (SELECT hostname, hidden_planet AS removed_planet, P_hidden AS true_period_days, predicted_period_best, abs_logP_error, predicted_period_best IS NOT NULL AS recovered,
  coalesce(abs_logP_error <= 0.1, false) AS within_0p1_dex, coalesce(abs_logP_error <= 0.2, false) AS within_0p2_dex,
  coalesce(greatest(predicted_period_best / P_hidden, P_hidden / predicted_period_best) <= 1.5, false) AS within_factor_1p5, coalesce(greatest(predicted_period_best / P_hidden, P_hidden / predicted_period_best) <= 2.0, false) AS within_factor_2
  FROM held LEFT JOIN best USING (hostname, hidden_planet))"""
)

_DETECT = (
    _CAND
    + """,
obs AS (SELECT hostname, median(pl_orbper) AS t, median(CASE WHEN st_rad > 0 AND pl_rade > 0 THEN pow(pl_rade / (st_rad * 109.076), 2) END) AS d,
  median(CASE WHEN pl_bmasse > 0 AND st_mass > 0 AND pl_orbper > 0 THEN pl_bmasse / (pow(st_mass, 2.0 / 3.0) * pow(pl_orbper, 1.0 / 3.0)) END) AS v FROM cat GROUP BY hostname),
rel AS (SELECT a.*, CASE WHEN candidate_stellar_radius > 0 THEN pow(2.0 / (candidate_stellar_radius * 109.076), 2) END / d AS rd,
  CASE WHEN candidate_stellar_mass > 0 THEN 5.0 / (pow(candidate_stellar_mass, 2.0 / 3.0) * pow(candidate_period_days, 1.0 / 3.0)) END / v AS rv, candidate_period_days / t AS rt FROM axes a LEFT JOIN obs USING (hostname)),
hard AS (SELECT *, CAST(0 AS DOUBLE) AS p, coalesce(1 - least(rd, 1), 0) AS hd, coalesce(1 - least(rv, 1), 0) AS hv, CASE WHEN rt > 1 THEN least(log10(rt), 1) ELSE 0 END AS ht FROM rel),
det AS (SELECT *, CASE dominant_method_group WHEN 'Transit' THEN 0.45 * p + 0.35 * hd + 0.20 * ht WHEN 'Radial Velocity' THEN 0.60 * hv + 0.40 * ht ELSE 0.30 * p + 0.20 * hd + 0.30 * hv + 0.20 * ht END AS missing_detectability_score,
  CASE WHEN dominant_method_group = 'Transit' THEN CASE WHEN hd >= greatest(p, ht) AND hd >= 0.25 THEN 'shallow_transit_depth' WHEN p >= greatest(hd, ht) AND p >= 0.25 THEN 'low_transit_probability' WHEN ht >= 0.35 THEN 'long_period' ELSE 'unknown' END
    WHEN dominant_method_group = 'Radial Velocity' THEN CASE WHEN hv >= ht AND hv >= 0.25 THEN 'weak_RV_signal' WHEN ht >= 0.35 THEN 'long_period' ELSE 'unknown' END
    WHEN greatest(p, hd, hv, ht) < 0.25 THEN 'unknown' WHEN hv = greatest(p, hd, hv, ht) THEN 'weak_RV_signal' WHEN hd = greatest(p, hd, hv, ht) THEN 'shallow_transit_depth' WHEN p = greatest(p, hd, hv, ht) THEN 'low_transit_probability' ELSE 'long_period' END AS likely_missing_due_to FROM hard),
qual AS (SELECT *, (4 * 0.7 + 2 * 0.7 + CASE WHEN candidate_semimajor_au IS NOT NULL THEN 0.85 ELSE 0.65 END + CASE WHEN candidate_stellar_mass IS NOT NULL THEN 1.6 ELSE 0 END + 1.5)
  / (8 + 1 + CASE WHEN candidate_stellar_mass IS NOT NULL THEN 2 ELSE 0 END + 2) AS data_quality_score FROM det),
prio AS (SELECT *, least(1, 0.30 * gap_score + 0.15 * missing_detectability_score + 0.10 * data_quality_score) AS candidate_priority_score FROM qual)"""
)

_CASES = (
    _DETECT
    + """,
high AS (SELECT *, dominant_method_group AS g FROM prio WHERE candidate_priority_score >= 0.40),
s1 AS (SELECT 1 AS case_rank, 'top_ranked_visual_case' AS case_type, * FROM high WHERE g = 'Transit' ORDER BY hostname NOT IN ('1147', '33'), candidate_priority_score DESC, gap_period_ratio DESC, missing_detectability_score DESC, candidate_id LIMIT 1),
s2 AS (SELECT 2, 'radial_velocity_like_case', * FROM high WHERE likely_missing_due_to = 'weak_RV_signal' AND hostname NOT IN (SELECT hostname FROM s1) ORDER BY candidate_priority_score DESC, gap_period_ratio DESC, missing_detectability_score DESC, candidate_id LIMIT 1),
s3 AS (SELECT 3, 'mixed_or_fallback_case', * FROM high WHERE hostname NOT IN (SELECT hostname FROM s1 UNION ALL SELECT hostname FROM s2) ORDER BY CASE g WHEN 'Mixed' THEN 0 WHEN 'Transit' THEN 1 ELSE 2 END, hostname <> '7', candidate_priority_score DESC, gap_period_ratio DESC, missing_detectability_score DESC, candidate_id LIMIT 1),
ss AS (FROM s1 UNION ALL FROM s2 UNION ALL FROM s3)"""
)

SQL: dict[str, str] = {
    "gap_case_studies": f"""WITH {_CASES} SELECT case_rank, case_type, hostname, candidate_id, round(candidate_period_days, 6) AS candidate_period_days, round(gap_period_ratio, 6) AS gap_period_ratio, round(candidate_priority_score, 6) AS candidate_priority_score, likely_missing_due_to,
  CASE WHEN case_rank = 2 OR likely_missing_due_to = 'weak_RV_signal' THEN 'radial_velocity_series' WHEN likely_missing_due_to IN ('shallow_transit_depth', 'low_transit_probability', 'long_period') THEN 'photometry_and_transit_windows' ELSE 'photometry_with_radial_velocity' END AS followup, CAST(n_observed_planets AS BIGINT) AS n_observed_planets FROM ss JOIN meta USING (hostname)""",
    "system_metadata": f"WITH {_META} SELECT * FROM meta",
    "adjacent_gaps": f"WITH {CATALOG}, {_adjacent(1)} SELECT * FROM adj1",
    "gap_statistics": f"WITH {_STATS} SELECT * FROM stats",
    "candidate_gaps": f"WITH {_CAND} SELECT * FROM gaps",
    "expand_candidates": f"WITH {_CAND} SELECT {', '.join(c for c in _CANDIDATE if c != 'candidate_position_method')}, CASE WHEN candidate_semimajor_au IS NOT NULL THEN 'kepler' ELSE 'geometric_interpolation' END AS candidate_position_method FROM axes",
    "loo_validation": f"WITH {_LOO} SELECT * FROM loo",
    "loo_recall": f"WITH {_LOO} SELECT count(*) AS n_holdouts, median(abs_logP_error) AS median_abs_logP_error, "
    + ", ".join(f"avg(CAST({c} AS INTEGER)) AS recall_{c}" for c in ("recovered", "within_0p1_dex", "within_0p2_dex", "within_factor_1p5", "within_factor_2"))
    + " FROM loo",
    "nearest_inner_outer": f"""WITH {_CAND}, near AS (SELECT c.hostname, c.candidate_id, c.candidate_period_days, max(k.pl_orbper) FILTER (k.pl_orbper < c.candidate_period_days) AS inner_period, min(k.pl_orbper) FILTER (k.pl_orbper > c.candidate_period_days) AS outer_period
  FROM cand c LEFT JOIN cat k ON k.hostname = c.hostname GROUP BY ALL)
SELECT *, candidate_period_days / inner_period AS inner_ratio, outer_period / candidate_period_days AS outer_ratio, log10(outer_period) - log10(inner_period) AS gap_log_width FROM near""",
    "detectability": f"WITH {_DETECT} SELECT candidate_id, dominant_method_group, round(missing_detectability_score, 6) AS missing_detectability_score, likely_missing_due_to FROM det",
    "priority_score": f"WITH {_DETECT} SELECT candidate_id, round(data_quality_score, 6) AS data_quality_score, round(candidate_priority_score, 6) AS candidate_priority_score, CASE WHEN candidate_priority_score >= 0.40 THEN 'medium' ELSE 'low' END AS candidate_priority_class FROM prio",
    "system_summary": f"""WITH {_CAND}, g AS (SELECT hostname, count(*) AS n_gaps, max(gap_ratio) AS max_gap_ratio FROM gaps GROUP BY hostname), c AS (SELECT hostname, count(*) AS n_candidates, max(0.3 * gap_score) AS mx, avg(0.3 * gap_score) AS mn FROM cand GROUP BY hostname)
SELECT hostname, n_observed_planets, coalesce(n_gaps, 0) AS n_gaps, coalesce(n_candidates, 0) AS n_candidates, round(max_gap_ratio, 6) AS max_gap_ratio, round(mx, 6) AS max_priority_score, round(mn, 6) AS mean_priority_score, 'low' AS system_priority_class FROM meta LEFT JOIN g USING (hostname) LEFT JOIN c USING (hostname)""",
}
