"""Evidence for a region, what it is best read as, and how sure that is.

Regions are nodes and connected components of Mapper graphs. Their tables are joined on (config_id, id); of repeated
right-hand rows the least in all columns counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrerium.functions import labels
from orrerium.functions.numeric import clip, to_numeric

#: Shares that count as physical evidence, the classes that stand for it where there is no share, and their score.
PHYSICAL_SHARES = ("radius_class_purity", "frac_orbit_short_period", "frac_orbit_intermediate_period", "frac_orbit_long_period", "frac_thermal_very_hot", "frac_thermal_hot", "frac_thermal_warm", "frac_thermal_cool", "frac_hot_jupiter_candidate", "frac_super_earth_candidate", "frac_sub_neptune_candidate", "frac_rocky_candidate", "frac_long_period_giant_candidate")
DOMINANT = ("radius_class_dominant", "orbit_class_dominant", "thermal_class_dominant")
UNKNOWN = ("", "unknown", "unknown_mixed", "nan")
DOMINANT_SCORE = 0.55


def _values(df: DataFrame):
    have = set(df.columns)

    def number(c: str, default: Column | float | None = None) -> Column:
        x = to_numeric(c) if c in have else F.lit(None).cast("double")
        return x if default is None else F.coalesce(x, default if isinstance(default, Column) else F.lit(float(default)))

    return have, number


def _most(parts: Sequence[Column]) -> Column:
    return clip(F.coalesce(F.greatest(*parts, F.lit(None).cast("double")), F.lit(0.0)), 0, 1)


def scores(regions: DataFrame) -> DataFrame:
    """physical_evidence_score, observational_bias_score and imputation_risk_score, each in [0, 1] and the greatest of its parts.

    Columns that are missing or null have no part; a region without any has 0. Members count as 0 where unknown.
    """
    have, number = _values(regions)
    named = [F.when(~F.lower(F.col(c).cast("string")).isin(*UNKNOWN), DOMINANT_SCORE) for c in DOMINANT if c in have]
    physical = _most([number(c) for c in PHYSICAL_SHARES] + named)
    facility = number("dominant_disc_facility_fraction", 0)
    years = number("disc_year_iqr")
    bias = _most([
        number("dominant_discoverymethod_fraction", 0),
        clip(1.0 - number("discoverymethod_entropy") / 2.5, 0, 1),
        clip(number("discoverymethod_enrichment_z") / 5.0, 0, 1),
        labels.p_value_score(number("discoverymethod_enrichment_p")),
        F.when(facility >= 0.80, facility).otherwise(0.0),
        F.when(years <= 2, 0.75).when(years <= 5, 0.50).otherwise(0.0),
        clip(number("discoverymethod_js_divergence_vs_global", 0) / 0.35, 0, 1),
    ])
    mean = number("mean_imputation_fraction", 0)
    members = number("n_members", 0)
    small = F.when(members < 5, 0.85).when(members < 10, 0.50).when(members < 20, 0.25).otherwise(0.0)
    risk = _most([clip(mean / 0.30, 0, 1), clip(number("max_imputation_fraction", mean) / 0.75, 0, 1), small])
    return regions.withColumns({"physical_evidence_score": physical, "observational_bias_score": bias, "imputation_risk_score": risk})


def significant(regions: DataFrame) -> Column:
    """Whether a method is enriched: p of 0.05 at most, or z of 2 at least."""
    _, number = _values(regions)
    return F.coalesce(number("discoverymethod_enrichment_p") <= 0.05, F.lit(False)) | F.coalesce(number("discoverymethod_enrichment_z") >= 2.0, F.lit(False))


def classified(regions: DataFrame) -> DataFrame:
    """Scores, final_label (physical, observational, mixed or weak), confidence, rationale_short and recommended_report_language."""
    out = scores(regions)
    have, number = _values(out)
    ph, ob, risk = (F.col(c) for c in ("physical_evidence_score", "observational_bias_score", "imputation_risk_score"))
    mean, members = number("mean_imputation_fraction", 0), number("n_members", 0)
    enriched = significant(out)
    coherent, biased = ph >= 0.65, (ob >= 0.75) | enriched
    unbiased = (ob < 0.60) & ~enriched & (number("dominant_disc_facility_fraction", 0) < 0.85)
    unsure = (mean >= 0.30) | (number("max_imputation_fraction", mean) >= 0.75) | (members < 5)
    doubtful = F.when(coherent & biased & (risk < 0.85), "mixed").when(biased & (risk < 0.85), "observational").otherwise("weak")
    sound = F.when(coherent & biased, "mixed").when(biased & ~coherent, "observational").when(coherent & unbiased & (risk < 0.50), "physical").otherwise("weak")
    out = out.withColumn("final_label", F.when(unsure, doubtful).otherwise(sound))
    label = F.col("final_label")
    high = (
        F.when(label == "physical", (ph >= 0.80) & (ob < 0.45) & (risk < 0.30))
        .when(label == "observational", (ob >= 0.85) & (risk < 0.70))
        .when(label == "mixed", (ph >= 0.75) & (ob >= 0.85) & (risk < 0.70))
        .otherwise((risk >= 0.85) | (members < 5))
    )
    out = out.withColumn("confidence", F.when(high, "high").when(label == "weak", "low").otherwise("medium"))

    def said(c: str, template: str, *more: Column) -> Column:
        x = number(c)
        return F.when(x.isNotNull(), F.format_string(template, *more, x))

    method = F.col("dominant_discoverymethod") if "dominant_discoverymethod" in have else F.lit(None).cast("string")
    radius = F.col("radius_class_dominant") if "radius_class_dominant" in have else F.lit(None).cast("string")
    parts = [
        F.format_string("physical_score=%.2f", ph),
        F.format_string("bias_score=%.2f", ob),
        F.format_string("imputation_risk=%.2f", risk),
        F.when(method != "", said("dominant_discoverymethod_fraction", "%s fraction=%.2f", method)),
        said("discoverymethod_enrichment_z", "enrichment_z=%.2f"),
        said("discoverymethod_enrichment_p", "p=%.3f"),
        F.when(radius != "", F.concat(F.lit("radius="), radius)),
    ]
    told = F.create_map(*[F.lit(x) for pair in {
        "physical": "coherent in its physical classes, little imputed and without an enriched method",
        "observational": "dominated by how its members were found; not a population without further controls",
        "mixed": "physically coherent, but confounded with how its members were found",
        "weak": "too uncertain, small or imputed for a reading of its own",
    }.items() for x in pair])
    return out.withColumns({"rationale_short": F.concat_ws("; ", *parts), "recommended_report_language": told[label]})


def label_counts(regions: DataFrame) -> DataFrame:
    return regions.groupBy("config_id", "region_type", "final_label").agg(F.count(F.lit(1)).alias("n_regions"))


def label_counts_by_type(regions: DataFrame) -> DataFrame:
    """Regions by type and label over all configurations; null types and labels are groups, too."""
    return regions.groupBy("region_type", "final_label").agg(F.count(F.lit(1)).alias("n_regions"))


def _once(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    kept = [c for c in columns if c in df.columns]
    least = df.select(*keys, *kept).groupBy(*keys).agg(F.min(F.struct(*kept) if kept else F.lit(0)).alias("_one"))
    return least.select(*keys, *[F.col(f"_one.{c}").alias(c) for c in kept])


#: What nodes and components take over from the tables beside them.
NODE_PHYSICAL = (*PHYSICAL_SHARES[1:], "candidate_population_top", "physically_derived_fraction", "frac_any_imputed")
NODE_TESTS = ("enrichment_z", "empirical_p_value", "n_perm", "seed")
COMPONENT_SUMMARY = ("beta_1_component", "dominant_candidate_population", "physically_derived_fraction", "caution_level")


def node_regions(bias: DataFrame, physical: DataFrame, tests: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Nodes with their physical shares and enrichment, as regions; only those of `configs` (config_id) if given."""
    keys = ("config_id", "node_id")
    rows = bias.join(configs.select("config_id").distinct(), "config_id", "left_semi") if configs is not None else bias
    rows = rows.join(_once(physical, keys, [c for c in NODE_PHYSICAL if c not in bias.columns]), list(keys), "left").join(_once(tests, keys, NODE_TESTS), list(keys), "left")
    return rows.withColumns({"region_type": F.lit("node"), "region_id": F.col("node_id").cast("string"), "discoverymethod_enrichment_z": to_numeric("enrichment_z"), "discoverymethod_enrichment_p": to_numeric("empirical_p_value")})


def component_regions(bias: DataFrame, summary: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Components with their summary, as regions; they have no enrichment test."""
    keys = ("config_id", "component_id")
    rows = bias.join(configs.select("config_id").distinct(), "config_id", "left_semi") if configs is not None else bias
    rows = rows.join(_once(summary, keys, [c for c in COMPONENT_SUMMARY if c not in bias.columns]), list(keys), "left")
    none = F.lit(None).cast("double")
    return rows.withColumns({"region_type": F.lit("component"), "region_id": F.col("component_id").cast("string"), "discoverymethod_enrichment_z": none, "discoverymethod_enrichment_p": none})


def synthesize(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """All regions, classified; columns that one side lacks are null there."""
    return classified(nodes.unionByName(components, allowMissingColumns=True))


def ranked(regions: DataFrame) -> DataFrame:
    """report_rank within configuration, type and label: the most biased first, then the most physical, then by id."""
    w = Window.partitionBy("config_id", "region_type", "final_label").orderBy(F.col("observational_bias_score").desc(), F.col("physical_evidence_score").desc(), "region_id")
    return regions.withColumn("report_rank", F.row_number().over(w))
