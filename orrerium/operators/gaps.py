"""Gaps between neighbouring members of ordered systems, and the candidates that they may hold.

A catalogue has hostname, pl_name and pl_orbper (positive), and optionally pl_orbsmax, st_mass, st_rad,
discoverymethod. Ties of pl_orbper go by pl_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrerium.functions import labels, physics
from orrerium.functions.numeric import clip, clip01, mean_of, ratio, to_numeric
from orrerium.functions.stats import exact_quantiles
from orrerium.sources.tables import written

#: Least ratio of a gap; most candidates of one; gaps that a median needs.
MIN_RATIO = 2.8
MOST = 4
ENOUGH = 20
WEIGHTS = {"gap_score": 0.30, "topology_score": 0.25, "analog_support_score": 0.20, "missing_detectability_score": 0.15, "data_quality_score": 0.10}


def _valid(catalog: DataFrame) -> DataFrame:
    have = set(catalog.columns)
    rows = catalog.withColumn("pl_orbper", to_numeric("pl_orbper"))
    for name in ("pl_orbsmax", "st_mass", "st_rad"):
        rows = rows.withColumn(name, to_numeric(name) if name in have else F.lit(None).cast("double"))
    if "discoverymethod" not in have:
        rows = rows.withColumn("discoverymethod", F.lit(None).cast("string"))
    return rows.where((F.col("pl_orbper") > 0) & F.col("hostname").isNotNull())


def system_metadata(catalog: DataFrame, least: int = 2) -> DataFrame:
    """Hosts with at least `least` members: their number, dominant method and positive medians of the star."""
    rows = _valid(catalog).withColumn("_m", labels.canonical_method("discoverymethod"))
    medians = rows.groupBy("hostname").agg(F.count(F.lit(1)).alias("n_observed_planets"), F.median(F.when(F.col("st_mass") > 0, F.col("st_mass"))).alias("system_st_mass_median"), F.median(F.when(F.col("st_rad") > 0, F.col("st_rad"))).alias("system_st_rad_median"))
    top = rows.groupBy("hostname", "_m").agg(F.count(F.lit(1)).alias("n")).groupBy("hostname").agg(F.min_by("_m", F.struct(-F.col("n"), F.col("_m"))).alias("top"), F.max("n").alias("c"))
    out = medians.where(F.col("n_observed_planets") >= least).join(top, "hostname")
    share, first = F.col("c") / F.col("n_observed_planets"), F.col("top").isin("Transit", "Radial Velocity")
    return out.select(
        "hostname",
        "n_observed_planets",
        F.when(first & (share >= 0.60), F.col("top")).when(~first & (share >= 0.75), F.col("top")).otherwise("Mixed").alias("dominant_discoverymethod_system"),
        F.when(first & (share >= 0.60), F.col("top")).otherwise("Mixed").alias("dominant_method_group"),
        share.alias("dominant_method_fraction"),
        "system_st_mass_median",
        "system_st_rad_median",
        labels.star_bin("system_st_mass_median").alias("stellar_mass_bin"),
    )


def adjacent(catalog: DataFrame, step: int = 1) -> DataFrame:
    """Each member with the one `step` places further out in its system."""
    w = Window.partitionBy("hostname").orderBy("pl_orbper", "pl_name")
    rows = _valid(catalog)
    ahead = {f"_{c}": F.lead(c, step).over(w) for c in ("pl_name", "pl_orbper", "pl_orbsmax", "discoverymethod")}
    hidden = {"hidden_planet": F.lead("pl_name", 1).over(w), "P_hidden": F.lead("pl_orbper", 1).over(w)} if step == 2 else {}
    rows = rows.withColumns(ahead | hidden).where("_pl_orbper is not null")
    return rows.select(
        "hostname",
        F.col("pl_name").alias("inner_planet"),
        F.col("_pl_name").alias("outer_planet"),
        F.col("pl_orbper").alias("P_in"),
        F.col("_pl_orbper").alias("P_out"),
        F.col("pl_orbsmax").alias("a_in"),
        F.col("_pl_orbsmax").alias("a_out"),
        F.coalesce("discoverymethod", F.lit("Unknown")).alias("inner_discoverymethod"),
        F.coalesce("_discoverymethod", F.lit("Unknown")).alias("outer_discoverymethod"),
        (F.col("_pl_orbper") / F.col("pl_orbper")).alias("gap_ratio"),
        (F.log10("_pl_orbper") - F.log10("pl_orbper")).alias("gap_log_width"),
        *hidden,
    )


def statistics(pairs: DataFrame) -> DataFrame:
    """Median log width and number of gaps: over all, by method group, and by method group and star bin.

    Medians are exact, and no task holds the widths of a group. The groups are few: those of two labels.
    """
    return _statistics(written(pairs.select("dominant_method_group", "stellar_mass_bin", "gap_log_width"), "gap-widths"))


def _statistics(pairs: DataFrame) -> DataFrame:
    """statistics() of a table that is read more than once."""
    spark, found = pairs.sparkSession, {}
    schema = "level string, dominant_method_group string, stellar_mass_bin string, median_log_gap double, n_gaps long"
    for r in pairs.groupBy("dominant_method_group", "stellar_mass_bin").agg(F.count(F.lit(1)).alias("n")).collect():
        for group in (("global", None, None), ("method_group", r[0], None), ("method_plus_mass_bin", r[0], r[1])):
            found[group] = found.get(group, 0) + r["n"]
    groups = list(found)
    cells = {}
    for i, (level, method, star) in enumerate(groups):
        own = F.lit(level == "global") | F.col("dominant_method_group").eqNullSafe(F.lit(method))
        own = own & (F.lit(level != "method_plus_mass_bin") | F.col("stellar_mass_bin").eqNullSafe(F.lit(star)))
        cells[f"g{i}"] = F.when(own, F.col("gap_log_width"))
    medians = exact_quantiles(pairs.select(*[c.alias(g) for g, c in cells.items()]), {g: [0.5] for g in cells})
    return spark.createDataFrame([(*group, medians[f"g{i}"][0], found[group]) for i, group in enumerate(groups)], schema)


def _typical(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """The median that a pair's method and star allow: at least ENOUGH gaps, else the next wider level."""
    fine = stats.where(f"level = 'method_plus_mass_bin' and n_gaps >= {ENOUGH}").select("dominant_method_group", "stellar_mass_bin", F.col("median_log_gap").alias("_fine"))
    group = stats.where(f"level = 'method_group' and n_gaps >= {ENOUGH}").select("dominant_method_group", F.col("median_log_gap").alias("_group"))
    whole = stats.where("level = 'global'").select(F.col("median_log_gap").alias("_all"))
    out = pairs.join(fine, ["dominant_method_group", "stellar_mass_bin"], "left").join(group, "dominant_method_group", "left").join(F.broadcast(whole), how="left")
    out = out.withColumn("typical_gap_log_width", F.coalesce("_fine", "_group", "_all", F.log10(F.lit(2.0))))
    return out.withColumn("typical_gap_source", F.when(F.col("_fine").isNotNull(), "method_plus_mass_bin").when(F.col("_group").isNotNull(), "method_group").otherwise("global")).drop("_fine", "_group", "_all")


def _expected(pairs: DataFrame, min_ratio: float, most: int) -> DataFrame:
    ratio_, width = F.col("gap_ratio"), F.col("gap_log_width")
    heuristic = F.when(ratio_ >= min_ratio, clip(F.floor(F.log(ratio_) / F.log(F.lit(min_ratio))), 1, most)).otherwise(0).cast("int")
    empirical = F.when(F.col("typical_gap_log_width") > 0, clip(F.rint(F.try_divide(width, F.col("typical_gap_log_width"))) - 1, 0, most)).otherwise(0).cast("int")
    return pairs.withColumns({"expected_missing_count_heuristic": heuristic, "expected_missing_count_empirical": empirical}).withColumn("expected_missing_count", F.least(F.greatest("expected_missing_count_heuristic", "expected_missing_count_empirical"), F.lit(most)))


def _percentile(pairs: DataFrame, widths: DataFrame) -> DataFrame:
    """gap_score: the share of the corpus's gaps that are no wider.

    Widths are counted by value and value range first; only the ranges' totals (256 at most) are summed in one
    place, so no window runs over all gaps in one task.
    """
    edges = widths.agg(F.percentile_approx("gap_log_width", [k / 256 for k in range(1, 256)], 10_000)).first()[0] or []
    slot = F.lit(0)
    bounds = F.array(*[F.lit(float(x)) for x in edges]) if edges else F.array().cast("array<double>")
    slot = F.size(F.filter(bounds, lambda b: b < F.col("gap_log_width")))
    counts = widths.withColumn("_slot", slot).groupBy("_slot", "gap_log_width").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("_slot").agg(F.sum("c").alias("t"))
    before = totals.select("_slot", F.coalesce(F.sum("t").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("t").over(Window.partitionBy()).alias("_all"))
    own = F.sum("c").over(Window.partitionBy("_slot").orderBy("gap_log_width"))
    share = counts.withColumn("_own", own).join(F.broadcast(before), "_slot").select("gap_log_width", ((F.col("_own") + F.col("_before")) / F.col("_all")).alias("gap_score"))
    return pairs.join(share, "gap_log_width", "left").withColumn("gap_score", F.coalesce("gap_score", F.lit(0.0)))


def candidate_gaps(catalog: DataFrame, least: int = 2, min_ratio: float = MIN_RATIO, most: int = MOST) -> DataFrame:
    """Gaps of at least `min_ratio` with the number of members they may hide and their rank among all gaps."""
    meta = system_metadata(catalog, least)
    pairs = adjacent(catalog).join(meta.drop("n_observed_planets", "dominant_method_fraction"), "hostname")
    pairs = pairs.withColumnsRenamed({"system_st_mass_median": "candidate_stellar_mass", "system_st_rad_median": "candidate_stellar_radius"})
    pairs = written(pairs, "gap-pairs")
    scored = _percentile(_expected(_typical(pairs, _statistics(pairs)), min_ratio, most), pairs.select("gap_log_width"))
    return scored.where(F.col("gap_ratio") >= min_ratio)


def expand(gaps: DataFrame) -> DataFrame:
    """One row for each hidden member: evenly spaced in log period, its axis by Kepler or between the neighbours'."""
    rows = gaps.where("expected_missing_count > 0").withColumn("candidate_rank_in_gap", F.explode(F.sequence(F.lit(1), F.col("expected_missing_count"))))
    part = F.col("candidate_rank_in_gap") / (F.col("expected_missing_count") + 1)
    log_period = F.log10("P_in") + part * (F.log10("P_out") - F.log10("P_in"))
    rows = rows.withColumns({"candidate_fraction": part, "candidate_log_period": log_period, "candidate_period_days": F.pow(F.lit(10.0), log_period)})
    kepler = physics.semi_major_axis("candidate_period_days", "candidate_stellar_mass")
    between = F.when((F.col("a_in") > 0) & (F.col("a_out") > 0), F.pow(F.lit(10.0), F.log10("a_in") + F.col("candidate_fraction") * (F.log10("a_out") - F.log10("a_in"))))
    return rows.withColumns(
        {
            "candidate_semimajor_au": F.coalesce(kepler, between),
            "candidate_position_method": F.when(kepler.isNotNull(), "kepler").otherwise("geometric_interpolation"),
            "candidate_id": F.concat_ws("::", "hostname", "inner_planet", "outer_planet", "candidate_rank_in_gap"),
            "gap_period_ratio": F.col("gap_ratio"),
        }
    )


def leave_one_out(catalog: DataFrame, least: int = 2, min_ratio: float = MIN_RATIO, most: int = MOST) -> DataFrame:
    """Every inner member hidden in turn: what the gap around it predicts, and how near the best prediction is."""
    meta = system_metadata(catalog, least)
    named = meta.select("hostname", "dominant_method_group", "stellar_mass_bin", F.col("system_st_mass_median").alias("candidate_stellar_mass"))
    stats = statistics(adjacent(catalog).join(named, "hostname"))
    held = _expected(_typical(adjacent(catalog, 2).join(named, "hostname"), stats), min_ratio, most)
    error = F.abs(F.col("candidate_log_period") - F.log10("P_hidden"))
    best = expand(held).groupBy("hostname", "hidden_planet").agg(F.min_by("candidate_period_days", F.struct(error, F.col("candidate_rank_in_gap"))).alias("predicted_period_best"), F.min(error).alias("abs_logP_error"))
    out = held.select("hostname", "hidden_planet", "P_hidden").join(best, ["hostname", "hidden_planet"], "left")
    factor = F.greatest(ratio("predicted_period_best", "P_hidden"), ratio("P_hidden", "predicted_period_best"))

    def within(c: Column, most: float) -> Column:
        return F.coalesce(c <= most, F.lit(False))

    return out.select(
        "hostname",
        F.col("hidden_planet").alias("removed_planet"),
        F.col("P_hidden").alias("true_period_days"),
        "predicted_period_best",
        "abs_logP_error",
        F.col("predicted_period_best").isNotNull().alias("recovered"),
        within(F.col("abs_logP_error"), 0.1).alias("within_0p1_dex"),
        within(F.col("abs_logP_error"), 0.2).alias("within_0p2_dex"),
        within(factor, 1.5).alias("within_factor_1p5"),
        within(factor, 2.0).alias("within_factor_2"),
    )


def recall(validation: DataFrame) -> DataFrame:
    """One row of leave_one_out: holdouts, median error, and the shares recovered within each limit."""
    shares = [F.avg(F.col(c).cast("double")).alias(f"recall_{c}") for c in ("recovered", "within_0p1_dex", "within_0p2_dex", "within_factor_1p5", "within_factor_2")]
    return validation.agg(F.count(F.lit(1)).alias("n_holdouts"), F.median("abs_logP_error").alias("median_abs_logP_error"), *shares)


def nearest_neighbours(candidates: DataFrame, catalog: DataFrame, host: str = "hostname", period: str = "candidate_period_days", key: str = "candidate_id") -> DataFrame:
    """The strictly lower and higher periods next to each candidate in its system, and the ratios to them.

    An as-of pass over the union of both by host, so a system costs a sort, not a product.
    """
    known = _valid(catalog).select("hostname", F.col("pl_orbper").alias("p"), F.lit(None).cast("string").alias("id"))
    asked = candidates.select(F.col(host).alias("hostname"), F.col(period).cast("double").alias("p"), F.col(key).cast("string").alias("id"))
    rows = known.unionByName(asked.where("p is not null"))
    w = Window.partitionBy("hostname").orderBy("p")
    seen = F.when(F.col("id").isNull(), F.col("p"))
    below = F.max(seen).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_le", below)
    # Strictly lower: the greatest known period of the rows before the first of this period.
    distinct = known.select("hostname", "p").distinct()
    wd = Window.partitionBy("hostname").orderBy("p")
    around = distinct.withColumns({"_prev": F.lag("p").over(wd), "_next": F.lead("p").over(wd)})
    ends = distinct.groupBy("hostname").agg(F.min("p").alias("_min"))
    out = rows.where("id is not null").join(around.withColumnRenamed("p", "_le"), ["hostname", "_le"], "left").join(ends, "hostname", "left")
    inner = F.when(F.col("_le") == F.col("p"), F.col("_prev")).otherwise(F.col("_le"))
    outer = F.when(F.col("_le").isNull(), F.when(F.col("_min") > F.col("p"), F.col("_min"))).otherwise(F.col("_next"))
    out = out.withColumns({"inner_period": inner, "outer_period": outer})
    return out.select("hostname", F.col("id").alias(key), F.col("p").alias(period), "inner_period", "outer_period", ratio("p", "inner_period").alias("inner_ratio"), ratio("outer_period", "p").alias("outer_ratio"), (F.log10("outer_period") - F.log10("inner_period")).alias("gap_log_width"))


def system_proxies(catalog: DataFrame) -> DataFrame:
    """Medians by host of period, transit probability and depth, and radial-velocity amplitude."""
    have = set(catalog.columns)
    rows = catalog.withColumns({c: to_numeric(c) if c in have else F.lit(None).cast("double") for c in ("st_rad", "st_mass", "pl_orbsmax", "pl_rade", "pl_bmasse", "pl_orbper")})
    return rows.where("hostname is not null").groupBy("hostname").agg(
        F.median("pl_orbper").alias("observed_period_median"),
        F.median(physics.transit_probability_proxy("st_rad", "pl_orbsmax")).alias("observed_transit_probability_median"),
        F.median(physics.transit_depth_proxy("st_rad", "pl_rade")).alias("observed_transit_depth_median"),
        F.median(physics.rv_proxy("pl_bmasse", "st_mass", "pl_orbper")).alias("observed_rv_proxy_median"),
    )


def detectability(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """How much harder each candidate is to see than its system's known members, and the likeliest reason."""
    out = candidates.join(system_proxies(catalog), "hostname", "left")
    relative = {
        "rel_p": ratio(physics.transit_probability_proxy("candidate_stellar_radius", "candidate_semimajor_au"), "observed_transit_probability_median"),
        "rel_d": ratio(physics.transit_depth_proxy("candidate_stellar_radius", "candidate_radius_median"), "observed_transit_depth_median"),
        "rel_v": ratio(physics.rv_proxy("candidate_mass_median", "candidate_stellar_mass", "candidate_period_days"), "observed_rv_proxy_median"),
        "rel_t": ratio("candidate_period_days", "observed_period_median"),
    }
    out = out.withColumns(relative)

    def hard(name: str) -> Column:
        return F.coalesce(clip(1.0 - F.least(F.col(name), F.lit(1.0)), 0.0, 1.0), F.lit(0.0))

    out = out.withColumns({"hard_p": hard("rel_p"), "hard_d": hard("rel_d"), "hard_v": hard("rel_v"), "far": F.when(F.col("rel_t") > 1, clip(F.log10("rel_t"), 0.0, 1.0)).otherwise(0.0)})
    p, d, v, t = (F.col(c) for c in ("hard_p", "hard_d", "hard_v", "far"))
    transit, velocity = F.col("dominant_method_group") == "Transit", F.col("dominant_method_group") == "Radial Velocity"
    score = F.when(transit, 0.45 * p + 0.35 * d + 0.20 * t).when(velocity, 0.60 * v + 0.40 * t).otherwise(0.30 * p + 0.20 * d + 0.30 * v + 0.20 * t)
    top = F.greatest(p, d, v, t)
    why_mixed = F.when(top < 0.25, "unknown").when(v == top, "weak_RV_signal").when(d == top, "shallow_transit_depth").when(p == top, "low_transit_probability").otherwise("long_period")
    late = F.when(t >= 0.35, "long_period").otherwise("unknown")
    why_transit = F.when((d >= F.greatest(p, t)) & (d >= 0.25), "shallow_transit_depth").when((p >= F.greatest(d, t)) & (p >= 0.25), "low_transit_probability").otherwise(late)
    why_velocity = F.when((v >= t) & (v >= 0.25), "weak_RV_signal").otherwise(late)
    return out.withColumns({"missing_detectability_score": clip01(score), "likely_missing_due_to": F.when(transit, why_transit).when(velocity, why_velocity).otherwise(why_mixed)}).withColumnsRenamed(
        {"rel_p": "candidate_transit_probability_relative_to_observed_median", "rel_d": "candidate_transit_depth_relative_to_observed_median", "rel_v": "candidate_RV_proxy_relative_to_observed_median", "rel_t": "candidate_period_relative_to_observed_median"}
    ).drop("hard_p", "hard_d", "hard_v", "far")


def data_quality(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """data_quality_score: the mean weight of the neighbours' values and of the candidate's own."""
    have = set(catalog.columns)
    terms = [labels.quality_of(c, have) for c in ("pl_orbper", "pl_orbsmax", "pl_bmasse", "pl_rade")]
    known = catalog.groupBy("pl_name").agg(*[F.first(t).alias(f"q{k}") for k, t in enumerate(terms)])
    out = candidates
    for side in ("inner", "outer"):
        out = out.join(known.select(F.col("pl_name").alias(f"{side}_planet"), *[F.col(f"q{k}").alias(f"{side}_q{k}") for k in range(4)]), f"{side}_planet", "left")
    have = set(candidates.columns)

    def given(name: str, weight: float) -> Column:
        return F.when(F.col(name).isNotNull(), weight) if name in have else F.lit(None).cast("double")

    place = F.when(F.col("candidate_position_method") == "kepler", 0.85).when(F.col("candidate_position_method") == "geometric_interpolation", 0.65)
    parts = [F.col(f"{s}_q{k}") for s in ("inner", "outer") for k in range(4)] + [place, given("candidate_stellar_mass", 0.80), given("candidate_stellar_radius", 0.80), given("candidate_mass_median", 0.75), given("candidate_radius_median", 0.75)]
    return out.withColumn("data_quality_score", clip01(mean_of(parts))).drop(*[f"{s}_q{k}" for s in ("inner", "outer") for k in range(4)])


def priority(candidates: DataFrame, weights: dict[str, float] | None = None, high_ratio: float = 4.0) -> DataFrame:
    """candidate_priority_score and candidate_priority_class; missing parts count as 0."""
    weights = weights or WEIGHTS
    have = set(candidates.columns)
    part = {c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0) for c in weights}
    score = clip01(sum((w * part[c] for c, w in weights.items()), F.lit(0.0)))
    geometric = (F.coalesce("gap_period_ratio", F.lit(0.0)) >= high_ratio) | (part["gap_score"] >= 0.75)
    seen = (part["missing_detectability_score"] >= 0.35) & (F.coalesce(F.col("likely_missing_due_to"), F.lit("unknown")) != "unknown" if "likely_missing_due_to" in have else F.lit(False))
    out = candidates.withColumn("candidate_priority_score", score)
    s = F.col("candidate_priority_score")
    return out.withColumn("candidate_priority_class", F.when((s >= 0.70) & geometric & (part["topology_score"] >= 0.35) & seen, "high").when(s >= 0.40, "medium").otherwise("low"))


def systems(meta: DataFrame, candidates: DataFrame, gaps: DataFrame) -> DataFrame:
    """Each system with its gaps and candidates summed up; the best candidate is that of the greatest score, then least id."""
    g = gaps.groupBy("hostname").agg(F.count(F.lit(1)).alias("n_gaps"), F.max("gap_ratio").alias("max_gap_ratio"))
    order = F.struct(-F.col("candidate_priority_score"), F.col("candidate_id"))
    c = candidates.groupBy("hostname").agg(F.count(F.lit(1)).alias("n_candidates"), F.max("candidate_priority_score").alias("max_priority_score"), F.avg("candidate_priority_score").alias("mean_priority_score"), F.min_by("candidate_id", order).alias("best_candidate_id"), F.min_by("candidate_priority_class", order).alias("system_priority_class"))
    out = meta.join(g, "hostname", "left").join(c, "hostname", "left")
    return out.withColumns({"n_gaps": F.coalesce("n_gaps", F.lit(0)), "n_candidates": F.coalesce("n_candidates", F.lit(0)), "system_priority_class": F.coalesce("system_priority_class", F.lit("low"))})
