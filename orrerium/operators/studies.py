"""Case studies: a few nodes, anchors or candidates that are chosen, described and put side by side."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrerium.functions import labels
from orrerium.functions.numeric import to_numeric
from orrerium.operators.cases import rv_proxy
from orrerium.operators.graph import KEY, neighbourhoods
from orrerium.operators.regions import anchors, drivers, top
from orrerium.sources.tables import written

#: What the profile of a region and of an anchor shows, in this order, and what each takes from its decomposition.
REGION_PROFILE = ("config_id", "node_id", "n_members", "top_method", "shadow_score", "I_R3", "C_phys", "S_net", "TOI", "TOI_rank", "region_class", "dominant_toi_driver", "physical_distance_v_to_N1", "method_l1_boundary_N1")
ANCHOR_PROFILE = ("config_id", "node_id", "anchor_pl_name", "discoverymethod", "TOI", "ATI", "delta_rel_neighbors_best", "delta_rel_neighbors_mean", "r3_imputation_score", "anchor_representativeness", "deficit_class", "expected_incompleteness_direction", "dominant_ati_driver")
REGION_DRIVERS = ("dominant_toi_driver", "TOI_recomputed", "TOI_abs_error")
ANCHOR_DRIVERS = ("dominant_ati_driver", "ATI_recomputed", "ATI_abs_error")
#: The order in which a local case prefers anchors.
LOCAL_ORDER = ("r3_imputation_score", "distance_to_medoid", "nameless", "unknown")


class Study(NamedTuple):
    """A case to find: hosts are preferred; which candidates may stand for it goes by its type and the methods of their systems."""

    rank: int
    kind: str
    hosts: tuple[str, ...]
    methods: tuple[str, ...]


#: The three case studies.
STUDIES = (
    Study(1, "top_ranked_visual_case", ("WASP-132", "WASP-47", "TOI-4010", "KOI-142"), ("Transit",)),
    Study(2, "radial_velocity_like_case", ("HD 27894", "HIP 57274", "HD 153557", "55 Cnc"), ("Radial Velocity",)),
    Study(3, "mixed_or_fallback_case", ("HAT-P-17", "TOI-4010", "KOI-142", "WASP-47", "HIP 57274"), ("Mixed", "Transit")),
)


def decomposed(rows: DataFrame, score: str, factors: dict[str, Column]) -> DataFrame:
    """rows with <score>_recomputed (the factors' product, null if one is), <score>_abs_error against the stored score, and
    dominant_<score>_driver: the least and the greatest of the known factors, ties to the first named."""
    held = {f"_f_{k}": c for k, c in factors.items()}
    out = drivers(rows.withColumns(held), list(held))
    product = functools.reduce(lambda a, b: a * b, [F.col(c) for c in held])
    names = [F.substring(F.col(c), 4, 100) for c in ("bottleneck_factor", "strongest_factor")]
    told = F.coalesce(F.concat(F.lit("bottleneck="), names[0], F.lit("; strongest="), names[1]), F.lit("unknown"))
    out = out.withColumns({f"{score}_recomputed": product, f"dominant_{score.lower()}_driver": told})
    return out.withColumn(f"{score}_abs_error", F.abs(F.col(score) - F.col(f"{score}_recomputed"))).drop(*held, "bottleneck_factor", "strongest_factor")


def toi_parts(regions: DataFrame) -> DataFrame:
    """The regional index as its four factors."""
    return decomposed(regions, "TOI", {"shadow_score": F.col("shadow_score"), "low_imputation": 1.0 - F.col("I_R3"), "physical_continuity": F.col("C_phys"), "network_support": F.col("S_net")})


def ati_parts(anchored: DataFrame) -> DataFrame:
    """The anchor's index as its four factors; negative deficits count as none."""
    return decomposed(anchored, "ATI", {"TOI_region": F.col("TOI"), "local_deficit": F.greatest(F.col("delta_rel_neighbors_best"), F.col("delta_rel_neighbors_best") * 0.0), "anchor_low_imputation": 1.0 - F.col("r3_imputation_score"), "anchor_representativeness": F.col("anchor_representativeness")})


def _profile(rows: DataFrame, parts: DataFrame, keys: Sequence[str], taken: Sequence[str], shown: Sequence[str]) -> DataFrame:
    on = [k for k in keys if k in rows.columns and k in parts.columns]
    add = [c for c in taken if c in parts.columns]
    if on and add:
        rows = rows.drop(*add).join(parts.select(*on, *add).dropDuplicates(on), on, "left")
    return rows.select(*[c for c in shown if c in rows.columns])


def region_profiles(regions: DataFrame, parts: DataFrame, n: int = 5) -> DataFrame:
    """The n regions of greatest TOI with the factor that drives it. parts: the decomposition, a row a node (of several, any)."""
    return _profile(top(regions, "TOI", n), parts, [KEY, "node_id"], REGION_DRIVERS, REGION_PROFILE)


def anchor_profiles(anchored: DataFrame, parts: DataFrame, n: int = 5) -> DataFrame:
    """The n anchors of greatest ATI with the factor that drives it; an anchor is told by its node and name."""
    return _profile(top(anchored, "ATI", n), parts, [KEY, "node_id", "anchor_pl_name"], ANCHOR_DRIVERS, ANCHOR_PROFILE)


def case_studies(candidates: DataFrame, systems: DataFrame, studies: Sequence[Study] = STUDIES, classes: Sequence[str] = ("high",)) -> DataFrame:
    """A candidate for each study, of another system than those before it: case_rank, case_type, the candidate's columns, texts.

    Candidates have a host, a known period and one of the classes. A radial velocity case needs a weak signal, a visual one a system
    of its methods; a mixed one takes mixed systems before those of its methods, and these before others. Then preferred hosts,
    then score, gap and detectability, then id. A study that nothing fits has no row. systems: hostname, n_observed_planets.
    """
    pool = candidates.where(F.col("hostname").isNotNull() & to_numeric("candidate_period_days").isNotNull() & F.col("candidate_priority_class").isin(*classes))
    pool = written(pool, "case-pool")
    method = F.coalesce("dominant_discoverymethod_system", F.lit("Unknown"))
    picked = None
    for s in studies:
        level, fits = [], F.lit(True)
        if s.kind == "radial_velocity_like_case":
            fits = F.col("likely_missing_due_to") == "weak_RV_signal"
        elif s.kind == "top_ranked_visual_case":
            fits = method.isin(*s.methods)
        else:
            level = [F.when(method == "Mixed", 0).when(method.isin(*s.methods), 1).otherwise(2)]
        left = pool if picked is None else pool.join(F.broadcast(picked.select("hostname")), "hostname", "left_anti")  # a row a study
        order = [*level, ~F.col("hostname").isin(*s.hosts), *[F.col(c).desc_nulls_last() for c in ("candidate_priority_score", "gap_period_ratio", "missing_detectability_score")], F.col("candidate_id")]
        best = left.where(fits).orderBy(*order).limit(1).select(F.lit(s.rank).alias("case_rank"), F.lit(s.kind).alias("case_type"), *candidates.columns)
        best = written(best, "case-study")
        picked = best if picked is None else picked.unionByName(best)
    out = picked.join(systems.select("hostname", "n_observed_planets").dropDuplicates(["hostname"]), "hostname", "left")
    return out.withColumns({"reading": _reading(), "followup": _followup(), "caution_note": F.lit("An interval worth a follow-up, not a detection: no planet is confirmed here.")})


def _number(c: str, digits: int) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c).cast("double"))).otherwise("unknown")


def _named(c: str) -> Column:
    return F.coalesce(F.regexp_replace(F.col(c).cast("string"), "_", " "), F.lit("unknown"))


def _reading() -> Column:
    where = F.concat(F.lit("Between "), _named("inner_planet"), F.lit(" and "), _named("outer_planet"), F.lit(" of "), F.col("hostname"), F.lit(", at a period near "), _number("candidate_period_days", 2), F.lit(" days, "))
    score = F.concat(F.lit(" (score "), _number("candidate_priority_score", 3), F.lit(", likely missed for: "), _named("likely_missing_due_to"), F.lit(")."))
    radial = F.lit("a planet of a weak radial velocity signal would fit the gap")
    mixed = F.lit("the gap and the region's earlier support agree, under mixed methods")
    return F.concat(where, F.when(F.col("case_type") == "radial_velocity_like_case", radial).when(F.col("case_type") == "mixed_or_fallback_case", mixed).otherwise(F.lit("the gap stands out, with support of its region")), score)


def _followup() -> Column:
    reason = F.coalesce("likely_missing_due_to", F.lit("unknown"))
    return (
        F.when((F.col("case_type") == "radial_velocity_like_case") | (reason == "weak_RV_signal"), "radial_velocity_series")
        .when(reason.isin("shallow_transit_depth", "low_transit_probability", "long_period"), "photometry_and_transit_windows")
        .otherwise("photometry_with_radial_velocity")
    )


def local_anchors(members: DataFrame, cases: DataFrame, method: str = "discoverymethod", prefer: str = "Radial Velocity") -> DataFrame:
    """The anchor of each case node and why: of the preferred method if the node has one, least imputed, nearest to the medoid, named,
    with most of its metadata known. Members of other nodes are left out before medoids are looked for."""
    own = members.join(cases.select(KEY, "node_id").distinct(), [KEY, "node_id"], "left_semi")
    out = anchors(own, method, prefer, LOCAL_ORDER, (method,))
    reason = F.when(F.coalesce(F.col(method) == prefer, F.lit(False)), "preferred_method_least_imputed_near_medoid").otherwise("no_preferred_member_least_imputed_near_medoid")
    return out.withColumn("selection_reason", reason)


def missing_direction(anchored: DataFrame, members: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """config_id, node_id, node_rv_proxy, reference_rv_proxy, expected_missing_direction of each anchor's node.

    Medians of the radial velocity proxy over the node's members and over the reference's valid ones, each once: the first ring, the
    second if the first holds fewer than `least`, the node itself if both do. Where the node's isn't below the reference's, lower
    proxies are what is missing, else lower masses. members: pl_bmasse, pl_orbper and r3_valid.
    """
    keys = anchored.select(KEY, "node_id")
    values = rv_proxy(members).select(KEY, "node_id", "row_index", "rv_proxy", "r3_valid").dropDuplicates([KEY, "node_id", "row_index"])
    own = values.join(keys, [KEY, "node_id"], "left_semi")
    mine = own.groupBy(KEY, "node_id").agg(F.median("rv_proxy").alias("node_rv_proxy"))
    at = own.select(KEY, "node_id", "row_index", F.col("rv_proxy").alias("a_rv")).join(anchored.select(KEY, "node_id", "row_index"), [KEY, "node_id", "row_index"]).drop("row_index")
    rings = neighbourhoods(edges).join(keys, [KEY, "node_id"], "left_semi").select(KEY, "node_id", F.col("neighbour").alias("other"), "ring")
    held = rings.join(values.where("r3_valid").withColumnRenamed("node_id", "other"), [KEY, "other"]).dropDuplicates([KEY, "node_id", "ring", "row_index"])
    by = held.groupBy(KEY, "node_id", "ring").agg(F.count(F.lit(1)).alias("n"), F.median("rv_proxy").alias("m"))
    ring = by.groupBy(KEY, "node_id").agg(*[F.max(F.when((F.col("ring") == k) & (F.col("n") >= least), F.struct("m"))).alias(f"r{k}") for k in (1, 2)])
    out = mine.join(at, [KEY, "node_id"]).join(ring, [KEY, "node_id"], "left")
    used = F.coalesce("r1", "r2")
    out = out.withColumn("reference_rv_proxy", F.when(used.isNull(), F.col("node_rv_proxy")).otherwise(used["m"]))
    lower = F.col("a_rv").isNotNull() & F.coalesce(F.col("node_rv_proxy") >= F.col("reference_rv_proxy"), F.lit(False))
    return out.select(KEY, "node_id", "node_rv_proxy", "reference_rv_proxy", F.when(lower, "lower_rv_proxy_at_like_orbit").otherwise("lower_mass_at_like_orbit").alias("expected_missing_direction"))


def compare_cases(nodes: DataFrame, anchored: DataFrame, deficits: DataFrame, directions: DataFrame) -> DataFrame:
    """Case nodes with their anchors, best deficits against neighbours and analogs, direction, class, confidence and a reading.

    nodes: config_id, node_id, shadow_score, I_R3. deficits: a row a radius. A node without anchor or deficits stays: its direction
    is not_available, its class no_deficit, and its confidence rests on the node alone.
    """
    best = deficits.groupBy(KEY, "node_id").agg(F.max("delta_rel_neighbors").alias("delta_rel_neighbors_best"), F.max("delta_rel_analog").alias("delta_rel_analog_best"), F.lit(True).alias("_has"))
    who = anchored.select(KEY, "node_id", F.col("row_index").alias("anchor"), "selection_reason")
    out = nodes.join(who, [KEY, "node_id"], "left").join(best, [KEY, "node_id"], "left").join(directions.select(KEY, "node_id", "expected_missing_direction"), [KEY, "node_id"], "left")
    d = F.col("delta_rel_neighbors_best")
    out = out.withColumn("expected_missing_direction", F.when(F.col("_has"), F.col("expected_missing_direction")))
    out = out.na.fill("not_available", ["expected_missing_direction"]).drop("_has")
    out = out.withColumns({"deficit_class": labels.deficit_class(F.coalesce(d, F.lit(0.0))), "confidence_level": labels.confidence(to_numeric("shadow_score"), to_numeric("I_R3"), d)})
    found = F.when(F.col("deficit_class") == "no_deficit", " shows no deficit against its neighbours").otherwise(" looks undersampled against its neighbours")
    end = F.when(F.col("deficit_class") == "no_deficit", ").").otherwise("). A candidate for incompleteness, not evidence of absent objects.")
    return out.withColumn("final_interpretation", F.concat(F.lit("Node "), F.col("node_id").cast("string"), found, F.lit(" (best relative deficit: "), _number("delta_rel_neighbors_best", 3), end))
