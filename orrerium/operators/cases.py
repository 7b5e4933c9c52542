"""Anchors and regions as cases: how stable a deficit is, indices that allow for it, and which cases to show.

Ties in every ranking go to the lesser name and node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrerium.functions import labels
from orrerium.functions.numeric import clip, safe_log10, to_numeric

ANCHOR = ("anchor_pl_name", "node_id")
EPSILON = 1e-9
#: Radii of a deficit and the columns they become; other spellings of a deficit table's columns.
RADII = {"r_kNN": "delta_rel_kNN", "r_node_median": "delta_rel_node_median", "r_node_q75": "delta_rel_node_q75"}
SPELLINGS = {
    "anchor_pl_name": ("anchor_pl_name", "pl_name", "planet_name", "anchor_name"),
    "node_id": ("node_id", "node", "mapper_node_id"),
    "radius_type": ("radius_type", "radius", "radius_name"),
    "radius_value": ("radius_value", "radius_size", "radius_numeric"),
    "N_obs": ("N_obs", "n_obs", "observed_neighbors"),
    "N_exp_neighbors": ("N_exp_neighbors", "n_exp_neighbors", "expected_neighbors"),
    "delta_N_neighbors": ("delta_N_neighbors", "Delta_N_neighbors", "delta_n_neighbors"),
    "delta_rel_neighbors": ("delta_rel_neighbors", "Delta_rel_neighbors", "relative_deficit_neighbors"),
}
UNSTABLE = ("radius_sensitive_deficit", "unstable_due_to_large_radius")
STABLE = ("stable_positive_deficit", "small_but_stable_deficit")


def canonical_columns(df: DataFrame) -> DataFrame:
    """A deficit table under its own column names: of each column's spellings the first one that is there."""
    found = {}
    for name, spellings in SPELLINGS.items():
        if at := next((s for s in spellings if s in df.columns), None):
            found[at] = name
    clash = set(found.values()) - set(found)
    return df.drop(*[c for c in df.columns if c in clash and c not in found]).withColumnsRenamed(found)


def recomputed(deficits: DataFrame, epsilon: float = EPSILON, tolerance: float = 1e-6) -> DataFrame:
    """Deficits from their counts beside those stored, with deficit_formula_check: ok, mismatch_recomputed_used or
    missing_expected_or_observed."""
    df = canonical_columns(deficits)
    if lost := [c for c in ("anchor_pl_name", "node_id", "radius_type", "N_obs", "N_exp_neighbors") if c not in df.columns]:
        raise ValueError(f"deficits lack {', '.join(lost)}")
    df = df.withColumns({c: F.lit(None).cast("double") for c in ("radius_value", "delta_N_neighbors", "delta_rel_neighbors") if c not in df.columns})
    exp, obs = to_numeric("N_exp_neighbors"), to_numeric("N_obs")
    df = df.withColumns({"delta_N_neighbors_recomputed": exp - obs, "delta_rel_neighbors_recomputed": (exp - obs) / (exp + epsilon)})
    same = F.lit(True)
    for c in ("delta_N_neighbors", "delta_rel_neighbors"):
        same &= F.abs(to_numeric(c) - F.col(f"{c}_recomputed")) <= tolerance
    check = F.when(exp.isNull() | obs.isNull(), "missing_expected_or_observed").when(F.coalesce(same, F.lit(False)), "ok").otherwise("mismatch_recomputed_used")
    return df.withColumn("deficit_formula_check", check)


def formula_audit(deficits: DataFrame) -> DataFrame:
    """One row: the greatest stored and recomputed deficits, and how many don't agree."""
    return deficits.agg(
        F.max("delta_rel_neighbors").alias("raw_delta_rel_max"),
        F.max("delta_rel_neighbors_recomputed").alias("recomputed_delta_rel_max"),
        F.max("delta_N_neighbors_recomputed").alias("recomputed_delta_n_max"),
        F.count_if(F.col("deficit_formula_check") == "mismatch_recomputed_used").alias("mismatch_count"),
    )


def profile_class(knn: Column, median: Column, q75: Column) -> Column:
    """What three radii say together: stable, small but stable, sensitive to the radius, undone by larger radii, or none."""
    known = F.filter(F.array(knn, median, q75), lambda x: x.isNotNull())
    plus = F.size(F.filter(known, lambda x: x > 0))
    every = (F.size(known) > 0) & (plus == F.size(known))
    undone = F.coalesce(knn > 0, F.lit(False)) & (F.coalesce(median < 0, F.lit(False)) | F.coalesce(q75 < 0, F.lit(False)))
    return (
        F.when(plus == 0, "no_deficit_or_overpopulated").when(every & (F.array_max(known) <= 0.15), "small_but_stable_deficit").when(every, "stable_positive_deficit").when(undone, "unstable_due_to_large_radius").otherwise("radius_sensitive_deficit")
    )


def _mean(parts: Sequence[Column]) -> Column:
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def _spread(parts: Sequence[Column]) -> Column:
    """Population deviation of what is known, by a running mean: values of 1e10 beside ones near 0 keep their last digit."""
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1.0)
        return F.struct((a["n"] + 1.0).alias("n"), mean.alias("mean"), (a["m2"] + (x - mean) * (x - a["mean"])).alias("m2"))

    return F.when(F.size(known) > 0, F.aggregate(known, start, add, lambda a: F.sqrt(a["m2"] / a["n"])))


def stability(deficits: DataFrame, anchors: DataFrame, regions: DataFrame, every: bool = False) -> DataFrame:
    """One row an anchor and node: its recomputed deficit by radius, their statistics and class, with the anchor's and the region's columns.

    Of repeated rows of one radius the least value counts, of repeated anchors and regions the least row; with `every`, each row of
    an anchor has a row of its own.
    """
    wide = deficits.groupBy(*ANCHOR).agg(*[F.min(F.when(F.col("radius_type") == r, F.col("delta_rel_neighbors_recomputed"))).alias(c) for r, c in RADII.items()])
    parts = [F.col(c) for c in RADII.values()]
    known = F.array_sort(F.filter(F.array(*parts), lambda x: x.isNotNull()))
    n = F.size(known)
    middle = F.when(n > 0, (F.get(known, ((n - 1) / 2).cast("int")) + F.get(known, (n / 2).cast("int"))) / 2.0)
    mean = _mean(parts)
    out = wide.withColumns({"delta_rel_mean": mean, "delta_rel_median": middle, "delta_rel_min": F.array_min(known), "delta_rel_max": F.array_max(known)})
    spread = _spread(parts)

    def count(sign: int) -> Column:
        return F.size(F.filter(known, lambda x: x * sign > 0)).cast("long")

    out = out.withColumns({"delta_rel_std": spread, "n_positive_radii": count(1), "n_negative_radii": count(-1)})
    positive = _mean([F.greatest(p, F.when(p.isNotNull(), 0.0)) for p in parts])
    out = out.withColumns({
        "all_radii_positive": F.col("n_positive_radii") == len(parts),
        "any_large_radius_negative": F.coalesce(parts[1] < 0, F.lit(False)) | F.coalesce(parts[2] < 0, F.lit(False)),
        "radius_sensitivity_score": F.col("delta_rel_max") - F.col("delta_rel_min"),
        "stable_deficit_score": positive * F.col("n_positive_radii") / len(parts),
        "deficit_stability_class": profile_class(*parts),
    })
    beside = [c for c in ("ATI", "TOI", "r3_imputation_score", "anchor_representativeness", "deficit_class", "expected_incompleteness_direction", "discoverymethod", "disc_year", "disc_facility") if c in anchors.columns]
    around = [c for c in ("n_members", "shadow_score", "I_R3", "C_phys", "S_net", "top_method") if c in regions.columns]
    own = out.join(anchors.select(*ANCHOR, *beside), list(ANCHOR), "left") if every else _with(out, anchors, ANCHOR, beside)
    return _with(own, regions, ("node_id",), around)


def _with(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left with the columns of the right's least row of its key."""
    columns = [c for c in columns if c not in left.columns]
    if not columns:
        return left
    one = right.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_one")).select(*keys, *[F.col(f"_one.{c}").alias(c) for c in columns])
    return left.join(one, list(keys), "left")


def _or(df: DataFrame, c: str, default: float) -> Column:
    return F.coalesce(to_numeric(c), F.lit(float(default))) if c in df.columns else F.lit(float(default))


def rank_min(by: Column) -> Column:
    """Rank from the greatest down, equal values sharing the least rank; null has none."""
    return F.when(by.isNotNull(), F.rank().over(Window.orderBy(by.desc_nulls_last())))


def robust_anchors(anchors: DataFrame, stable: DataFrame, sensitivity: DataFrame | None = None, epsilon: float = EPSILON) -> DataFrame:
    """ATI under penalties: by the share of radii with a deficit, by signal over noise, by the mean against the best radius, and
    conservatively (also for large radii below 0, imputed anchors and small nodes), with ranks over all anchors.

    Anchors are nodes of graphs, thousands and not rows of a catalogue, so ranks are taken in one window.
    """
    beside = [c for c in ("delta_rel_mean", "delta_rel_median", "delta_rel_min", "delta_rel_max", "delta_rel_std", "n_positive_radii", "all_radii_positive", "any_large_radius_negative", "radius_sensitivity_score", "stable_deficit_score", "deficit_stability_class", "n_members", "I_R3", "S_net", "top_method") if c in stable.columns]
    df = _with(anchors, stable, ANCHOR, beside)
    if sensitivity is not None:
        df = df.join(sensitivity, list(ANCHOR), "left")
    members = _or(df, "n_members", 0)
    typical = df.agg(F.greatest(F.coalesce(F.median(F.when(members > 0, members)), F.lit(10.0)), F.lit(10.0)).alias("_typical"))
    df = df.crossJoin(F.broadcast(typical))  # one row
    ati, mean = _or(df, "ATI", 0), _or(df, "delta_rel_mean", 0)
    best = F.greatest(_or(df, "delta_rel_neighbors_best", 0), F.lit(0.0))
    large = F.when(F.coalesce(F.col("any_large_radius_negative"), F.lit(False)) if "any_large_radius_negative" in df.columns else F.lit(False), 0.5).otherwise(1.0)
    imputed = 1.0 - 0.5 * clip(_or(df, "r3_imputation_score", 0), 0, 1)
    size = 0.5 + 0.5 * clip(F.sqrt(members / F.col("_typical")), 0, 1)
    simple = ati * clip(_or(df, "n_positive_radii", 0) / 3.0, 0, 1)
    df = df.withColumns({
        "ATI_original": ati,
        "ATI_stable_simple": simple,
        "ATI_stable_signal_to_noise": ati / (1.0 + F.exp(-mean / (_or(df, "delta_rel_std", 0) + epsilon))),
        "ATI_radius_penalized": ati * F.greatest(F.greatest(mean, F.lit(0.0)) / (best + epsilon), F.lit(0.0)),
        "ATI_conservative": simple * large * imputed * size,
    }).drop("_typical")
    df = df.withColumns({"rank_ATI_original": rank_min(F.col("ATI_original")), "rank_ATI_conservative": rank_min(F.col("ATI_conservative"))})
    return df.withColumn("rank_shift", F.col("rank_ATI_conservative") - F.col("rank_ATI_original")).withColumn("caution", caution(df))


def caution(df: DataFrame) -> Column:
    """What to beware of, `none` if nothing."""
    unstable = F.col("deficit_stability_class").isin(*UNSTABLE) if "deficit_stability_class" in df.columns else F.lit(False)
    said = [F.when(unstable, "radius"), F.when(_or(df, "r3_imputation_score", 0) > 0.2, "imputation"), F.when(_or(df, "n_members", 0) < 10, "support")]
    told = F.concat_ws(";", *said)
    return F.when(told == "", "none").otherwise(told)


def region_robustness(regions: DataFrame, sensitivity: DataFrame | None = None) -> DataFrame:
    """region_robustness_class: imputation first (I_R3 above 0.2), then how far the rank moves under other weights."""
    df = regions.join(sensitivity, "node_id", "left") if sensitivity is not None else regions
    spread = _or(df, "TOI_rank_std_sensitivity", 0)
    label = F.when(_or(df, "I_R3", 0) > 0.2, "imputation_sensitive_region").when(spread <= 2, "robust_priority_region").when(spread <= 5, "moderately_sensitive_region").otherwise("fragile_region")
    return df.withColumn("region_robustness_class", label).withColumnsRenamed({"TOI": "TOI_original", "TOI_rank": "TOI_rank_original"})


def normalised(df: DataFrame, columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """Each column over its range: 0 to 1, 1 throughout if constant, 0 throughout if empty; null stays null otherwise."""
    ends = df.agg(*[f(to_numeric(c)).alias(f"_{n}_{k}") for k, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(ends))  # one row
    for k, c in enumerate(columns):
        lo, hi = F.col(f"_lo_{k}"), F.col(f"_hi_{k}")
        flat = F.abs(hi - lo) <= 1e-8 + 1e-5 * F.abs(lo)
        out = out.withColumn(f"{c}{suffix}", F.when(lo.isNull(), 0.0).when(flat, 1.0).otherwise((to_numeric(c) - lo) / (hi - lo)))
    return out.drop(*ends.columns)


def observational_priority(anchors: DataFrame, n: int = 10) -> DataFrame:
    """The n anchors of the greatest weighted priority; a null part makes the score null, which comes last."""
    parts = {"ATI_conservative": 0.35, "TOI": 0.25, "stable_deficit_score": 0.20, "anchor_representativeness": 0.10, "radius_sensitivity_score": -0.10}
    df = anchors.withColumns({c: F.lit(None).cast("double") for c in parts if c not in anchors.columns})
    df = normalised(df, list(parts), "_part")
    score = 0.10 * (1.0 - clip(_or(df, "r3_imputation_score", 0), 0, 1))
    for c, w in parts.items():
        score = score + w * F.col(f"{c}_part")
    df = df.withColumn("observational_priority_score", score).drop(*[f"{c}_part" for c in parts])
    return df.orderBy(F.col("observational_priority_score").desc_nulls_last(), *ANCHOR).limit(n)


def technical_issues(anchors: DataFrame, deficits: DataFrame | None = None) -> DataFrame:
    """issue_type, anchor_pl_name, node_id: each thing to look at, once for an anchor and node."""
    nodes = anchors.groupBy("anchor_pl_name").agg(F.count_distinct("node_id").alias("n_nodes_as_anchor"))
    cut = anchors.agg(F.percentile(to_numeric("ATI_original"), 0.90).alias("_cut")) if "ATI_original" in anchors.columns else anchors.agg(F.lit(None).cast("double").alias("_cut"))
    df = anchors.join(nodes.withColumnRenamed("anchor_pl_name", "_name"), F.col("anchor_pl_name").eqNullSafe(F.col("_name"))).drop("_name").crossJoin(F.broadcast(cut))
    unstable = F.col("deficit_stability_class").isin(*UNSTABLE) if "deficit_stability_class" in df.columns else F.lit(False)
    found = {
        "high_ATI_but_radius_sensitive": (_or(df, "ATI_original", 0) >= F.col("_cut")) & unstable,
        "high_delta_best_low_delta_mean": (_or(df, "delta_rel_neighbors_best", 0) > 0.10) & (_or(df, "delta_rel_mean", 0) <= 0.05),
        "high_imputation": _or(df, "r3_imputation_score", 0) > 0.20,
        "small_node_support": (_or(df, "n_members", 0) < 10) | (_or(df, "S_net", 1) < 0.30),
        "repeated_anchor_needs_context": F.col("n_nodes_as_anchor") >= 2,
    }
    each = df.select(*ANCHOR, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in found.items()]))).alias("issue_type"))
    if deficits is not None and "deficit_formula_check" in deficits.columns:
        each = each.unionByName(deficits.where("deficit_formula_check <> 'ok'").select(*ANCHOR, F.lit("possible_units_issue").alias("issue_type")))
    return each.distinct()


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


def repeated_anchors(anchors: DataFrame, least: int = 2) -> DataFrame:
    """Anchors of several nodes: n_nodes_as_anchor, nodes_list, and their greatest, mean and summed indices."""
    nodes = F.array_join(F.array_sort(F.collect_set(F.col("node_id").cast("string"))), ", ")
    have = set(anchors.columns)
    extra = [F.max(c).alias(f"max_{c}") for c in ("ATI", "TOI", "ATI_original", "ATI_conservative") if c in have]
    extra += [f("ATI").alias(f"{n}_ATI") for n, f in (("mean", F.avg), ("sum", F.sum)) if "ATI" in have]
    return anchors.groupBy("anchor_pl_name").agg(F.count_distinct("node_id").alias("n_nodes_as_anchor"), nodes.alias("nodes_list"), *extra).where(F.col("n_nodes_as_anchor") >= least)


def _first(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(1)


def _down(c: str) -> Column:
    return F.col(c).desc_nulls_last()


_CASE = ("anchor_pl_name", "node_id", "TOI", "ATI_original", "ATI_conservative", "delta_rel_mean", "deficit_stability_class", "rank_shift")


def _case(df: DataFrame, kind: str, nodes: Column | None = None) -> DataFrame:
    kinds = {"anchor_pl_name": "string", "node_id": "string", "deficit_stability_class": "string", "rank_shift": "long"}
    cols = []
    for c in _CASE:
        at = next((x for x in ((f"{c}_original", c) if c == "TOI" else (c,)) if x in df.columns), None)
        cols.append((F.col(at) if at else F.lit(None)).cast(kinds.get(c, "double")).alias(c))
    return df.select(F.lit(kind).alias("case_type"), *cols, (nodes if nodes is not None else F.lit("")).alias("repeated_anchor_nodes"))


def future_cases(regions: DataFrame, anchors: DataFrame, n: int = 5) -> DataFrame:
    """At most one case each: the best region, the best anchor by the plain and by the conservative index, the anchor of most nodes
    and the most stable deficit. Rows of one anchor and node that a ranking leaves equal go by the plain index, then by all else that is shown."""
    last = [*ANCHOR, *[_down(c) for c in ("ATI_original", *_CASE) if c in anchors.columns and c not in ANCHOR]]
    top = repeated_anchors(anchors).orderBy(_down("n_nodes_as_anchor"), _down("max_ATI_conservative"), "anchor_pl_name").limit(1).select("anchor_pl_name", "nodes_list")
    spread = "TOI_rank_mean_sensitivity"
    found = [
        _case(_first(regions, _down("TOI_original"), *([F.col(spread).asc_nulls_last()] if spread in regions.columns else []), F.col("node_id")), "top_toi_region"),
        _case(_first(anchors, _down("ATI_original"), *last), "top_ati_original_anchor"),
        _case(_first(anchors, _down("ATI_conservative"), *last), "top_ati_conservative_anchor"),
        _case(_first(anchors.join(top, "anchor_pl_name"), _down("ATI_conservative"), _down("ATI_original"), F.col("node_id"), *last), "repeated_anchor_transition_case", F.col("nodes_list")),
        _case(_first(anchors.where(F.col("deficit_stability_class").isin(*STABLE)), _down("stable_deficit_score"), _down("ATI_conservative"), *last), "stable_deficit_anchor"),
    ]
    out = found[0]
    for f in found[1:n]:
        out = out.unionByName(f)
    return out


def presentation_cases(regions: DataFrame, anchors: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """Three cases: the best region, the best anchor, and the anchor of most nodes (without one, the member of most nodes)."""
    have = set(regions.columns)
    order = [_down("TOI"), *[f for c, f in (("n_members", _down("n_members")), ("I_R3", F.col("I_R3").asc_nulls_last()), ("S_net", _down("S_net"))) if c in have], F.col("node_id")]
    kinds = "case_type string, anchor_pl_name string, node_id string, n_nodes_as_anchor long, nodes_list string"
    none = F.lit(None)
    region = _first(regions, *order).select(F.lit("top_toi_region").alias("case_type"), none.cast("string").alias("anchor_pl_name"), F.col("node_id").cast("string").alias("node_id"), none.cast("long").alias("n_nodes_as_anchor"), F.lit("").alias("nodes_list"))
    best = _first(anchors, _down("ATI"), _down("delta_rel_neighbors_best"), F.col("r3_imputation_score").asc_nulls_last(), _down("anchor_representativeness"), *ANCHOR)
    anchor = best.select(F.lit("top_ati_anchor").alias("case_type"), F.col("anchor_pl_name").cast("string").alias("anchor_pl_name"), F.col("node_id").cast("string").alias("node_id"), F.lit(1).cast("long").alias("n_nodes_as_anchor"), F.col("node_id").cast("string").alias("nodes_list"))
    many = repeated_anchors(anchors).select(F.lit(0).alias("_o"), "anchor_pl_name", "n_nodes_as_anchor", "nodes_list", F.col("max_ATI").alias("_m"), F.col("sum_ATI").alias("_s"))
    if membership is not None:
        nodes = F.array_join(F.array_sort(F.collect_set(F.col("node_id").cast("string"))), ", ")
        members = membership.where("pl_name is not null").groupBy(F.col("pl_name").alias("anchor_pl_name")).agg(F.count_distinct("node_id").alias("n_nodes_as_anchor"), nodes.alias("nodes_list")).where("n_nodes_as_anchor >= 2")
        many = many.unionByName(members.select(F.lit(1).alias("_o"), "*", none.cast("double").alias("_m"), none.cast("double").alias("_s")))
    chosen = _first(many, F.col("_o"), _down("n_nodes_as_anchor"), _down("_m"), _down("_s"), F.col("anchor_pl_name"))
    repeated = chosen.select(F.lit("repeated_anchor_multi_node").alias("case_type"), F.col("anchor_pl_name").cast("string").alias("anchor_pl_name"), F.element_at(F.split("nodes_list", ", "), 1).alias("node_id"), "n_nodes_as_anchor", "nodes_list")
    return region.unionByName(anchor).unionByName(repeated).to(_schema(kinds, regions))


def _schema(ddl: str, df: DataFrame):
    return df.sparkSession.createDataFrame([], ddl).schema


def detailed_cases(anchors: DataFrame, nodes: Sequence[str] = (), names: Sequence[str] = (), n: int = 5) -> DataFrame:
    """The first n of: anchors from the greatest ATI down, then the nodes and the anchors asked for; each pair once."""
    spark = anchors.sparkSession
    ranked = anchors.select(F.lit(0).alias("_o"), F.row_number().over(Window.orderBy(_down("ATI"), *ANCHOR)).alias("_k"), F.col("node_id").cast("string").alias("node_id"), F.col("anchor_pl_name").cast("string").alias("anchor_pl_name"), F.lit("top_ATI").alias("selection_reason"))
    asked = [(1, k, x, None, "default_node") for k, x in enumerate(nodes)] + [(2, k, None, x, "default_anchor") for k, x in enumerate(names)]
    every = ranked.unionByName(spark.createDataFrame(asked, "_o int, _k int, node_id string, anchor_pl_name string, selection_reason string"))
    first = every.groupBy("node_id", "anchor_pl_name").agg(F.min(F.struct("_o", "_k", "selection_reason")).alias("f"))
    return first.orderBy("f._o", "f._k").limit(n).select("node_id", "anchor_pl_name", "f.selection_reason")


def registry(regions: DataFrame, anchors: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """All regions and anchors as cases, with what each is a case of; appears_in_final_cases against `final` (anchor_pl_name, node_id)."""
    region_cut = regions.agg(F.coalesce(F.percentile(to_numeric("TOI_original"), 0.90), F.lit(0.0)).alias("_cut"))
    no = F.lit(False)
    left = regions.crossJoin(F.broadcast(region_cut)).select(
        F.lit("region").alias("case_kind"), F.col("node_id").cast("string").alias("case_id"), F.lit(None).cast("string").alias("anchor_pl_name"), F.col("node_id").cast("string").alias("node_id"), to_numeric("TOI_original").alias("TOI"),
        F.lit(None).cast("double").alias("ATI_original"), F.lit(None).cast("double").alias("ATI_conservative"), F.lit(None).cast("string").alias("deficit_stability_class"),
        (F.coalesce(to_numeric("TOI_original"), F.lit(0.0)) >= F.col("_cut")).alias("is_top_region"),
        no.alias("is_repeated_anchor"), no.alias("is_stable_deficit_case"), no.alias("is_radius_sensitive_case"), no.alias("high_toi_weak_deficit"), no.alias("low_toi_moderate_deficit"),
    )
    many = repeated_anchors(anchors).select(F.col("anchor_pl_name").alias("_name"), F.lit(True).alias("_many"))
    anchor_cut = anchors.agg(F.coalesce(F.percentile(to_numeric("TOI"), 0.90), F.lit(0.0)).alias("_cut"))
    rows = anchors.join(many, F.col("anchor_pl_name").eqNullSafe(F.col("_name")), "left").crossJoin(F.broadcast(anchor_cut))
    kind, high = F.coalesce(F.col("deficit_stability_class"), F.lit("")), F.coalesce(to_numeric("TOI"), F.lit(0.0)) >= F.col("_cut")
    right = rows.select(
        F.lit("anchor").alias("case_kind"), F.concat_ws("::", F.col("anchor_pl_name").cast("string"), F.col("node_id").cast("string")).alias("case_id"), F.col("anchor_pl_name").cast("string").alias("anchor_pl_name"), F.col("node_id").cast("string").alias("node_id"), to_numeric("TOI").alias("TOI"),
        to_numeric("ATI_original").alias("ATI_original"), to_numeric("ATI_conservative").alias("ATI_conservative"), kind.alias("deficit_stability_class"), no.alias("is_top_region"),
        F.coalesce("_many", no).alias("is_repeated_anchor"), kind.isin(*STABLE).alias("is_stable_deficit_case"), kind.isin(*UNSTABLE).alias("is_radius_sensitive_case"),
        (high & (kind == "no_deficit_or_overpopulated")).alias("high_toi_weak_deficit"), (~high & kind.isin(*STABLE, UNSTABLE[0])).alias("low_toi_moderate_deficit"),
    )
    out = left.unionByName(right)
    if final is None:
        return out
    pairs = final.where("node_id is not null").select(F.lit("anchor").alias("_kind"), F.col("anchor_pl_name").cast("string").alias("_a"), F.col("node_id").cast("string").alias("_n"))
    hits = pairs.unionByName(pairs.select(F.lit("region").alias("_kind"), F.lit(None).cast("string").alias("_a"), "_n")).distinct().withColumn("_in", F.lit(True))
    on = (F.col("case_kind") == F.col("_kind")) & F.col("anchor_pl_name").eqNullSafe(F.col("_a")) & (F.col("node_id") == F.col("_n"))
    return out.join(hits, on, "left").withColumn("appears_in_final_cases", F.coalesce("_in", no)).drop("_kind", "_a", "_n", "_in")


def by_radius(deficits: DataFrame, value: str = "delta_rel_neighbors") -> DataFrame:
    """One row a node and anchor: the greatest deficit of each radius, their mean, median and best (0 at least), the radius of the best
    (ties in the order of RADII) and whether they agree."""
    wide = deficits.groupBy("node_id", "anchor_pl_name").agg(*[F.max(F.when(F.col("radius_type") == r, F.col(value))).alias(r) for r in RADII])
    known = F.array_sort(F.filter(F.array(*RADII), lambda x: x.isNotNull()))
    n = F.size(known)
    best = F.array_max(F.filter(F.array(*[F.struct(F.col(r).alias("v"), F.lit(-k).alias("k"), F.lit(r).alias("r")) for k, r in enumerate(RADII)]), lambda s: s["v"].isNotNull()))
    return wide.withColumns({
        "delta_rel_neighbors_mean": _mean([F.col(r) for r in RADII]),
        "delta_rel_neighbors_median": F.when(n > 0, (F.get(known, ((n - 1) / 2).cast("int")) + F.get(known, (n / 2).cast("int"))) / 2.0),
        "delta_rel_neighbors_best": F.greatest(F.array_max(known), F.when(n > 0, 0.0)),
        "best_radius": best["r"],
        "deficit_stability_label": labels.stability_of(F.array(*RADII)),
    })


def radius_detail(anchors: DataFrame, deficits: DataFrame, n: int = 5) -> DataFrame:
    """The deficits of the n anchors of the greatest ATI, in the order of RADII."""
    top = anchors.orderBy(_down("ATI"), *ANCHOR).limit(n).select(*ANCHOR, "ATI", "TOI")
    order = F.coalesce(*[F.when(F.col("radius_type") == r, k) for k, r in enumerate(RADII)])
    return deficits.drop("ATI", "TOI").join(F.broadcast(top), list(ANCHOR)).withColumn("radius_order", order)


def rv_proxy(df: DataFrame) -> DataFrame:
    """rv_proxy = log m - log P / 3, and with the star's mass - 2/3 log M; null unless all are positive."""
    m, p = safe_log10("pl_bmasse"), safe_log10("pl_orbper")
    out = df.withColumn("rv_proxy", m - p / 3.0)
    return out.withColumn("rv_proxy_with_star", m - p / 3.0 - 2.0 / 3.0 * safe_log10("st_mass")) if "st_mass" in df.columns else out


def choose_nodes(metrics: DataFrame, candidates: DataFrame, config_id: str, asked: Sequence[str], method: str, n: int, least: int) -> DataFrame:
    """n case nodes of a configuration: those asked for that exist, in order, then candidates of the method with enough members,
    by shadow score, members and least imputation. slot, node_id, requested_node_id."""
    spark = metrics.sparkSession
    wanted = spark.createDataFrame([(k, x) for k, x in enumerate(asked)], "slot int, node_id string")
    there = metrics.where(F.col("config_id").cast("string") == config_id).select(F.col("node_id").cast("string").alias("node_id")).distinct()
    found = wanted.join(there, "node_id", "left_semi").select(F.lit(0).alias("_o"), F.col("slot").cast("long").alias("_k"), "node_id", F.lit(None).cast("string").alias("requested_node_id"))
    pool = candidates.where((F.col("config_id").cast("string") == config_id) & (F.col("top_method") == method) & (F.coalesce(to_numeric("n_members"), F.lit(0.0)) >= least)).withColumn("node_id", F.col("node_id").cast("string"))
    order = [_down("shadow_score"), _down("n_members"), *([F.col("mean_imputation_fraction").asc_nulls_last()] if "mean_imputation_fraction" in pool.columns else []), F.col("node_id")]
    pool = pool.join(found.select("node_id"), "node_id", "left_anti").withColumn("_k", F.row_number().over(Window.orderBy(*order)).cast("long"))
    both = found.unionByName(pool.select(F.lit(1).alias("_o"), "_k", "node_id", F.lit("unfilled_slot").alias("requested_node_id")))
    out = both.withColumn("slot", F.row_number().over(Window.orderBy("_o", "_k"))).where(F.col("slot") <= n)
    names = F.array(*[F.lit(x) for x in asked]).cast("array<string>")
    replaced = F.when(F.col("_o") == 1, F.coalesce(F.get(names, F.col("slot") - 1), F.lit("unfilled_slot")))
    return out.select("slot", "node_id", replaced.alias("requested_node_id"))
