"""What a graph's indices say of members and of the gaps between them, and what is joined to candidates from elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrerium.functions import labels
from orrerium.functions.numeric import clip, safe_log10, to_numeric


def scaled(df: DataFrame, column: str, out: str) -> DataFrame:
    """A score over its range in [0, 1]: unknown ones are 0, and where all known ones are equal these are 1."""
    x = to_numeric(column)
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    rows = df.crossJoin(F.broadcast(ends))  # one row
    flat = F.abs(F.col("_hi") - F.col("_lo")) <= 1e-9 * F.greatest(F.abs("_hi"), F.abs("_lo"))
    value = F.when(x.isNull(), 0.0).when(flat, 1.0).otherwise(clip((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), 0, 1))
    return rows.withColumn(out, F.coalesce(value, F.lit(0.0))).drop("_lo", "_hi")


def node_scores(toi: DataFrame, shadow: DataFrame | None = None) -> DataFrame:
    """node_id with planet_TOI_score, planet_shadow_score and both scaled; nodes of either table. Without a shadow table the
    TOI table's own shadow_score is taken."""
    left = scaled(toi.select("node_id", to_numeric("TOI").alias("planet_TOI_score")), "planet_TOI_score", "planet_TOI_norm")
    source = shadow if shadow is not None else (toi if "shadow_score" in toi.columns else None)
    if source is None:
        none = F.lit(None).cast("double")
        return left.withColumns({"planet_shadow_score": none, "planet_shadow_norm": none})
    right = scaled(source.select("node_id", to_numeric("shadow_score").alias("planet_shadow_score")), "planet_shadow_score", "planet_shadow_norm")
    return left.join(right, "node_id", "full_outer")


def member_prior(scores: DataFrame, membership: DataFrame, ati: DataFrame | None = None) -> DataFrame:
    """One row a member (pl_name): the greatest scores of its nodes and of its own anchors, and topology_prior_planet, the greatest
    of the scaled ones (0 where unknown). Members without a name are left aside."""
    of_nodes = membership.where("pl_name is not null").join(scores, "node_id", "left").groupBy("pl_name").agg(
        *[F.max(c).alias(c) for c in ("planet_TOI_score", "planet_shadow_score", "planet_TOI_norm", "planet_shadow_norm")], F.count_distinct("node_id").alias("topology_node_count")
    )
    none = F.lit(None).cast("double")
    if ati is None:
        out = of_nodes.withColumns({"planet_ATI_score": none, "planet_ATI_norm": none})
    else:
        own = scaled(ati.select("pl_name", to_numeric("ATI").alias("planet_ATI_score")), "planet_ATI_score", "planet_ATI_norm")
        own = own.where("pl_name is not null").groupBy("pl_name").agg(F.max("planet_ATI_score").alias("planet_ATI_score"), F.max("planet_ATI_norm").alias("planet_ATI_norm"))
        out = of_nodes.join(own, "pl_name", "full_outer")
    return out.withColumn("topology_prior_planet", F.coalesce(F.greatest("planet_TOI_norm", "planet_shadow_norm", "planet_ATI_norm"), F.lit(0.0)))


def attach_topology(candidates: DataFrame, prior: DataFrame) -> DataFrame:
    """Candidates with the priors of the members on both sides of their gap, and topology_score in [0, 1], the greatest of all of them."""
    scores = ("planet_TOI_score", "planet_shadow_score", "planet_ATI_score", "planet_TOI_norm", "planet_shadow_norm", "planet_ATI_norm", "topology_prior_planet")
    out = candidates
    for side in ("inner", "outer"):
        out = out.join(prior.select(F.col("pl_name").alias(f"{side}_planet"), *[F.col(c).alias(f"{side}_{c}") for c in scores]), f"{side}_planet", "left")

    def both(c: str) -> Column:
        return F.greatest(f"inner_{c}", f"outer_{c}")

    zero = F.lit(0.0)
    out = out.withColumns({f"topology_prior_{s}": F.coalesce(f"{s}_topology_prior_planet", zero) for s in ("inner", "outer")})
    out = out.withColumns({"topology_prior_gap": F.greatest("topology_prior_inner", "topology_prior_outer"), "gap_shadow_score": both("planet_shadow_score"), "gap_TOI_score": both("planet_TOI_score"), "gap_ATI_score": both("planet_ATI_score")})
    norms = [both(c) for c in ("planet_TOI_norm", "planet_shadow_norm", "planet_ATI_norm")]
    return out.withColumn("topology_score", clip(F.coalesce(F.greatest(*norms, F.col("topology_prior_gap")), zero), 0, 1))


def priority_class(score: Column, gap_ratio: Column, gap_score: Column, topology: Column, detectability: Column, why: Column, wide: float = 4.0) -> Column:
    """high needs a score of 0.7 and evidence of all three kinds; medium a score of 0.4. Unknown numbers are 0."""
    s, r, g, t, d = (F.coalesce(x.cast("double"), F.lit(0.0)) for x in (score, gap_ratio, gap_score, topology, detectability))
    geometric, observed = (r >= wide) | (g >= 0.75), (d >= 0.35) & (F.coalesce(why, F.lit("unknown")) != "unknown")
    return F.when((s >= 0.70) & geometric & (t >= 0.35) & observed, "high").when(s >= 0.40, "medium").otherwise("low")


def filled_from(df: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with its missing cells of the columns (or the whole column) taken from the one row of the other table of its key."""
    held = [c for c in columns if c in other.columns]
    out = df.join(other.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in held]), list(keys), "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_o_{c}")) if c in df.columns else F.col(f"_o_{c}") for c in held})
    return out.drop(*[f"_o_{c}" for c in held])


def attach_indices(candidates: DataFrame, regions: DataFrame | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """Candidates (node_id) with the indices of their region, and of their region's anchors: the greatest numbers, the first name.
    What a candidate has itself stays. Of repeated regions the least row counts."""
    out = candidates
    if regions is not None:
        kept = [c for c in ("toi", "shadow_score", "i_r3", "c_phys", "s_net", "toi_conservative") if c in regions.columns]
        one = regions.groupBy("node_id").agg(F.min(F.struct(*kept)).alias("r")).select("node_id", *[f"r.{c}" for c in kept])
        out = filled_from(out, one, ["node_id"], kept)
    if anchors is not None:
        numbers = [c for c in ("ati", "toi", "delta_rel_neighbors_best", "delta_rel_analog_best") if c in anchors.columns]
        aggs = [F.max(c).alias(c) for c in numbers] + ([F.min("anchor_pl_name").alias("anchor_pl_name")] if "anchor_pl_name" in anchors.columns else [])
        grouped = anchors.groupBy("node_id").agg(*aggs)
        out = filled_from(out, grouped, ["node_id"], [c for c in grouped.columns if c != "node_id"])
    return out


#: What a candidate takes over from its host's known members.
HOST_COLUMNS = ("st_mass", "st_rad", "st_teff", "st_lum", "st_met", "st_logg", "sy_dist", "sy_pnum")


def enrich_from_hosts(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidates with missing properties of the host as medians over its known members."""
    kept = [c for c in HOST_COLUMNS if c in catalog.columns]
    hosts = catalog.where("hostname is not null").groupBy("hostname").agg(*[F.median(to_numeric(c)).alias(c) for c in kept])
    return filled_from(candidates, hosts, ["hostname"], kept)


#: Columns that every model table has, as logarithms, as they are, and of gaps and graphs.
LOGS = ("pl_orbper", "pl_orbsmax", "pl_insol")
TARGET_LOGS = ("pl_rade", "pl_bmasse", "pl_dens")
PLAIN = ("pl_eqt", "st_mass", "st_rad", "st_teff", "st_lum", "st_met", "st_logg", "sy_dist", "sy_pnum")
CONTEXT = ("log_gap_ratio_inner", "log_gap_ratio_outer", "log_gap_width", "candidate_score", "topology_score", "gap_score", "toi", "ati", "shadow_score", "i_r3", "c_phys", "s_net")


def engineered(df: DataFrame) -> DataFrame:
    """Every model column, null where its source is missing, and the classes that are not there yet."""
    have = set(df.columns)
    none = F.lit(None).cast("double")
    new = {f"log_{c}": safe_log10(c) if c in have else none for c in LOGS} | {f"log_{c}": safe_log10(c) for c in TARGET_LOGS if c in have}
    new |= {c: to_numeric(c) if c in have else none for c in (*PLAIN, *CONTEXT)}
    for name, source, rule in (("radius_class", "pl_rade", labels.size_class), ("orbit_class", "pl_orbper", labels.period_class), ("thermal_class", "pl_eqt", labels.temperature_class)):
        if name not in have and source in have:
            new[name] = rule(source)
    return df.withColumns(new)


def unlogged(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """10 ** x of each column, as `<target>_<column>`."""
    return df.withColumns({f"{target}_{c}": F.pow(F.lit(10.0), to_numeric(c)) for c in columns})


def first_known(df: DataFrame, names: Sequence[str], default: Column | None = None) -> Column:
    """The first of the columns that is there (whatever its letter case) and not null in the row."""
    have = {c.lower(): c for c in df.columns}
    cols = [F.col(have[n.lower()]) for n in names if n.lower() in have]
    return F.coalesce(*cols, default if default is not None else F.lit(None))


def interpolated(inner: Column, outer: Column, fraction: Column) -> Column:
    """log10 between the logarithms of two positive values."""
    a, b = safe_log10(inner), safe_log10(outer)
    return a + fraction * (b - a)


def analog_support(count: Column, mass: Column, radius: Column, k: int) -> Column:
    """0.6 for a full set of analogs, 0.2 each for a mass and a radius that are known."""
    share = clip(F.coalesce(count.cast("double"), F.lit(0.0)) / max(float(k), 1.0), 0, 1)
    return 0.6 * share + F.when(mass.isNotNull(), 0.2).otherwise(0.0) + F.when(radius.isNotNull(), 0.2).otherwise(0.0)


def error_by_system(validation: DataFrame) -> DataFrame:
    return validation.where("hostname is not null").groupBy("hostname").agg(F.median("abs_logP_error").alias("validation_error_if_available"))
