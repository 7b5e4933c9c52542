"""Features of candidates that follow from others: orbit, star, neighbours, gap, and place in a graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrerium.functions import physics
from orrerium.functions.numeric import ratio, safe_log10, to_numeric

#: Names under which a measurement may come, in order, and those of features that are only carried along.
PERIOD = ("candidate_pl_orbper", "pl_orbper", "period_days", "candidate_period_days")
AXIS = ("candidate_pl_orbsmax", "pl_orbsmax", "a_au", "candidate_semimajor_au")
MASS = ("predicted_mass_or_neighbor_mass", "neighbor_mass", "inner_neighbor_mass", "outer_neighbor_mass")
INNER = ("inner_neighbor_period", "inner_period", "p_inner")
OUTER = ("outer_neighbor_period", "outer_period", "p_outer")
SCORES = {"TOI": ("TOI", "toi", "gap_toi_score"), "ATI_region_context": ("ATI_region_context", "ati", "ATI", "gap_ati_score"), "shadow_score": ("shadow_score", "gap_shadow_score")}
NEIGHBOUR = ("candidate_position_index", "inner_neighbor_radius", "outer_neighbor_radius", "inner_neighbor_mass", "outer_neighbor_mass")
PLACE = ("node_degree", "node_size", "component_size", "distance_to_node_medoid", "local_method_entropy", "local_method_purity")


def derived_features(df: DataFrame, predicted_mass: str | None = None, host: str = "hostname") -> DataFrame:
    """df with every derived feature that it lacks; columns that are there stay as they are, and so does the number of rows.

    What a feature needs and the table doesn't have, or has as null, text without a number or a number out of its domain, makes it
    null. The members of a host are counted by one aggregation that is joined; rows without a host have no count. Names
    are told apart by letter case.
    """
    have = list(df.columns)

    def named(names: Sequence[str]) -> Column:
        """The first of the names that is a column, as a number."""
        found = next((n for n in names if n in have), None)
        return F.lit(None).cast("double") if found is None else to_numeric(F.col(f"`{found}`"))

    new: dict[str, Column] = {}

    def put(name: str, value: Column, *also: str) -> Column:
        for n in (name, *also):
            if n not in have and n not in new:
                new[n] = value
        return to_numeric(F.col(f"`{name}`")) if name in have else new[name]

    period, axis = put("candidate_pl_orbper", named(PERIOD)), put("candidate_pl_orbsmax", named(AXIS))
    radius, mass, light, heat = (named((c,)) for c in ("st_rad", "st_mass", "st_lum", "st_teff"))
    put("transit_probability_proxy", physics.transit_probability_proxy(radius, axis), "proxy_transit_probability_proxy")
    put("rv_amplitude_proxy", physics.rv_proxy(named((predicted_mass,) if predicted_mass in have else MASS), mass, period), "proxy_rv_amplitude_proxy")
    put("candidate_insol", physics.insolation(light, axis), "proxy_candidate_insol")
    put("candidate_eqt", physics.equilibrium_temperature(heat, radius, axis, albedo=0.0), "proxy_candidate_eqt")
    inner, outer = named(INNER), named(OUTER)
    put("inner_neighbor_period", inner)
    put("outer_neighbor_period", outer)
    put("period_ratio_inner", F.when((period > 0) & (inner > 0), ratio(period, inner)))
    put("period_ratio_outer", F.when((period > 0) & (outer > 0), ratio(outer, period)))
    width = safe_log10(outer) - safe_log10(inner)
    put("log_gap_width", width)
    put("normalized_gap_position", F.try_divide(safe_log10(period) - safe_log10(inner), width))
    for name, names in SCORES.items():
        found = any(n in have for n in names)
        value = named(names)
        put(name, value, *([f"topo_{name.lower()}"] if found else []))
    for name in NEIGHBOUR:
        put(name, F.lit(None).cast("double"))
    for name in PLACE:
        value = put(name, F.lit(None).cast("double"))
        put(f"topo_{name}", value)
    out = df.withColumns(new)
    if "n_known_planets" in have:
        return out
    if host not in have:
        return out.withColumn("n_known_planets", F.lit(None).cast("long"))
    counts = df.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n_known_planets"))
    return out.join(counts, host, "left").select(*out.columns, "n_known_planets")
