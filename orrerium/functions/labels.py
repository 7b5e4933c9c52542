"""Class labels of planets, methods and provenance as CASE chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrerium.functions.numeric import col, to_numeric, truthy


def _steps(x: Column, bounds: Sequence[tuple[float, str]], last: str, missing: str, closed: bool = False) -> Column:
    """The label of the first bound above x (or at it, if closed)."""
    out = F.when(x.isNull(), missing)
    for b, name in bounds:
        out = out.when(x <= b if closed else x < b, name)
    return out.otherwise(last)


def radius_class(x: Column | str) -> Column:
    return _steps(to_numeric(x), [(1.6, "rocky_size"), (4.0, "sub_neptune_size"), (8.0, "neptune_or_sub_jovian_size")], "jovian_size", "unknown")


def density_class(x: Column | str) -> Column:
    return _steps(to_numeric(x), [(2.0, "low_density"), (5.0, "intermediate_density")], "high_density", "unknown")


def orbit_class(x: Column | str) -> Column:
    return _steps(to_numeric(x), [(10.0, "short_period"), (100.0, "intermediate_period")], "long_period", "unknown")


def thermal_class(x: Column | str) -> Column:
    return _steps(to_numeric(x), [(300.0, "cool"), (800.0, "warm"), (1500.0, "hot")], "very_hot", "unknown")


def _positive(x: Column | str, bounds: Sequence[tuple[float, str]], last: str, closed: bool = False) -> Column:
    v = to_numeric(x)
    return F.when(v > 0, _steps(v, bounds, last, "unknown", closed)).otherwise("unknown")


def size_class(x: Column | str) -> Column:
    """Right-closed radius classes of characterisation."""
    return _positive(x, [(1.6, "rocky_size"), (2.5, "super_earth_size"), (4.0, "sub_neptune_size"), (8.0, "neptune_sub_jovian_size")], "jovian_size", closed=True)


def mass_class(x: Column | str) -> Column:
    return _positive(x, [(2.0, "low_mass_terrestrial"), (10.0, "super_earth_mass"), (30.0, "sub_neptune_mass"), (150.0, "neptune_saturn_mass")], "jovian_mass", closed=True)


def temperature_class(x: Column | str) -> Column:
    return _positive(x, [(200.0, "cold"), (350.0, "temperate"), (700.0, "warm"), (1200.0, "hot")], "ultra_hot")


def period_class(x: Column | str) -> Column:
    return _positive(x, [(10.0, "short_period"), (100.0, "intermediate_period"), (1000.0, "long_period")], "very_long_period")


def candidate_population(radius: Column | str, mass: Column | str, dens: Column | str, period: Column | str) -> Column:
    """The first population whose limits hold; an unknown value holds no limit."""
    r, m, d, p = (to_numeric(x) for x in (radius, mass, dens, period))
    rules = [
        ((r >= 8.0) & (p < 10.0), "hot_jupiter_candidate"),
        ((r >= 8.0) & (p >= 10.0), "warm_or_cool_giant_candidate"),
        ((r >= 1.0) & (r < 1.6) & (m < 10.0), "super_earth_candidate"),
        ((r >= 1.6) & (r < 4.0), "sub_neptune_candidate"),
        ((r < 1.6) & (d >= 3.5), "rocky_candidate"),
        ((r >= 4.0) & (p >= 100.0), "long_period_giant_candidate"),
    ]
    return F.coalesce(*[F.when(rule, name) for rule, name in rules], F.lit("unknown_mixed"))


def star_bin(mass: Column | str) -> Column:
    m = to_numeric(mass)
    return F.when(m > 0, F.when(m < 0.8, "low_mass_star").when(m <= 1.2, "solar_like_star").otherwise("high_mass_star")).otherwise("unknown_mass_star")


def canonical_method(x: Column | str) -> Column:
    """One spelling for transits and radial velocities; others as they are, blank is Unknown."""
    v = F.trim(F.coalesce(col(x).cast("string"), F.lit("")))
    return F.when(F.lower(v).contains("transit"), "Transit").when(F.lower(v).contains("radial velocity"), "Radial Velocity").when(v == "", "Unknown").otherwise(v)


def method_family(x: Column | str) -> Column:
    """The same with transit timing variations kept apart from transits."""
    v = F.lower(F.trim(F.coalesce(col(x).cast("string"), F.lit(""))))
    return F.when(v.contains("timing"), "Timing Variations").otherwise(canonical_method(x))


def expected_direction(method: Column | str) -> Column:
    """Where a method's misses lie."""
    v = canonical_method(method)
    return F.when(v == "Transit", "smaller radius or longer period").when(v == "Radial Velocity", "lower mass or longer period").when(v == "Imaging", "closer or fainter companions").when(v == "Microlensing", "unrepeatable geometry").otherwise("compatible neighbours under a local reference")


def source_category(x: Column | str) -> Column:
    v = F.lower(F.coalesce(col(x).cast("string"), F.lit("missing")))
    return F.when(v.startswith("observed"), "observed").when(v.startswith("derived"), "physically_derived").when(v.startswith("imputed"), "imputed").when(v.startswith("excluded"), "excluded").otherwise("missing")


def value_status(name: str, have: set[str]) -> Column:
    """imputed, derived or observed by the flags of a feature; imputed wins, no flag is observed."""
    def said(suffix: str) -> Column:
        return truthy(f"{name}_{suffix}") if f"{name}_{suffix}" in have else F.lit(False)

    return F.when(said("was_imputed"), "imputed").when(said("was_physically_derived"), "derived").when(col(name).isNull() if name in have else F.lit(False), "missing").otherwise("observed")


def quality_of(name: str, have: set[str]) -> Column:
    """Weight of a value by how it came about."""
    def said(suffix: str) -> Column:
        return truthy(f"{name}_{suffix}") if f"{name}_{suffix}" in have else F.lit(False)

    return F.when(said("was_observed"), 1.0).when(said("was_physically_derived"), 0.8).when(said("was_imputed"), 0.35).when(to_numeric(name).isNotNull() if name in have else F.lit(False), 0.7).otherwise(0.0)


def deficit_class(x: Column) -> Column:
    return _steps(x, [(0.10, "no_deficit"), (0.30, "weak_deficit"), (0.60, "moderate_deficit")], "strong_deficit", "not_available", closed=True)


def deficit_state(relative: Column, expected: Column) -> Column:
    """Deficit class, with undefined references and overpopulated balls apart."""
    undefined = relative.isNull() | expected.isNull() | (expected <= 0)
    return F.when(undefined, "undefined_reference").when(relative < 0, "overpopulated_reference").otherwise(deficit_class(relative))


def stability_of(values: Column) -> Column:
    """Whether the radii of an anchor agree that something is missing; fewer than two known are undefined."""
    known = F.filter(values, lambda v: v.isNotNull())
    plus = F.size(F.filter(known, lambda v: v > 0))
    return F.when(F.size(known) < 2, "undefined").when(plus == F.size(known), "consistent_positive_deficit").when(plus > 0, "radius_sensitive_deficit").otherwise("no_consistent_deficit")


def suspicious(relative: Column, missing: Column, expected: Column) -> Column:
    """A relative deficit above 1 that its own counts don't explain."""
    return F.coalesce((expected > 0) & (relative > 1) & (missing <= expected + 1e-9), F.lit(False))


def confidence(shadow: Column, imputed: Column, deficit: Column) -> Column:
    """How much a case can bear: by shadow score (unknown: 0), imputed share of its coordinates (unknown: 1) and deficit (unknown: 0)."""
    s, i, d = F.coalesce(shadow, F.lit(0.0)), F.coalesce(imputed, F.lit(1.0)), F.coalesce(deficit, F.lit(0.0))
    return F.when((s >= 0.22) & (i <= 0.10) & (d >= 0.30), "higher").when((s >= 0.15) & (i <= 0.20), "medium").otherwise("lower")


def most_probable(columns: dict[str, Column]) -> Column:
    """The label of the greatest probability, ties in label order; null if all are null."""
    best = F.array_max(F.filter(F.array(*[F.struct(p.cast("double").alias("p"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, (n, p) in enumerate(sorted(columns.items()))]), lambda s: s["p"].isNotNull()))
    return best["n"]


def p_value_score(p: Column) -> Column:
    return F.when(p <= 0.01, 1.0).when(p <= 0.05, 0.85).when(p <= 0.10, 0.65).otherwise(0.0)
