"""Relations between masses, radii, orbits and stars as guarded column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrerium.functions.numeric import clip, col, to_numeric

#: Earth's density in g/cm3; days in a year; the Sun's radius in AU and in Earth radii; Earth's radius in AU; the Sun's mass in Earth masses.
EARTH_DENSITY = 5.514
YEAR = 365.25
SUN_RADIUS_AU = 0.00465047
SUN_RADIUS_EARTHS = 109.076
EARTH_RADIUS_AU = 4.2635e-5
SUN_MASS_EARTHS = 332946.0


def _all_positive(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & (c > 0)
    return out


def density(mass: Column | str, radius: Column | str) -> Column:
    """Bulk density from Earth masses and radii."""
    m, r = to_numeric(mass), to_numeric(radius)
    return F.when(_all_positive(m, r), EARTH_DENSITY * m / (r * r * r))


def semi_major_axis(period: Column | str, star_mass: Column | str) -> Column:
    """Kepler's third law, days and solar masses to AU."""
    p, m = to_numeric(period), to_numeric(star_mass)
    return F.when(_all_positive(p, m), F.pow(m * (p / YEAR) * (p / YEAR), F.lit(1.0 / 3.0)))


def insolation(luminosity: Column | str, axis: Column | str) -> Column:
    lum, a = to_numeric(luminosity), to_numeric(axis)
    return F.when(_all_positive(lum, a), lum / (a * a))


def equilibrium_temperature(star_temperature: Column | str, star_radius: Column | str, axis: Column | str, albedo: float = 0.3) -> Column:
    t, r, a = to_numeric(star_temperature), to_numeric(star_radius), to_numeric(axis)
    return F.when(_all_positive(t, r, a), t * F.sqrt(r * SUN_RADIUS_AU / (2.0 * a)) * (1.0 - albedo) ** 0.25)


def transit_probability(star_radius: Column | str, axis: Column | str, planet_radius: Column | str | None = None) -> Column:
    """(star + planet radius) / axis in [0, 1]; a missing planet radius counts as none."""
    r, a = to_numeric(star_radius), to_numeric(axis)
    p = F.lit(0.0) if planet_radius is None else F.coalesce(to_numeric(planet_radius), F.lit(0.0)) * EARTH_RADIUS_AU
    return F.when(_all_positive(r, a), clip((r * SUN_RADIUS_AU + p) / a, 0.0, 1.0))


def transit_probability_proxy(star_radius: Column | str, axis: Column | str) -> Column:
    r, a = to_numeric(star_radius), to_numeric(axis)
    return F.when(_all_positive(r, a), r * SUN_RADIUS_AU / a)


def transit_depth_proxy(star_radius: Column | str, planet_radius: Column | str) -> Column:
    r, p = to_numeric(star_radius), to_numeric(planet_radius)
    return F.when(_all_positive(r, p), F.pow(p / (r * SUN_RADIUS_EARTHS), F.lit(2.0)))


def rv_proxy(mass: Column | str, star_mass: Column | str, period: Column | str) -> Column:
    """Radial-velocity amplitude up to a constant."""
    m, s, p = to_numeric(mass), to_numeric(star_mass), to_numeric(period)
    return F.when(_all_positive(m, s, p), m / (F.pow(s, F.lit(2.0 / 3.0)) * F.pow(p, F.lit(1.0 / 3.0))))


def log_rv_proxy(log_mass: Column | str, log_period: Column | str, log_star_mass: Column | str | None = None) -> Column:
    out = col(log_mass) - col(log_period) / 3.0
    return out if log_star_mass is None else out - col(log_star_mass) * (2.0 / 3.0)


def hill_separation(a1: Column, a2: Column, m1: Column, m2: Column, star_mass: Column) -> Column:
    """Distance of two orbits in mutual Hill radii."""
    radius = F.pow((m1 + m2) / (3.0 * star_mass * SUN_MASS_EARTHS), F.lit(1.0 / 3.0)) * (a1 + a2) / 2.0
    return F.when(_all_positive(a1, a2, m1, m2, star_mass), F.try_divide(F.abs(a2 - a1), radius))
