"""Column functions with the engine's null rules: missing is NULL, never NaN; nothing raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_numeric(x: Column | str) -> Column:
    """A double; what doesn't parse, NaN and infinities are null."""
    v = col(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def safe_log10(x: Column | str, least: float = 0.0) -> Column:
    """log10 of values above `least`, else null."""
    v = to_numeric(x)
    return F.when(v > least, F.log10(v))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null for a zero divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x held in [low, high]; null stays null (least and greatest alone would skip it)."""
    v = x
    if low is not None:
        v = F.greatest(v, F.lit(float(low)))
    if high is not None:
        v = F.least(v, F.lit(float(high)))
    return F.when(x.isNotNull(), v)


def clip01(x: Column) -> Column:
    """x held in [0, 1], null as 0."""
    return F.coalesce(clip(x, 0.0, 1.0), F.lit(0.0))


def truthy(x: Column | str) -> Column:
    """A boolean from booleans, numbers and their spellings; null is false."""
    return F.coalesce(F.lower(F.trim(col(x).cast("string"))).isin("true", "1", "1.0", "yes"), F.lit(False))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def mean_of(parts: Sequence[Column]) -> Column:
    """The mean of the parts that aren't null; null if all are."""
    kept = F.array_compact(F.array(*parts))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def max_of(parts: Sequence[Column]) -> Column:
    """The greatest of the parts that aren't null."""
    return F.array_max(F.array(*[p.cast("double") for p in parts]))


def distance(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    """Euclidean distance; null if any coordinate is."""
    return F.sqrt(sum(((col(x) - col(y)) * (col(x) - col(y)) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def min_max(x: Column, *by: str) -> Column:
    """x in [0, 1] over the window; a constant is 1, null is 0."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(x.isNull(), 0.0).when(hi == lo, 1.0).otherwise(F.try_divide(x - lo, hi - lo))


def z_score(x: Column, *by: str) -> Column:
    """Deviation from the window's mean in population standard deviations; a constant is 0."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd > 0, F.try_divide(x - F.avg(x).over(w), sd)).when(x.isNotNull(), 0.0)


def average_rank(order: Column, *by: str) -> Column:
    """Rank from 1 with ties at their mean."""
    w = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, order))
    return F.rank().over(w.orderBy(order)) + (ties - 1) / 2.0
