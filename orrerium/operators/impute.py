"""Derivation and imputation of incomplete measurements with the provenance of every cell.

For a feature f the provenance columns are f_source (observed, derived_*, imputed_<method>, excluded, missing),
f_was_missing, f_was_observed, f_was_physically_derived and f_was_imputed.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from orrerium.functions import physics
from orrerium.functions.numeric import average_rank, clip, safe_log10, to_numeric
from orrerium.functions.stats import exact_quantiles
from orrerium.operators.knn import nearest_in_boxes
from orrerium.sources.tables import written

#: Features whose logarithm is modelled; bounds that imputed values keep; parts of names that are no measurements.
LOG_FEATURES = ("pl_rade", "pl_bmasse", "pl_dens", "pl_orbper", "pl_orbsmax", "pl_insol", "sy_dist", "st_mass", "st_rad", "st_lum")
BOUNDS: dict[str, tuple[float | None, float | None]] = {"pl_orbeccen": (0.0, 1.0), "sy_pnum": (1.0, None), "sy_snum": (1.0, None)} | {c: (0.0, None) for c in ("pl_rade", "pl_bmasse", "pl_dens", "pl_orbper", "pl_orbsmax", "pl_insol", "pl_eqt", "sy_dist", "st_mass", "st_rad", "st_teff")}
#: The features of Mapper's tables, and the columns that go along with them.
PHYSICAL = ("pl_rade", "pl_bmasse", "pl_dens")
ORBITAL = ("pl_orbper", "pl_orbsmax", "pl_insol", "pl_eqt")
ECCENTRICITY = ("pl_orbeccen",)
STELLAR = ("st_teff", "st_met", "st_mass", "st_rad", "st_lum", "sy_pnum", "sy_snum")
CONTEXT = ("pl_name", "hostname", "discoverymethod", "disc_year", "disc_facility", "sy_dist", "tran_flag", "rv_flag", "ima_flag", "micro_flag")
NO_MEASUREMENT = ("err1", "err2", "lim", "reflink", "refname", "systemref")
FLOOR = 1e-12


def is_measurement(column: str) -> bool:
    return not any(part in column.lower() for part in NO_MEASUREMENT)


def with_provenance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Numeric features, each observed or missing; a source column that is there already is kept."""
    have = set(df.columns)
    out = df.withColumns({f: to_numeric(f) for f in features})
    out = out.withColumns({f"{f}_source": F.coalesce(F.col(f"{f}_source"), F.when(F.col(f).isNotNull(), "observed").otherwise("missing")) if f"{f}_source" in have else F.when(F.col(f).isNotNull(), "observed").otherwise("missing") for f in features})
    return out.withColumns({f"{f}_was_missing": F.col(f).isNull() for f in features})


def with_flags(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The three flags of each feature, by its source."""
    return df.withColumns({f"{f}_{flag}": F.coalesce(F.col(f"{f}_source").startswith(start), F.lit(False)) for f in features for flag, start in (("was_observed", "observed"), ("was_physically_derived", "derived"), ("was_imputed", "imputed"))})


def _derive(df: DataFrame, name: str, value: Column, source: str) -> DataFrame:
    have = set(df.columns)
    own = to_numeric(name) if name in have else F.lit(None).cast("double")
    fresh = own.isNull() & value.isNotNull()
    kept = F.col(f"{name}_source") if f"{name}_source" in have else F.lit(None).cast("string")
    return df.withColumns({f"{name}_source": F.when(fresh, source).otherwise(F.coalesce(kept, F.when(own.isNotNull(), "observed"))), name: F.coalesce(own, value)})


def derive_density(df: DataFrame) -> DataFrame:
    """A missing pl_dens from mass and radius."""
    return _derive(df, "pl_dens", physics.density("pl_bmasse", "pl_rade"), "derived_density")


def derive_axis(df: DataFrame) -> DataFrame:
    """A missing pl_orbsmax from period and star."""
    return _derive(df, "pl_orbsmax", physics.semi_major_axis("pl_orbper", "st_mass"), "derived_kepler")


def derive(df: DataFrame) -> DataFrame:
    return derive_axis(derive_density(df))


def derivation_audit(df: DataFrame, names: Sequence[str] = ("pl_dens", "pl_orbsmax")) -> DataFrame:
    """Cells by source for each derived feature."""
    return df.unpivot([], [f"{n}_source" for n in names], "feature", "source").groupBy(F.regexp_replace("feature", "_source$", "").alias("feature"), F.coalesce("source", F.lit("missing")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def log_transform(df: DataFrame, features: Sequence[str] = LOG_FEATURES) -> DataFrame:
    """The features' logarithms; what isn't positive becomes null."""
    return df.withColumns({f: safe_log10(f) for f in features if f in df.columns})


def log_audit(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """By feature: missing and non-positive cells before, missing after; one pass."""
    cols = []
    for f in features:
        x = to_numeric(f)
        cols.append(F.struct(F.lit(f).alias("feature"), F.count_if(x.isNull()).alias("n_missing_before"), F.count_if(x <= 0).alias("n_nonpositive"), F.count_if(safe_log10(f).isNull()).alias("n_missing_after")))
    return df.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def robust_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: centre (median) and spread (interquartile range, 1 if 0 or unknown) of each feature."""
    out = []
    for f in features:
        q = F.percentile(to_numeric(f), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        iqr = q[2] - q[0]
        out += [q[1].alias(f"{f}_center"), F.when(iqr > 0, iqr).otherwise(1.0).alias(f"{f}_scale")]
    return df.agg(*out)


def robust_row(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """robust_stats, worked out once and by no task that holds a feature's values."""
    cells = []
    for f, (lo, middle, hi) in exact_quantiles(df.select(*[to_numeric(f).alias(f) for f in features]), {f: [0.25, 0.5, 0.75] for f in features}).items():
        cells += [(f"{f}_center", middle), (f"{f}_scale", hi - lo if middle is not None and hi > lo else 1.0)]
    return df.sparkSession.createDataFrame([tuple(v for _, v in cells)], ", ".join(f"`{c}` double" for c, _ in cells))


def robust_scale(df: DataFrame, features: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """(x - median) / IQR of each feature; null stays null. The statistics are one row."""
    stats = stats if stats is not None else robust_stats(df, features)
    out = df.join(F.broadcast(stats), how="cross")
    return out.withColumns({f: (to_numeric(f) - F.col(f"{f}_center")) / F.col(f"{f}_scale") for f in features}).drop(*stats.columns)


def invert_robust_scale(df: DataFrame, features: Sequence[str], stats: DataFrame) -> DataFrame:
    out = df.join(F.broadcast(stats), how="cross")
    return out.withColumns({f: F.col(f) * F.col(f"{f}_scale") + F.col(f"{f}_center") for f in features}).drop(*stats.columns)


def bounded(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]] = BOUNDS) -> DataFrame:
    return df.withColumns({f: clip(F.col(f), lo, hi) for f, (lo, hi) in bounds.items() if f in df.columns})


def bound_counts(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]] = BOUNDS) -> DataFrame:
    """feature, low, high, n_below, n_above: the cells that bounded() moves. One pass."""
    used = {f: b for f, b in bounds.items() if f in df.columns}
    zero = F.lit(0).cast("long")
    cols = [F.struct(F.lit(f).alias("feature"), F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high"), (F.count_if(to_numeric(f) < lo) if lo is not None else zero).alias("n_below"), (F.count_if(to_numeric(f) > hi) if hi is not None else zero).alias("n_above")) for f, (lo, hi) in used.items()]
    return df.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def median_fill(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing cells as the feature's median; a feature without any value stays null."""
    stats = df.agg(*[F.median(to_numeric(f)).alias(f"_{f}") for f in features])
    return df.join(F.broadcast(stats), how="cross").withColumns({f: F.coalesce(to_numeric(f), F.col(f"_{f}")) for f in features}).drop(*stats.columns)


#: What finding a row's donors in boxes costs, in distances of a scan.
SEARCH = 500


def knn_fill(df: DataFrame, features: Sequence[str], k: int = 7, block: int = 200_000, id_column: str = "row_index") -> DataFrame:
    """Missing cells as the inverse-distance mean of the k nearest rows that have the value, equal distances by value.

    Distances are over shared coordinates, scaled up for missing ones. Every row is a donor. Which coordinates are shared follows from
    the sets of holes of both rows: for each that occurs, nearest donors are found in boxes (knn.nearest_in_boxes). Few rows, and rows of
    very many sets of holes, meet all donors instead, a broadcast block of them at a time, and each cell keeps the nearest k so far.
    """
    features = list(features)
    rows = df.withColumns({f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features})
    kinds = {r[0]: r[1] for r in rows.groupBy(_pattern(features).alias("_p")).count().limit(PATTERNS + 1).collect()} if len(features) < 63 else {}
    if kinds and len(kinds) <= PATTERNS:
        every = (1 << len(features)) - 1
        holes, donors = (sum(n for p, n in kinds.items() if p != e) for e in (0, every))
        holes -= kinds.get(every, 0)
        most = holes * donors // SEARCH if SEARCH else None
        units = _shared(kinds, len(features), most)
        if units is not None:
            return _fill_by_boxes(rows, features, k, units).select(*df.columns)
    return _fill_by_scan(rows, features, k, block, id_column)


def _shared(kinds: Mapping[int, int], f: int, most: int | None) -> list[tuple[int, int, int, int]] | None:
    """(holes of a row, feature, shared coordinates, holes of its donors) that occur; none if donors would be copied more than `most` times."""
    every, units, copies = (1 << f) - 1, [], 0
    for p in kinds:
        for r in kinds:
            s = every & ~p & ~r
            for j in (j for j in range(f) if s and p >> j & 1 and not r >> j & 1):
                units.append((p, j, s, r))
                copies += kinds[r] + kinds[p]
        if most is not None and copies > most:
            return None
    return units


@F.pandas_udf(LongType())
def _order(v: pd.Series) -> pd.Series:
    """Whole numbers in the order of doubles."""
    bits = (v.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


@F.pandas_udf(DoubleType())
def _unorder(n: pd.Series) -> pd.Series:
    bits = n.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64))


def _fill_by_boxes(rows: DataFrame, features: list[str], k: int, units: list[tuple[int, int, int, int]]) -> DataFrame:
    """Rows with the same known values share their donors, and of donors at one place only the k least values matter."""
    spark, at = rows.sparkSession, [f"_x{i}" for i in range(len(features))]
    place = [F.when(F.col("s").bitwiseAND(F.lit(1 << i)) != 0, F.col(f) + 0.0).otherwise(0.0).alias(x) for i, (f, x) in enumerate(zip(features, at, strict=True))]
    name = {u: f"{u[0]}:{u[1]}:{u[2]}" for u in units}

    def table(of: set) -> DataFrame:
        return F.broadcast(spark.createDataFrame(sorted(of), "_p long, g string, j int, s long"))

    holed = rows.select(*features).withColumn("_p", _pattern(features)).where(F.col("_p") != 0)
    points = written(holed.distinct().withColumn("point", F.monotonically_increasing_id()), "fill-points")
    asked = points.join(table({(u[0], name[u], u[1], u[2]) for u in units}), "_p").select("point", "g", "j", *place)
    places = written(asked.select("g", *at).distinct().withColumn("place", F.monotonically_increasing_id()), "fill-places")
    # Of equal donors k are as good as all.
    donors = rows.groupBy(*features).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_m")).withColumns({"_p": _pattern(features), "_v": F.array(*[_order(f) for f in features])})
    donors = donors.withColumn("_m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
    own = donors.join(table({(u[3], name[u], u[1], u[2]) for u in units}), "_p").select("g", *place, F.get("_v", F.col("j")).alias("v"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("g", *at).orderBy("v"))).where(F.col("n") <= k).drop("n")
    scales = {name[u]: (float(len(features)), float(u[2].bit_count())) for u in units}
    found = nearest_in_boxes(places.withColumnRenamed("place", "id"), own.withColumnRenamed("v", "id"), at, k, scales)
    lists = found.withColumn("v", _unorder("neighbour")).groupBy(F.col("query").alias("place")).agg(F.collect_list(F.struct("distance", "v")).alias("near"))
    known = asked.join(places, ["g", *at]).join(lists, "place")
    cells = [_donated(F.slice(F.array_sort(F.flatten(F.collect_list(F.when(F.col("j") == i, F.col("near"))))), 1, k)).alias(f"_new{i}") for i in range(len(features))]
    new = points.join(known.groupBy("point").agg(*cells), "point").select(*[F.col(f).alias(f"_old{i}") for i, f in enumerate(features)], *[f"_new{i}" for i in range(len(features))])
    same = functools.reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_old{i}")) for i, f in enumerate(features)])
    return rows.join(new, same, "left").withColumns({f: F.coalesce(f, f"_new{i}") for i, f in enumerate(features)})


def _donated(near: Column) -> Column:
    """The mean of the values of (distance, v), weighted by inverse distances; of those at no distance, if there are any."""
    here = F.filter(near, lambda r: r["distance"] <= 0)
    used = F.when(F.size(here) > 0, F.transform(here, lambda r: F.struct(F.lit(1.0).alias("w"), r["v"].alias("v")))).otherwise(F.transform(near, lambda r: F.struct((1.0 / r["distance"]).alias("w"), r["v"].alias("v"))))
    return F.try_divide(F.aggregate(used, F.lit(0.0), lambda a, r: a + r["w"] * r["v"]), F.aggregate(used, F.lit(0.0), lambda a, r: a + r["w"]))


def _fill_by_scan(rows: DataFrame, features: list[str], k: int, block: int, id_column: str) -> DataFrame:
    """Every row with holes against all donors: what a task holds is a block of donors and a batch."""
    have = rows.where(" or ".join(f"`{f}` is not null" for f in features)).select(id_column, *features)
    blocks = max(1, -(-have.count() // block))
    out = rows.withColumn("_near", F.lit(None).cast("binary"))
    schema = out.schema
    place = F.pmod(F.xxhash64(id_column), F.lit(blocks))
    for n in range(blocks):
        donors = have if blocks == 1 else have.where(place == n)
        known = rows.sparkSession.sparkContext.broadcast(donors.select(*features).toPandas().to_numpy(np.float64))  # a block
        out = out.mapInPandas(_nearest_donors(known, features, k, n == blocks - 1), schema)
        if n < blocks - 1:
            out = written(out, "knn-fill")
    return out.drop("_near").withColumns({f: F.when(~F.isnan(f), F.col(f)) for f in features})


def _nearest_donors(known, features: list[str], k: int, last: bool):
    """Over batches: each hole's nearest donors so far (kept in _near), or at the last block its value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = known.value
        there = ~np.isnan(r)
        r0 = np.where(there, r, 0.0)
        f = len(features)
        for b in batches:
            x = b[features].to_numpy(np.float64)
            holes = np.isnan(x)
            near = b["_near"].to_numpy(object)
            todo = np.flatnonzero(holes.any(1) & ~holes.all(1))
            for lo in range(0, len(todo), 256):
                at = todo[lo : lo + 256]
                # Of each row and feature the distances of k donors, and their values.
                held = np.stack([np.frombuffer(s).reshape(2, f, k) if s is not None else np.stack([np.full((f, k), np.inf), np.zeros((f, k))]) for s in near[at]]).copy()
                q = ~holes[at]
                q0 = np.where(q, x[at], 0.0)
                both = q.astype(float) @ there.T
                d2 = (q0**2) @ there.T + q.astype(float) @ (r0**2).T - 2 * q0 @ r0.T
                d = np.where(both > 0, np.sqrt(np.maximum(d2, 0) * f / np.maximum(both, 1)), np.inf)
                for j in range(f):
                    need, donors = np.flatnonzero(~q[:, j]), np.flatnonzero(there[:, j])
                    if not len(need) or not len(donors):
                        continue
                    dj = d[np.ix_(need, donors)]
                    m = min(k + 8, len(donors))
                    best = donors[np.argpartition(dj, m - 1, 1)[:, :m]]
                    # The strip's formula loses digits; the few that are kept are measured again.
                    shared = q[need][:, None] & there[best]
                    n = shared.sum(2)
                    exact = np.where(n > 0, np.sqrt(np.where(shared, (q0[need][:, None] - r0[best]) ** 2, 0).sum(2) * f / np.maximum(n, 1)), np.inf)
                    values = r[best, j]
                    order = np.lexsort((values, exact), axis=1)[:, :k]
                    exact, values = np.take_along_axis(exact, order, 1), np.take_along_axis(values, order, 1)
                    if m < len(donors):  # more ties with the last than were kept, such as copies: all of them are measured
                        norm = (q0[need] ** 2).sum(1) + (r0**2).sum(1).max()
                        reach = np.sqrt(exact[:, -1] ** 2 + 1e-11 * f * norm)
                        for i in np.flatnonzero(np.isfinite(reach) & ((dj <= reach[:, None]).sum(1) > m)).tolist():
                            some = donors[dj[i] <= reach[i]]
                            both_i = q[need[i]] & there[some]
                            far = np.sqrt(np.where(both_i, (q0[need[i]] - r0[some]) ** 2, 0).sum(1) * f / both_i.sum(1))
                            least = np.lexsort((r[some, j], far))[:k]
                            exact[i], values[i] = far[least], r[some[least], j]
                    dn = np.hstack([held[need, 0, j], exact])
                    v = np.hstack([held[need, 1, j], values])
                    order = np.lexsort((v, dn), axis=1)[:, :k]
                    held[need, 0, j], held[need, 1, j] = np.take_along_axis(dn, order, 1), np.take_along_axis(v, order, 1)
                if not last:
                    near[at] = [h.tobytes() for h in held]
                    continue
                dn, v = held[:, 0], held[:, 1]
                exact = dn <= 0
                w = np.where(exact.any(2, keepdims=True), exact, 1.0 / np.where(dn > 0, dn, 1.0))
                w = np.where(np.isfinite(dn), w, 0.0)
                total = w.sum(2)
                x[at] = np.where(q, x[at], np.where(total > 0, (w * v).sum(2) / np.where(total > 0, total, 1), np.nan))
            if last:
                b[features] = x
                near = np.full(len(b), None, object)
            b["_near"] = near
            yield b

    return run


#: Shape and rate of the priors of both precisions, rounds of their updates, and the change of coefficients that ends them.
PRIOR, EVIDENCE_ROUNDS, EVIDENCE_TOLERANCE = 1e-6, 300, 1e-3


class Evidence:
    """Bayesian ridge from sums alone: precisions of noise and weights at the maximum of the evidence, and the weights' posterior.

    gram, xy, yy: centred sums of products of the predictors, with the target, and of the target with itself, over n rows.
    """

    def __init__(self, gram: np.ndarray, xy: np.ndarray, yy: float, n: float):
        values, vectors = np.linalg.eigh(gram)
        # Directions without spread hold rounding alone, which a small noise would blow up: the sums say nothing of them.
        real = values > values.max(initial=0.0) * len(values) * np.finfo(float).eps * 16
        values = np.where(real, values, 0.0)
        along = np.where(real, vectors.T @ xy, 0.0)
        alpha, weight = 1.0 / (yy / n + np.finfo(float).eps), 1.0
        before = None
        for _ in range(EVIDENCE_ROUNDS):
            z = along / (values + weight / alpha)
            rest = max(yy - 2 * z @ along + values @ z**2, 0.0)
            known = (alpha * values / (weight + alpha * values)).sum()
            weight = (known + 2 * PRIOR) / (z @ z + 2 * PRIOR)
            alpha = (n - known + 2 * PRIOR) / (rest + 2 * PRIOR)
            coef = vectors @ z
            if before is not None and np.abs(coef - before).sum() < EVIDENCE_TOLERANCE:
                break
            before = coef
        self.alpha, self.weight = float(alpha), float(weight)
        self.coef = vectors @ (along / (values + weight / alpha))
        self.covariance = (vectors / (alpha * values + weight)) @ vectors.T


#: Most sets of holes whose sums the driver holds; tables with more are filled row by row, a table a round.
PATTERNS = 4096


def iterative_fill(df: DataFrame, features: Sequence[str], rounds: int = 20, tolerance: float = 1e-3, spread: bool = False) -> DataFrame:
    """Chained Bayesian ridge regressions: each feature on all others, fewest missing first, from medians until cells move less.

    Filled cells of rows that lack the same features are one linear function of what those rows have, in every round. So one pass sums
    products by set of holes, from which all rounds are worked out, and the last functions are applied to the table. How far cells
    move lies between bounds from the same sums; only where these leave open whether a round was the last, a pass measures it.
    Columns without any value stay null. With `spread`, <feature>_spread is the posterior deviation of a filled cell, null elsewhere.
    """
    features = list(features)
    work = df.withColumns({f: to_numeric(f) for f in features})
    seen = work.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features], *[F.max(F.abs(f)).alias(f"_{f}") for f in features]).first().asDict()
    used = [f for f in features if seen[f"_{f}"] is not None]
    middle = [m[0] for m in exact_quantiles(work, {f: [0.5] for f in used}).values()]
    limit = tolerance * max((seen[f"_{f}"] for f in used), default=0.0)
    order = [f for f in sorted(used, key=lambda f: seen[f]) if seen[f]]
    wide = {f"{f}_spread": F.lit(None).cast("double") for f in features} if spread else {}
    if not order:
        return work.withColumns(wide).select(*df.columns, *wide) if wide else work
    sums = _pattern_sums(work, used, middle) if len(used) < 63 else None
    if sums is None:
        return _iterative_by_rows(work, used, order, rounds, limit, wide).select(*df.columns, *wide)
    for _ in range(rounds):
        before = sums.rows.copy()
        if not any([sums.regress(used.index(f), spread) for f in order]):
            break
        least, most = sums.moved(before)
        if least < limit <= most:
            steps = {f"_{f}": _linear(sums, used.index(f), "_b") for f in order}
            least = max((x or 0.0) for x in sums.joined(work, sums.rows - before).agg(*[F.max(F.abs(v)).alias(n) for n, v in steps.items()]).first())
        if least < limit:
            break
    out = sums.joined(work, sums.rows)
    new = {f: F.when(F.col(f).isNull(), F.lit(sums.middle[used.index(f)]) + _linear(sums, used.index(f), "_b")).otherwise(F.col(f)) for f in order}
    if spread:
        new |= wide | {f"{f}_spread": F.when(F.col(f).isNull(), _deviation(sums, used.index(f))) for f in order if used.index(f) in sums.variances}
    return out.withColumns(new).select(*df.columns, *wide)


class PatternSums:
    """Sums of products of (1, features less their middles, 0 where missing) by set of holes, and the filled cells' linear functions of them."""

    def __init__(self, used: list[str], middle: list[float], masks: np.ndarray, sums: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.used, self.middle, self.masks, self.sums, self.low, self.high = used, middle, masks, sums, low, high
        m = len(used) + 1
        self.gone = (masks[:, None] >> np.arange(m - 1)) & 1 == 1
        self.rows = np.where(self.gone[:, :, None], 0.0, np.eye(m)[1:])
        self.variances: dict[int, np.ndarray] = {}

    def regress(self, j: int, spread: bool) -> bool:
        """Feature j on all others, over the rows that have it; whether there was something to fit."""
        others = [i for i in range(len(self.used)) if i != j]
        there = ~self.gone[:, j]
        n = self.sums[there, 0, 0].sum()
        if not others or n < 2:
            return False
        one = np.zeros((len(self.rows), 1, self.rows.shape[2]))
        one[:, 0, 0] = 1.0
        terms = np.concatenate([one, self.rows[:, [*others, j]]], 1)
        whole = (terms[there] @ self.sums[there] @ terms[there].transpose(0, 2, 1)).sum(0)
        mean = whole[0] / n
        centred = whole - n * np.outer(mean, mean)
        found = Evidence(centred[1:-1, 1:-1], centred[1:-1, -1], centred[-1, -1], n)
        away = terms[:, 1:-1] - mean[1:-1, None] * one
        self.rows[:, j] = np.where(there[:, None], self.rows[:, j], found.coef @ away + mean[-1] * one[:, 0])
        if spread:
            square = away.transpose(0, 2, 1) @ found.covariance @ away
            square[:, 0, 0] += 1.0 / found.alpha
            self.variances[j] = square
        return True

    def moved(self, before: np.ndarray) -> tuple[float, float]:
        """Bounds of the farthest that a filled cell moved: the largest root mean square of a pattern, and what its range of values allows."""
        step = np.where(self.gone[:, :, None], self.rows - before, 0.0)
        square = np.einsum("pfi,pij,pfj->pf", step, self.sums, step) / self.sums[:, :1, 0]
        low, high = (np.concatenate([np.ones((len(x), 1)), x], 1)[:, None] for x in (self.low, self.high))
        ends = np.abs([np.minimum(step * low, step * high).sum(2), np.maximum(step * low, step * high).sum(2)])
        return float(np.sqrt(np.maximum(square, 0).max())) * (1 - 1e-6), float(ends.max()) * (1 + 1e-6)

    def joined(self, work: DataFrame, rows: np.ndarray) -> DataFrame:
        """The table with _b, the coefficients of each row's pattern (and _v, those of the variances)."""
        square = [np.concatenate([self.variances[j][p].ravel() for j in sorted(self.variances)]).tolist() if self.variances else [] for p in range(len(rows))]
        table = work.sparkSession.createDataFrame([(int(k), r.ravel().tolist(), v) for k, r, v in zip(self.masks, rows, square, strict=True)], "_p long, _b array<double>, _v array<double>")
        return work.withColumn("_p", _pattern(self.used)).join(F.broadcast(table), "_p")

    def terms(self) -> list[Column]:
        return _centred(self.used, self.middle)


def _pattern(used: Sequence[str]) -> Column:
    """The set of a row's holes as bits."""
    return sum((F.when(F.col(f).isNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, f in enumerate(used)), F.lit(0).cast("long"))


def _centred(used: Sequence[str], middle: Sequence[float]) -> list[Column]:
    return [F.lit(1.0), *[F.coalesce(F.col(f) - F.lit(float(m)), F.lit(0.0)) for f, m in zip(used, middle, strict=True)]]


def _pattern_sums(work: DataFrame, used: list[str], middle: list[float]) -> PatternSums | None:
    """Sums by set of holes, in one pass; none if there are too many sets."""
    z, m = _centred(used, middle), len(used) + 1
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    ends = [f(F.col(c) - F.lit(float(v))).alias(f"{n}{i}") for i, (c, v) in enumerate(zip(used, middle, strict=True)) for n, f in (("lo", F.min), ("hi", F.max))]
    got = work.groupBy(_pattern(used).alias("_p")).agg(*[F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i, j in pairs], *ends).limit(PATTERNS + 1).collect()
    if len(got) > PATTERNS:
        return None
    sums = np.zeros((len(got), m, m))
    for i, j in pairs:
        sums[:, i, j] = sums[:, j, i] = [r[f"g{i}_{j}"] for r in got]
    low, high = (np.array([[r[f"{n}{i}"] or 0.0 for i in range(m - 1)] for r in got]) for n in ("lo", "hi"))
    return PatternSums(used, middle, np.array([r["_p"] for r in got], np.int64), sums, low, high)


def _linear(sums: PatternSums, j: int, column: str) -> Column:
    """The function of feature j, of the coefficients in a column."""
    z = sums.terms()
    return sum((F.get(F.col(column), F.lit(j * len(z) + i)) * t for i, t in enumerate(z)), F.lit(0.0))


def _deviation(sums: PatternSums, j: int) -> Column:
    z = sums.terms()
    start = sorted(sums.variances).index(j) * len(z) ** 2
    return F.sqrt(sum((F.get("_v", F.lit(start + a * len(z) + b)) * z[a] * z[b] for a in range(len(z)) for b in range(len(z))), F.lit(0.0)))


def _iterative_by_rows(work: DataFrame, used: list[str], order: list[str], rounds: int, limit: float, wide: dict[str, Column]) -> DataFrame:
    """The same for tables of very many sets of holes: a regression aggregates one matrix of sums of the completed table, and is applied
    as an expression over the previous round's."""
    gone = {f: f"_gone_{f}" for f in used}
    work = median_fill(work.withColumns({gone[f]: F.col(f).isNull() for f in used}), used)
    work = work.withColumns(wide) if wide else work
    for _ in range(rounds):
        moves = []
        for f in order:
            others = [c for c in used if c != f]
            terms = [F.lit(1.0), *[F.col(c) for c in [*others, f]]]
            m = len(terms)
            got = work.where(~F.col(gone[f])).agg(*[F.sum(terms[i] * terms[j]).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m)]).first().asDict()
            n = got["g0_0"]
            if not others or n is None or n < 2:
                continue
            whole = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(m)] for i in range(m)])
            mean = whole[0] / n
            centred = whole - n * np.outer(mean, mean)
            found = Evidence(centred[1:-1, 1:-1], centred[1:-1, -1], centred[-1, -1], n)
            away = [F.col(c) - float(v) for c, v in zip(others, mean[1:-1], strict=True)]
            value = sum((float(b) * t for b, t in zip(found.coef, away, strict=True)), F.lit(float(mean[-1])))
            new = {"_new": F.when(F.col(gone[f]), value).otherwise(F.col(f))}
            if wide:
                var = sum((float(found.covariance[i, j]) * away[i] * away[j] for i in range(len(away)) for j in range(len(away))), F.lit(1.0 / found.alpha))
                new[f"{f}_spread"] = F.when(F.col(gone[f]), F.sqrt(var))
            work = work.withColumns(new).withColumn(f"_move_{f}", F.abs(F.col("_new") - F.col(f)))
            work = work.drop(f).withColumnRenamed("_new", f)
            moves.append(f"_move_{f}")
        if not moves:
            break
        # One table a round: within it, a feature's new values are an expression that the next one reads.
        work = written(work, "iterative")
        moved = max((x or 0.0) for x in work.agg(*[F.max(m) for m in moves]).first())
        work = work.drop(*moves)
        if moved < limit:
            break
    return work


FILLS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {"median": median_fill, "knn": knn_fill, "iterative": iterative_fill, "complete_case": lambda df, features: df.dropna(subset=list(features)), "raw": lambda df, features: df}


def impute_each(df: DataFrame, features: Sequence[str], methods: Sequence[str], log_features: Sequence[str] = LOG_FEATURES, id_column: str = "row_index") -> dict[str, DataFrame]:
    """impute() by each method. All read one table, dealt out over the tasks whatever its files, and its units are worked out once."""
    rows = written(df.repartition(id_column), "impute-rows")
    stats = robust_row(log_transform(with_provenance(rows, features), [f for f in features if f in log_features]), features)
    return {m: impute(rows, features, m, log_features, id_column, stats) for m in methods}


def impute(df: DataFrame, features: Sequence[str], method: str = "median", log_features: Sequence[str] = LOG_FEATURES, id_column: str = "row_index", stats: DataFrame | None = None) -> DataFrame:
    """Log, scale, fill, undo both, hold bounds; observed cells stay as they are, filled ones are named so in their source.

    stats: robust_row of the logarithms, where it is known already.
    """
    if method not in FILLS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(FILLS)}")
    logs = [f for f in features if f in log_features]
    base = with_provenance(df, features)
    model = log_transform(base.select(id_column, *features) if method == "knn" else base.withColumns({f"_own_{f}": F.col(f) for f in features}), logs)
    stats = stats if stats is not None else robust_row(model, features)
    filled = invert_robust_scale(FILLS[method](robust_scale(model, features, stats), features), features, stats)
    filled = bounded(filled.withColumns({f: F.greatest(F.pow(F.lit(10.0), F.col(f)), F.lit(FLOOR)) if f in logs else F.col(f) for f in features}), {f: b for f, b in BOUNDS.items() if f in features})
    if method == "knn":  # its tasks hold the features alone
        out = base.withColumnsRenamed({f: f"_own_{f}" for f in features}).join(filled, id_column, "left")
    else:
        out = filled
    new = {f: F.col(f"_own_{f}").isNull() & F.col(f).isNotNull() for f in features}
    out = out.withColumns({f"{f}_source": F.when(new[f], f"imputed_{method}").otherwise(F.col(f"{f}_source")) for f in features}).withColumns({f: F.coalesce(f"_own_{f}", f) for f in features})
    return with_flags(out.select(*base.columns), features)


def imputed_cells(df: DataFrame, features: Sequence[str], id_column: str = "row_index") -> DataFrame:
    """Long table of filled cells."""
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col(f"{f}_source").alias("source")) for f in features]
    return df.select(id_column, F.explode(F.array(*rows)).alias("r")).select(id_column, "r.*").where(F.col("source").startswith("imputed"))


def missingness(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, n_rows, n_missing, share: one pass."""
    cols = [F.struct(F.lit(f).alias("feature"), F.count(F.lit(1)).alias("n_rows"), F.count_if(to_numeric(f).isNull()).alias("n_missing")) for f in features]
    return df.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("r")).select("r.*").withColumn("missing_fraction", F.try_divide("n_missing", "n_rows"))


def provenance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Cells of each feature by category of source, a column each."""
    from orrerium.functions.labels import source_category

    long = df.unpivot([], [f"{f}_source" for f in features], "feature", "source").withColumn("feature", F.regexp_replace("feature", "_source$", ""))
    kinds = ["observed", "physically_derived", "imputed", "excluded", "missing"]
    return long.withColumn("kind", source_category("source")).groupBy("feature").pivot("kind", kinds).count().na.fill(0)


def coverage(before: DataFrame, after: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Complete rows of each group of features before and after."""
    def whole(df: DataFrame, name: str) -> DataFrame:
        cols = [F.struct(F.lit(g).alias("group"), F.count_if(_all_known(fs)).alias(name)) for g, fs in groups.items()]
        return df.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("r")).select("r.*")

    return whole(before, "complete_before").join(whole(after, "complete_after"), "group")


def _all_known(features: Sequence[str]) -> Column:
    out = F.lit(True)
    for f in features:
        out = out & F.col(f).isNotNull()
    return out


def _hash(feature: str, seed: int, id_column: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_column), F.lit(feature)).cast("double")


def _hidden(df: DataFrame, features: Sequence[str], share: float, seed: int, id_column: str) -> dict[str, Column]:
    """By feature, whether a row's cell is to be hidden: at most the quantile of the hashes of its observed cells."""
    cuts = exact_quantiles(df.select(*[F.when(F.col(f).isNotNull(), _hash(f, seed, id_column)).alias(f) for f in features]), {f: [share] for f in features})
    return {f: F.col(f).isNotNull() & (_hash(f, seed, id_column) <= F.lit(cuts[f][0])) if cuts[f][0] is not None else F.lit(False) for f in features}


def masks(df: DataFrame, features: Sequence[str], share: float = 0.15, seed: int = 42, id_column: str = "row_index") -> DataFrame:
    """(id, feature): of each feature's observed cells the given share, rounded up, in order of a seeded hash.

    The cut is a quantile of the hashes: no window over all cells of a feature.
    """
    chosen = F.array(*[F.when(h, F.lit(f)) for f, h in _hidden(df, features, share, seed, id_column).items()])
    return df.select(id_column, F.explode(F.array_compact(chosen)).alias("feature"))


def masked_validation(df: DataFrame, features: Sequence[str], method: str, share: float = 0.15, seed: int = 42, id_column: str = "row_index") -> DataFrame:
    """Hide cells, fill them, compare: method, feature and errors."""
    return masked_validations(df, features, [method], share, seed, id_column)


def masked_validations(df: DataFrame, features: Sequence[str], methods: Sequence[str], share: float = 0.15, seed: int = 42, id_column: str = "row_index") -> DataFrame:
    """masked_validation() of several methods on the same hidden cells, which are chosen once. Hidden values go along with their rows."""
    df = written(df.repartition(id_column), "masked-rows")
    hidden = _hidden(df, features, share, seed, id_column)
    blind = df.withColumns({f"_true_{f}": F.when(h, to_numeric(f)) for f, h in hidden.items()}).withColumns({f: F.when(F.col(f"_true_{f}").isNull(), F.col(f)) for f in features})
    cells = F.array(*[F.when(F.col(f"_true_{f}").isNotNull() & F.col(f).isNotNull(), F.struct(F.lit(f).alias("feature"), F.col(f"_true_{f}").alias("truth"), F.col(f).alias("guess"))) for f in features])
    parts = [t.select(F.lit(m).alias("method"), F.explode(F.array_compact(cells)).alias("r")).select("method", "r.*") for m, t in impute_each(blind, features, methods, id_column=id_column).items()]
    pairs = written(functools.reduce(DataFrame.unionByName, parts), "masked")
    far = F.abs(F.col("guess") - F.col("truth"))
    of = {f"{i}_{j}": (m, f) for i, m in enumerate(methods) for j, f in enumerate(features)}
    medians = exact_quantiles(pairs.select(*[F.when((F.col("method") == m) & (F.col("feature") == f), far).alias(c) for c, (m, f) in of.items()]), {c: [0.5] for c in of})
    table = df.sparkSession.createDataFrame([(*of[c], m[0]) for c, m in medians.items()], "method string, feature string, median_error double")
    out = errors(pairs, ["method", "feature"], table)
    return out.select(*[c for c in out.columns if c != "method"], "method")


def errors(pairs: DataFrame, keys: list[str], medians: DataFrame | None = None) -> DataFrame:
    """mae, rmse, median error, mape (only if no truth is 0), log errors (positive pairs) of truth and guess by group.

    medians: keys and median_error, where they are known already.
    """
    e = F.col("guess") - F.col("truth")
    le = safe_log10("guess") - safe_log10("truth")
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        *([F.median(F.abs(e)).alias("median_error")] if medians is None else []),
        F.when(F.min(F.abs("truth")) > 1e-12, F.avg(F.try_divide(F.abs(e), F.abs("truth")))).alias("mape"),
        F.avg(F.abs(le)).alias("log_mae"),
        F.sqrt(F.avg(le * le)).alias("log_rmse"),
    )
    if medians is None:
        return out
    return out.join(F.broadcast(medians), keys).select(*keys, "n", "mae", "rmse", "median_error", "mape", "log_mae", "log_rmse")


def method_ranks(metrics: DataFrame, by: str = "mae") -> DataFrame:
    """Methods by the mean of their average ranks within features."""
    ranked = metrics.where(F.col(by).isNotNull()).withColumn("rank", average_rank(F.col(by), "feature"))
    return ranked.groupBy("method").agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n_features"))


def selectable(df: DataFrame, features: Sequence[str], most_missing: float = 0.7) -> tuple[list[str], dict[str, str]]:
    """The features that can be imputed, and why the others can't."""
    reasons = {f: "not_in_table" for f in features if f not in df.columns} | {f: "no_measurement" for f in features if not is_measurement(f)}
    rest = [f for f in features if f not in reasons]
    share = df.agg(*[F.avg(to_numeric(f).isNull().cast("double")).alias(f) for f in rest]).first().asDict() if rest else {}
    reasons |= {f: "too_many_missing" for f, s in share.items() if s is None or s > most_missing}
    return [f for f in features if f not in reasons], reasons


def mapper_table(df: DataFrame, features: Sequence[str], complete_only: bool, id_column: str = "row_index") -> DataFrame:
    """Rows that have all of the features, in the space that Mapper clusters: logarithms of those that are modelled so, then (x - median) / IQR
    over the rows of this table. With `complete_only`, rows with an imputed, excluded or unnamed source go, too.

    Columns: the id, context, features, original_<feature>, and <feature>_was_missing and _source where there. A value without a
    logarithm is null, its row stays. Features that the table lacks are left out; without any, all rows stay with their context alone.
    """
    have = set(df.columns)
    used = [f for f in features if f in have]
    context = [c for c in (id_column, *CONTEXT) if c in have and c not in used]
    if not used:
        return df.select(*context)
    rows = df.withColumns({f"original_{f}": to_numeric(f) for f in used})
    keep = _all_known([f"original_{f}" for f in used])
    for f in used:
        source = F.col(f"{f}_source")
        if complete_only and f"{f}_source" in have:
            keep = keep & F.coalesce(~source.startswith("imputed_") & (source != "excluded_too_missing"), F.lit(False))
    rows = rows.where(keep).withColumns({f: safe_log10(f"original_{f}") if f in LOG_FEATURES else F.col(f"original_{f}") for f in used})
    flags = [c for f in used for c in (f"{f}_was_missing", f"{f}_source") if c in have]
    return robust_scale(rows, used).select(*context, *used, *[f"original_{f}" for f in used], *flags)


def mapper_tables(df: DataFrame, stellar: bool = False, eccentricity: bool = False, id_column: str = "row_index") -> dict[str, DataFrame]:
    """The physical, orbital and joint tables, of complete rows and with imputed ones: phys_complete, ..., joint_imputed."""
    orbital = (*ORBITAL, *(ECCENTRICITY if eccentricity else ()))
    groups = {"phys": PHYSICAL, "orb": orbital, "joint": (*PHYSICAL, *orbital, *(STELLAR if stellar else ()))}
    return {f"{g}_{kind}": mapper_table(df, fs, kind == "complete", id_column) for kind in ("complete", "imputed") for g, fs in groups.items()}


def assert_complete(df: DataFrame, features: Sequence[str], positive: Sequence[str] = ()) -> DataFrame:
    """Raises, as the rows are read, on a null in the features or on a value that isn't positive."""
    bad = F.lit(False)
    for f in features:
        bad = bad | F.col(f).isNull()
    for f in positive:
        bad = bad | (F.col(f) <= 0)
    return df.where(F.coalesce(F.assert_true(~F.coalesce(bad, F.lit(True)), F.lit("incomplete features")).isNull(), F.lit(True)))
