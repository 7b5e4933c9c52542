"""Grouped statistics: compositions, entropies, divergences, nulls and weighted quantiles."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composition(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, label, n, share: counts of each label by group; null and blank labels are left out."""
    counts = df.where(F.col(label).isNotNull() & (F.trim(F.col(label).cast("string")) != "")).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def entropy(share: Column, base: float | None = None) -> Column:
    """An aggregate: entropy of shares in nats, or to a base."""
    h = -F.sum(F.when(share > 0, share * F.log(share)).otherwise(0.0))
    h = F.abs(h)
    return h if base is None else h / F.log(F.lit(float(base)))


def summary(df: DataFrame, keys: list[str], label: str, base: float | None = None) -> DataFrame:
    """keys, n_labelled, n_kinds, top (most frequent, ties in label order), purity, entropy."""
    comp = composition(df, keys, label)
    return comp.groupBy(*keys).agg(
        F.sum("n").alias("n_labelled"),
        F.count(F.lit(1)).alias("n_kinds"),
        F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("top"),
        F.max("share").alias("purity"),
        entropy(F.col("share"), base).alias("entropy"),
    )


def js_divergence(p: Column, q: Column, base: float = 2.0) -> Column:
    """An aggregate over labels of two distributions (null is 0): Jensen-Shannon divergence."""
    p, q = F.coalesce(p, F.lit(0.0)), F.coalesce(q, F.lit(0.0))
    m = (p + q) / 2.0

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x / m)).otherwise(0.0)

    return F.greatest(F.sum(part(p) + part(q)) / 2.0 / F.log(F.lit(base)), F.lit(0.0))


def kl_divergence(p: Column, q: Column, base: float = 2.0, least: float = 1e-12) -> Column:
    """An aggregate over labels: Kullback-Leibler divergence, both clipped from below."""
    a, b = F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(least)), F.greatest(F.coalesce(q, F.lit(0.0)), F.lit(least))
    return F.sum(a * F.log(a / b)) / F.log(F.lit(base))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mi and nmi (by the mean of the entropies; two constants agree fully)."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = (pairs.groupBy(c).agg(F.sum("n").alias(f"n_{k}")) for c, k in ((a, "a"), (b, "b")))
    total = pairs.agg(F.sum("n").alias("all"))
    joined = pairs.join(rows, a).join(cols, b).crossJoin(F.broadcast(total))
    mi = joined.agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("n_a") * F.col("n_b")))).alias("mi"))

    def h(side: DataFrame, n: str, name: str) -> DataFrame:
        return side.crossJoin(F.broadcast(total)).agg(entropy(F.col(n) / F.col("all")).alias(name))

    out = mi.crossJoin(h(rows, "n_a", "ha")).crossJoin(h(cols, "n_b", "hb"))
    return out.select(F.greatest("mi", F.lit(0.0)).alias("mi"), F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(F.greatest(F.try_divide("mi", (F.col("ha") + F.col("hb")) / 2.0), F.lit(0.0))).alias("nmi"))


def assortativity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: nominal assortativity of undirected edges (source, target) under labels (id, label); null if it has no meaning."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    a, b = labels.select(F.col("id").alias("source"), F.col("label").alias("la")), labels.select(F.col("id").alias("target"), F.col("label").alias("lb"))
    cells = both.join(a, "source").join(b, "target").groupBy("la", "lb").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)).alias("same"))
    sides = cells.groupBy("la").agg(F.sum("n").alias("m"))  # symmetric: both margins are equal
    expected = sides.crossJoin(F.broadcast(total)).agg(F.sum(F.col("m") * F.col("m") / (F.col("all") * F.col("all"))).alias("ab"))
    return total.crossJoin(expected).select(F.when(F.col("ab") < 1.0, F.try_divide(F.col("same") / F.col("all") - F.col("ab"), 1.0 - F.col("ab"))).alias("assortativity"))


def fdr(df: DataFrame, p: str, out: str = "q_value", keys: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg q-values of p by group; null p have none.

    A q-value depends on the distinct values and their counts alone. Without keys these are cut into ranges of values, so that
    no task orders them all; with keys a group's distinct values are one task's.
    """
    keys = keys or []
    values = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_m"))
    part = [*keys]
    if not keys:
        edges = values.agg(F.percentile_approx(p, [k / 64 for k in range(1, 64)], 1000)).first()[0] or []
        values = values.withColumn("_slot", F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < F.col(p))))
        part = ["_slot"]
    w = Window.partitionBy(*part)
    upto = F.sum("_m").over(w.orderBy(p))
    if keys:
        rows = values.withColumn("_raw", F.col(p) * F.sum("_m").over(w) / upto)
    else:
        sums = values.groupBy("_slot").agg(F.sum("_m").alias("_t"))  # at most 64 rows, here and below
        sums = sums.withColumns({"_before": F.sum("_t").over(Window.orderBy("_slot")) - F.col("_t"), "_all": F.sum("_t").over(Window.partitionBy(F.lit(0)))})
        rows = values.join(F.broadcast(sums.drop("_t")), "_slot").withColumn("_raw", F.col(p) * F.col("_all") / (F.col("_before") + upto))
    rows = rows.withColumn("_least", F.min("_raw").over(w.orderBy(F.col(p).desc())))
    if not keys:
        later = rows.groupBy("_slot").agg(F.min("_raw").alias("_r"))
        later = later.select("_slot", F.min("_r").over(Window.orderBy(F.col("_slot").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
        rows = rows.join(F.broadcast(later), "_slot").withColumn("_least", F.least("_least", "_later"))
    found = rows.select(*keys, p, F.least("_least", F.lit(1.0)).alias(out))
    return df.join(found, [*keys, p], "left").select(*df.columns, out)


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, quantiles: list[float]) -> DataFrame:
    """Quantiles of the weighted midpoint distribution, linear between midpoints and flat beyond; non-positive weights are left out."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(value, weight)
    at = F.try_divide(F.sum(weight).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) / 2.0, F.sum(weight).over(w))
    rows = rows.withColumn("_at", at)
    rows = rows.withColumn("_next", F.lead("_at").over(ordered)).withColumn("_to", F.lead(value).over(ordered)).withColumn("_first", F.row_number().over(ordered) == 1)
    cols = []
    for q in quantiles:
        inside = (F.col("_at") <= q) & ((F.col("_next") > q) | F.col("_next").isNull())
        line = F.col(value) + F.coalesce(F.try_divide(F.lit(q) - F.col("_at"), F.col("_next") - F.col("_at")) * (F.col("_to") - F.col(value)), F.lit(0.0))
        cols.append(F.coalesce(F.max(F.when(inside, line)), F.max(F.when(F.col("_first") & (F.col("_at") > q), F.col(value)))).alias(f"q{round(q * 100):02d}"))
    return rows.groupBy(*keys).agg(*cols)


def empirical(observed: Column, null: Column, high: bool = True) -> Column:
    """An aggregate over null draws: (draws at least as extreme + 1) / (draws + 1)."""
    hit = null >= observed if high else null <= observed
    return (F.sum(F.when(hit, 1).otherwise(0)) + 1) / (F.count(null) + 1)


def null_z(observed: Column, null: Column) -> Column:
    sd = F.stddev_pop(null)
    return F.when(sd > 0, F.try_divide(F.first(observed) - F.avg(null), sd))


#: A bracket holds about four parts of this many of a column's values.
ACCURACY = 1_000


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact linear quantiles of columns, null for a column without values; no task holds a column's distinct values.

    Approximate quantiles give a bracket around each; values below it are counted, and those in it are ranked.
    """
    if not wanted:
        return {}
    out = {c: [None] * len(ps) for c, ps in wanted.items()}
    left = [(c, k, p) for c, ps in wanted.items() for k, p in enumerate(ps)]
    reach = 2 / ACCURACY
    while left:
        ends = {c: sorted({min(max(p + s * reach, 0.0), 1.0) for d, _, p in left if d == c for s in (-1, 1)}) for c in {c for c, _, _ in left}}
        sums = [f(c).alias(f"{k}_{c}") for c in ends for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
        n = df.agg(*sums, *[F.percentile_approx(c, F.array(*[F.lit(e) for e in es]), ACCURACY).alias(f"near_{c}") for c, es in ends.items()]).first()
        left = [(c, k, p) for c, k, p in left if n[f"n_{c}"]]
        if not left:
            break
        cuts = []
        for c, _, p in left:
            lo, hi = (n[f"{k}_{c}"] if at in (0.0, 1.0) else n[f"near_{c}"][ends[c].index(at)] for k, at in (("lo", max(p - reach, 0.0)), ("hi", min(p + reach, 1.0))))
            cuts.append((float(lo), float(hi)))
        spots = [p * (n[f"n_{c}"] - 1) for c, _, p in left]
        # Values below a bracket count as one, which is null.
        near = F.array(*[F.when(F.col(c) <= hi, F.struct(F.lit(i).alias("i"), F.when(F.col(c) >= lo, F.col(c).cast("double")).alias("x"))) for i, ((c, _, _), (lo, hi)) in enumerate(zip(left, cuts, strict=True))])
        counted = df.select(F.explode(F.array_compact(near)).alias("r")).groupBy("r.i", "r.x").agg(F.count(F.lit(1)).alias("m"))
        up_to = F.sum("m").over(Window.partitionBy("i").orderBy(F.col("x").asc_nulls_first()))  # a bracket's values
        first, last = (F.array(*[F.lit(float(f(s))) for s in spots]) for f in (math.floor, math.ceil))
        ranked = counted.withColumn("to", up_to).where((F.col("to") > F.get(first, "i")) & (F.col("to") - F.col("m") <= F.get(last, "i")) & F.col("x").isNotNull()).collect()
        again = []
        for i, (c, k, p) in enumerate(left):
            rows = sorted((r["to"], r["m"], r["x"]) for r in ranked if r["i"] == i)

            def at(rank: int, rows: list = rows) -> float | None:
                return next((x for to, m, x in rows if to - m <= rank < to), None)

            lo, hi = at(math.floor(spots[i])), at(math.ceil(spots[i]))
            if lo is None or hi is None:
                again.append((c, k, p))
            else:
                out[c][k] = lo if lo == hi else (math.ceil(spots[i]) - spots[i]) * lo + (spots[i] - math.floor(spots[i])) * hi
        left, reach = again, reach * 8
    return out
