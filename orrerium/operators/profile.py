"""Profiles of tables: columns, distributions, correlations, coverage."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrerium.functions.numeric import to_numeric
from orrerium.sources.tables import written


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """column, type, n_rows, n_known, n_missing, n_distinct and shares: one pass (exact distinct counts expand it by column)."""
    kinds = dict(df.dtypes)
    columns = list(columns or df.columns)
    distinct = F.count_distinct if exact else F.approx_count_distinct
    cols = []
    for c in columns:
        known = F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True))
        cols.append(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.count(F.lit(1)).alias("n_rows"), F.count_if(known).alias("n_known"), distinct(F.when(known, F.col(c))).alias("n_distinct")))
    out = df.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    return out.withColumns({"n_missing": F.col("n_rows") - F.col("n_known"), "missing_fraction": F.try_divide(F.col("n_rows") - F.col("n_known"), "n_rows"), "distinct_fraction": F.try_divide("n_distinct", "n_rows")})


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, mean, std (sample), min, quantiles, max, skew (bias-adjusted)."""
    points = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    cols = []
    for c in columns:
        x = to_numeric(c)
        n = F.count(x)
        q = F.percentile(x, F.array(*[F.lit(p) for p in points]))
        skew = F.when((n > 2) & (F.min(x) < F.max(x)), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))
        cols.append(F.struct(F.lit(c).alias("column"), n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), *[q[k].alias(f"p{round(p * 100):02d}") for k, p in enumerate(points)], F.max(x).alias("max"), skew.alias("skew")))
    return df.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def _guarded(a: str, b: str) -> Column:
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def spearman(df: DataFrame, columns: Sequence[str], least: int = 30) -> DataFrame:
    """a, b, n, rho of every two columns over the rows that have both; null below `least` rows or for a constant.

    Average ranks come from the counts of distinct values, summed by range: no window over all rows of a column.
    """
    out = None
    for a, b in itertools.combinations(columns, 2):
        pair = written(df.select(to_numeric(a).alias("x"), to_numeric(b).alias("y")).where("x is not null and y is not null"), "pair")
        for c in ("x", "y"):
            pair = pair.join(_ranks(pair, c), c)
        row = pair.agg(F.count(F.lit(1)).alias("n"), _guarded("rank_x", "rank_y").alias("rho"))
        row = row.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", F.when(F.col("n") >= least, F.col("rho")).alias("rho"))
        out = row if out is None else out.unionByName(row)
    return out


def _ranks(df: DataFrame, c: str) -> DataFrame:
    """c, rank_<c>: average rank of each distinct value."""
    edges = df.agg(F.percentile_approx(c, [k / 64 for k in range(1, 64)], 1000)).first()[0] or []
    slot = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(c))) if edges else F.lit(0)
    counts = df.withColumn("_s", slot).groupBy("_s", c).agg(F.count(F.lit(1)).alias("m"))
    totals = counts.groupBy("_s").agg(F.sum("m").alias("t"))
    before = totals.select("_s", F.coalesce(F.sum("t").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # at most 64 rows
    upto = F.sum("m").over(Window.partitionBy("_s").orderBy(c))
    return counts.withColumn("_u", upto).join(F.broadcast(before), "_s").select(c, (F.col("_b") + F.col("_u") - (F.col("m") - 1) / 2.0).alias(f"rank_{c}"))


def strong(correlations: DataFrame, least: float = 0.65) -> DataFrame:
    return correlations.where(F.abs("rho") >= least)


def complete_rows(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """group, n_features, n_complete, share."""
    cols = []
    for g, fs in groups.items():
        whole = F.lit(True)
        for f in fs:
            whole = whole & F.col(f).isNotNull()
        cols.append(F.struct(F.lit(g).alias("group"), F.lit(len(fs)).alias("n_features"), F.count_if(whole).alias("n_complete"), F.count(F.lit(1)).alias("n_rows")))
    return df.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("r")).select("r.*").withColumn("complete_fraction", F.try_divide("n_complete", "n_rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts by value, null included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def align(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on keys, with where each row comes from; duplicate keys on either side raise."""
    for side, df in (("left", left), ("right", right)):
        if not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"keys of the {side} table repeat")
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), list(keys), "full_outer")
    return both.withColumn("match", F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")).drop("_l", "_r")


def alignment_summary(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("match").agg(F.count(F.lit(1)).alias("n"))
