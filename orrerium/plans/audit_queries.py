"""Queries of profiles, imputation, compositions, Mapper graphs, indices, neighbours and models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerium.functions import labels, stats
from orrerium.operators import bias, cases, characterise, context, graph, impute, knn, mapper, models, profile, regions, studies
from orrerium.plans.registry import Registry
from orrerium.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: A line item's id: its order, line and part, and its price in cents, as the order and line alone repeat.
ITEM = "(((l_orderkey * 8 + l_linenumber) * 20011 + l_partkey) * 10007 + CAST(round(l_extendedprice * 100) AS BIGINT) % 10007)"


def _item() -> Column:
    return ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 20011 + F.col("l_partkey")) * 10007 + F.round(F.col("l_extendedprice") * 100).cast("long") % 10007


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _rounded_sql(sql: str, doubles: str, rest: str, digits: int = 6) -> str:
    cols = [f"round({c}, {digits}) AS {c}" for c in doubles.split()]
    return f"WITH r AS ({sql}) SELECT {', '.join(rest.split() + cols)} FROM r"


# Labels and derivations -------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN r < 1.6 THEN 'rocky_size' WHEN r < 4 THEN 'sub_neptune_size' WHEN r < 8 THEN 'neptune_or_sub_jovian_size' ELSE 'jovian_size' END AS radius_class,
  CASE WHEN d >= 5 THEN 'high_density' WHEN d >= 2 THEN 'intermediate_density' ELSE 'low_density' END AS density_class,
  CASE WHEN p < 10 THEN 'short_period' WHEN p < 100 THEN 'intermediate_period' ELSE 'long_period' END AS orbit_class,
  CASE WHEN p < 300 THEN 'cool' WHEN p < 800 THEN 'warm' WHEN p < 1500 THEN 'hot' ELSE 'very_hot' END AS thermal_class,
  CASE WHEN r >= 8 AND p < 10 THEN 'hot_jupiter_candidate' WHEN r >= 8 AND p >= 10 THEN 'warm_or_cool_giant_candidate' WHEN r >= 1 AND r < 1.6 AND m < 10 THEN 'super_earth_candidate' WHEN r >= 1.6 AND r < 4 THEN 'sub_neptune_candidate'
    WHEN r < 1.6 AND d >= 3.5 THEN 'rocky_candidate' WHEN r >= 4 AND p >= 100 THEN 'long_period_giant_candidate' ELSE 'unknown_mixed' END AS candidate_population,
  CASE WHEN r <= 1.6 THEN 'rocky_size' WHEN r <= 2.5 THEN 'super_earth_size' WHEN r <= 4 THEN 'sub_neptune_size' WHEN r <= 8 THEN 'neptune_sub_jovian_size' ELSE 'jovian_size' END AS size_class
FROM (SELECT p_partkey, p_size / 4.0 AS r, p_retailprice / 400.0 AS d, p_retailprice AS p, p_size * 1.0 AS m FROM part)""")
def physical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d, p, m = F.col("p_size") / 4.0, F.col("p_retailprice") / 400.0, F.col("p_retailprice"), F.col("p_size") * 1.0
    return table(spark, sf_dir, "part").select("p_partkey", labels.radius_class(r).alias("radius_class"), labels.density_class(d).alias("density_class"), labels.orbit_class(p).alias("orbit_class"), labels.thermal_class(p).alias("thermal_class"), labels.candidate_population(r, m, d, p).alias("candidate_population"), labels.size_class(r).alias("size_class"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as measurements, some of them missing."""
    return table(spark, sf_dir, "lineitem").select(
        _item().alias("row_index"),
        (F.col("l_extendedprice") / 1000.0).alias("pl_bmasse"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity") / 5.0).alias("pl_rade"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("pl_dens"),
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_extendedprice")).alias("pl_orbper"),
        (F.col("l_tax") * 20).alias("st_mass"),
        F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity") * 1.0).alias("pl_orbsmax"),
        F.concat("l_returnflag", "l_linestatus").alias("discoverymethod"),
    )


MEASURED = f"""m AS (SELECT {ITEM} AS row_index, l_extendedprice / 1000.0 AS pl_bmasse, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity / 5.0 END AS pl_rade, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS pl_dens,
  CASE WHEN l_suppkey % 3 <> 0 THEN l_extendedprice END AS pl_orbper, l_tax * 20 AS st_mass, CASE WHEN l_partkey % 2 = 0 THEN l_quantity * 1.0 END AS pl_orbsmax, l_returnflag || l_linestatus AS discoverymethod FROM lineitem)"""


@query(f"""WITH {MEASURED}, v AS (SELECT *, CASE WHEN pl_bmasse > 0 AND pl_rade > 0 THEN 5.514 * pl_bmasse / (pl_rade * pl_rade * pl_rade) END AS dd,
  CASE WHEN pl_orbper > 0 AND st_mass > 0 THEN pow(st_mass * (pl_orbper / 365.25) * (pl_orbper / 365.25), 1.0 / 3.0) END AS da FROM m)
SELECT row_index, round(coalesce(pl_dens, dd), 6) AS pl_dens, CASE WHEN pl_dens IS NOT NULL THEN 'observed' WHEN dd IS NOT NULL THEN 'derived_density' END AS pl_dens_source,
  round(coalesce(pl_orbsmax, da), 6) AS pl_orbsmax, CASE WHEN pl_orbsmax IS NOT NULL THEN 'observed' WHEN da IS NOT NULL THEN 'derived_kepler' END AS pl_orbsmax_source FROM v""")
def physical_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(impute.derive(_measured(spark, sf_dir)).select("row_index", "pl_dens", "pl_dens_source", "pl_orbsmax", "pl_orbsmax_source"))


@query("""SELECT 'c_acctbal' AS feature, CAST(0 AS BIGINT) AS n_missing_before, count(*) FILTER (c_acctbal <= 0) AS n_nonpositive, count(*) FILTER (c_acctbal <= 0) AS n_missing_after FROM customer
UNION ALL SELECT 'c_nationkey', 0, count(*) FILTER (c_nationkey <= 0), count(*) FILTER (c_nationkey <= 0) FROM customer""")
def log_transform_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.log_audit(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])


@query("""WITH q AS (SELECT quantile_cont(l_quantity, 0.5) AS m1, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS s1, quantile_cont(l_extendedprice, 0.5) AS m2, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS s2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - m1) / s1, 6) AS l_quantity, round((l_extendedprice - m2) / s2, 6) AS l_extendedprice FROM lineitem, q""")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(impute.robust_scale(rows, ["l_quantity", "l_extendedprice"]))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 != 0, F.col("user_id") * 1.0).alias("weight"))


EVENTS = "e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 3 <> 0 THEN user_id * 1.0::DOUBLE END AS weight FROM events)"


@query(f"WITH {EVENTS}, q AS (SELECT median(value) AS a, median(weight) AS b FROM e) SELECT event_id, coalesce(value, a) AS value, coalesce(weight, b) AS weight FROM e, q")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.median_fill(_events(spark, sf_dir), ["value", "weight"])


@query(f"""WITH {EVENTS} SELECT 'value' AS feature, count(*) AS n_rows, count(*) - count(value) AS n_missing, (count(*) - count(value)) / count(*) AS missing_fraction FROM e
UNION ALL SELECT 'weight', count(*), count(*) - count(weight), (count(*) - count(weight)) / count(*) FROM e""")
def missingness_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.missingness(_events(spark, sf_dir), ["value", "weight"])


@query(f"""WITH {MEASURED}, g AS (SELECT 'size' AS "group", 2 AS n_features, count(*) FILTER (pl_bmasse IS NOT NULL AND pl_rade IS NOT NULL) AS n_complete, count(*) AS n_rows FROM m
  UNION ALL SELECT 'orbit', 2, count(*) FILTER (pl_orbper IS NOT NULL AND pl_orbsmax IS NOT NULL), count(*) FROM m) SELECT *, n_complete / n_rows AS complete_fraction FROM g""")
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.complete_rows(_measured(spark, sf_dir), {"size": ["pl_bmasse", "pl_rade"], "orbit": ["pl_orbper", "pl_orbsmax"]})


FILLED = ["pl_bmasse", "pl_rade", "pl_orbper"]


@query()
def impute_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(impute.impute(_measured(spark, sf_dir).select("row_index", *FILLED), FILLED, "knn"))


@query()
def impute_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(impute.impute(_measured(spark, sf_dir).select("row_index", *FILLED), FILLED, "iterative"))


_RIDGE = """z.sxy / (z.sxx + e.w / e.a)"""


@query(f"""WITH RECURSIVE r AS (SELECT p_partkey, p_retailprice / 1000 AS x, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 100 / 10.0 + p_retailprice / 500 END AS y FROM part),
z AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) - count(*) * avg(x) ** 2 AS sxx, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy, sum(y * y) - count(*) * avg(y) ** 2 AS syy FROM r WHERE y IS NOT NULL),
e(k, a, w, c, gone) AS (SELECT 0, 1 / (syy / n + 2.220446049250313e-16), CAST(1 AS DOUBLE), CAST(NULL AS DOUBLE), false FROM z UNION ALL
  SELECT k + 1, (n - a * sxx / (w + a * sxx) + 2e-6) / (syy - 2 * b * sxy + sxx * b * b + 2e-6), (a * sxx / (w + a * sxx) + 2e-6) / (b * b + 2e-6), b, coalesce(abs(b - c) < 1e-3, false) FROM (SELECT e.*, z.*, {_RIDGE} AS b FROM e, z WHERE NOT e.gone AND e.k < 300)),
l AS (SELECT {_RIDGE} AS b, 1 / (e.a * z.sxx + e.w) AS v, e.a AS a, mx, my FROM e, z ORDER BY e.k DESC LIMIT 1)
SELECT p_partkey, round(x, 6) AS x, round(CASE WHEN y IS NULL THEN my + b * (x - mx) ELSE y END, 6) AS y, CAST(NULL AS DOUBLE) AS x_spread, CASE WHEN y IS NULL THEN round(sqrt(1 / a + v * (x - mx) ** 2), 6) END AS y_spread FROM r, l""")
def bayesian_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of chained imputation, with the posterior spread of what it fills."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_retailprice / 1000 AS x", "CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 100 / 10e0 + p_retailprice / 500 END AS y")
    return rounded(impute.iterative_fill(rows, ["x", "y"], 1, spread=True))


@query()
def masked_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measured(spark, sf_dir).select("row_index", *FILLED)
    return rounded(impute.masked_validation(rows, FILLED, "median"))


@query("""WITH r AS (SELECT l_shipmode_like AS method, feature, mae FROM (SELECT l_returnflag AS l_shipmode_like, l_linestatus AS feature, avg(l_tax) AS mae FROM lineitem GROUP BY ALL)),
k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY mae) + (count(*) OVER (PARTITION BY feature, mae) - 1) / 2.0 AS rk FROM r) SELECT method, avg(CAST(rk AS DOUBLE)) AS mean_rank, count(*) AS n_features FROM k GROUP BY method""")
def method_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("feature")).agg(F.avg("l_tax").alias("mae"))
    return impute.method_ranks(rows)


# Profiles ---------------------------------------------------------------------------------------------------------


@query("""SELECT * FROM (SELECT 'l_quantity' AS "column", 'double' AS type, count(*) AS n_rows, count(l_quantity) AS n_known, count(DISTINCT l_quantity) AS n_distinct, count(*) - count(l_quantity) AS n_missing, (count(*) - count(l_quantity)) / count(*) AS missing_fraction, count(DISTINCT l_quantity) / count(*) AS distinct_fraction FROM lineitem
UNION ALL SELECT 'l_returnflag', 'string', count(*), count(l_returnflag), count(DISTINCT l_returnflag), count(*) - count(l_returnflag), (count(*) - count(l_returnflag)) / count(*), count(DISTINCT l_returnflag) / count(*) FROM lineitem)""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_returnflag"])


def _numeric_sql(c: str) -> str:
    qs = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{round(p * 100):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, {qs}, max({c}) AS max, round(skewness({c}), 6) AS skew FROM lineitem"


@query(_numeric_sql("l_quantity") + " UNION ALL " + _numeric_sql("l_extendedprice"))
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.numeric_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, round(corr(x, y), 6) AS rho FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.spearman(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("""SELECT coalesce(c.c_custkey, o.o_custkey) AS k, n, CASE WHEN c.c_custkey IS NULL THEN 'right_only' WHEN o.o_custkey IS NULL THEN 'left_only' ELSE 'both' END AS match
FROM (SELECT c_custkey FROM customer) c FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""")
def align_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    right = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return profile.align(left, right, ["k"])


@query("""SELECT event_type, round(max(CASE WHEN lo <= 0.05 AND (hi > 0.05 OR hi IS NULL) THEN value + coalesce((0.05 - lo) / (hi - lo) * (nv - value), 0) WHEN f AND lo > 0.05 THEN value END), 5) AS q05,
  round(max(CASE WHEN lo <= 0.5 AND (hi > 0.5 OR hi IS NULL) THEN value + coalesce((0.5 - lo) / (hi - lo) * (nv - value), 0) WHEN f AND lo > 0.5 THEN value END), 5) AS q50
FROM (SELECT *, lead(lo) OVER w AS hi, lead(value) OVER w AS nv, row_number() OVER w = 1 AS f FROM (SELECT event_type, value, user_id + 1.0 AS wt, (sum(user_id + 1.0) OVER (PARTITION BY event_type ORDER BY value, user_id ROWS UNBOUNDED PRECEDING) - (user_id + 1.0) / 2) / sum(user_id + 1.0) OVER (PARTITION BY event_type) AS lo FROM events)
  WINDOW w AS (PARTITION BY event_type ORDER BY value, wt)) GROUP BY event_type""")
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("w", F.col("user_id") + 1.0)
    return rounded(stats.weighted_quantiles(rows, ["event_type"], "value", "w", [0.05, 0.5]), 5)


@query("""WITH p AS (SELECT event_id, value / (SELECT max(value) + 1 FROM events) AS p FROM events), r AS (SELECT *, row_number() OVER (ORDER BY p, event_id) AS k, count(*) OVER () AS n FROM p)
SELECT event_id, round(least(min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1), 9) AS q_value FROM r""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    top = ev.agg((F.max("value") + 1).alias("m"))
    return rounded(stats.fdr(ev.join(F.broadcast(top), how="cross").select("event_id", (F.col("value") / F.col("m")).alias("p")), "p").select("event_id", "q_value"), 9)


# Cover, nerve, compositions, shadow -------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*more, _item().alias("row_index"), F.col("l_quantity").alias("lens_0"), (F.col("l_discount") * 100).alias("lens_1"), F.concat("l_returnflag", "l_linestatus").alias("method"))


MEMBER = ("'cover' AS config_id", "CAST(cube_id AS STRING) AS node_id", "row_index", "method")


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapper.cover(_points(spark, sf_dir)).selectExpr(*MEMBER)


COVER = f"""pt AS (SELECT {ITEM} AS row_index, l_quantity AS x, l_discount * 100 AS y, l_returnflag || l_linestatus AS method FROM lineitem),
bd AS (SELECT min(x) AS x0, max(x) - min(x) AS sx, min(y) AS y0, max(y) - min(y) AS sy FROM pt),
cell AS (SELECT CAST(i AS INTEGER) AS i FROM range(10) AS t(i)),
mem AS (SELECT 'cover' AS config_id, CAST(a.i * 10 + b.i AS VARCHAR) AS node_id, row_index, method FROM pt, bd, cell a, cell b
  WHERE greatest(ceil((x - x0 - sx / (20 * 0.65)) / (sx / 10) - 0.5), 0) <= a.i AND a.i <= least(floor((x - x0 + sx / (20 * 0.65)) / (sx / 10) - 0.5), 9)
    AND greatest(ceil((y - y0 - sy / (20 * 0.65)) / (sy / 10) - 0.5), 0) <= b.i AND b.i <= least(floor((y - y0 + sy / (20 * 0.65)) / (sy / 10) - 0.5), 9))"""
NERVE = (
    COVER
    + """,
sz AS (SELECT node_id, count(*) AS n FROM mem GROUP BY node_id),
ed AS (SELECT 'cover' AS config_id, a.node_id AS source, b.node_id AS target, count(*) AS n_shared_members FROM mem a JOIN mem b ON a.row_index = b.row_index AND a.node_id < b.node_id GROUP BY ALL),
nv AS (SELECT ed.*, s.n AS source_size, t.n AS target_size, n_shared_members / (s.n + t.n - n_shared_members) AS jaccard_members FROM ed JOIN sz s ON s.node_id = source JOIN sz t ON t.node_id = target)"""
)


@query(f"WITH {COVER} SELECT * FROM mem")
def cover_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _membership(spark, sf_dir)


@query(f"WITH {NERVE} SELECT * FROM nv")
def nerve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapper.nerve(_membership(spark, sf_dir))


@query(f"""WITH RECURSIVE {NERVE}, bt AS (SELECT source AS a, target AS b FROM nv UNION ALL SELECT target, source FROM nv), rc(a, b) AS (SELECT node_id, node_id FROM sz UNION SELECT rc.a, bt.b FROM rc JOIN bt ON rc.b = bt.a),
cp AS (SELECT a, min(b) AS c FROM rc GROUP BY a), dg AS (SELECT node_id, count(b) AS d FROM sz LEFT JOIN bt ON a = node_id GROUP BY node_id),
tr AS (SELECT x.a AS v, count(*) / 2 AS t FROM bt x JOIN bt y ON x.b = y.a JOIN bt z ON y.b = z.a AND z.b = x.a GROUP BY x.a),
nd AS (SELECT node_id, d, coalesce(t, 0) AS t, CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS cl FROM dg LEFT JOIN tr ON v = node_id),
g AS (SELECT count(*) AS n_nodes, CAST(sum(d) / 2 AS BIGINT) AS n_edges, (SELECT count(DISTINCT c) FROM cp) AS beta_0, (SELECT max(n) FROM (SELECT count(*) AS n FROM cp GROUP BY c)) AS largest_component, avg(d) AS average_degree, max(d) AS max_degree, avg(cl) AS average_clustering, count(*) FILTER (d = 0) AS n_isolates, 2 * sum(t) / sum(d * (d - 1)) AS transitivity FROM nd)
SELECT 'cover' AS config_id, n_nodes, n_edges, beta_0, n_edges - n_nodes + beta_0 AS beta_1, round(2 * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density, round(average_degree, 6) AS average_degree, max_degree, round(average_clustering, 6) AS average_clustering, round(transitivity, 6) AS transitivity, n_isolates, largest_component FROM g""")
def mapper_graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph.written(_membership(spark, sf_dir), "membership")
    return rounded(graph.graph_metrics(m.select("config_id", "node_id").distinct(), mapper.nerve(m)))


@query(f"""WITH RECURSIVE {NERVE}, bt AS (SELECT source AS a, target AS b FROM nv UNION ALL SELECT target, source FROM nv), vs AS (SELECT DISTINCT node_id AS a FROM mem),
rc(a, b, d) AS (SELECT a, a, 0 FROM vs UNION SELECT rc.a, bt.b, d + 1 FROM rc JOIN bt ON rc.b = bt.a WHERE d < 20), di AS (SELECT a, b, min(d) AS d FROM rc GROUP BY a, b),
ps(a, b, d, n) AS (SELECT a, a, 0, CAST(1 AS DOUBLE) FROM vs UNION ALL SELECT ps.a, bt.b, ps.d + 1, sum(ps.n) FROM ps JOIN bt ON ps.b = bt.a JOIN di ON di.a = ps.a AND di.b = bt.b AND di.d = ps.d + 1 GROUP BY ALL),
be AS (SELECT x.b AS a, sum(x.n * y.n / z.n) AS s FROM ps x JOIN ps y ON y.a = x.b AND y.b <> x.b JOIN ps z ON z.a = x.a AND z.b = y.b AND z.d = x.d + y.d WHERE x.a <> x.b AND x.a <> y.b GROUP BY 1),
ca AS (SELECT a, count(*) FILTER (d > 0) AS r, sum(d) AS t, max(d) AS e FROM di GROUP BY a), nn AS (SELECT count(*) AS n FROM vs), ms AS (SELECT a, min(b) AS b FROM bt GROUP BY a),
ct(a, b) AS (SELECT a, b FROM ms UNION SELECT ct.a, bt.b FROM ct JOIN bt ON bt.a = ct.b WHERE bt.b <> ct.a), cu AS (SELECT DISTINCT a FROM bt WHERE NOT EXISTS (SELECT 1 FROM ct WHERE ct.a = bt.a AND ct.b = bt.b))
SELECT 'cover' AS config_id, ca.a AS node_id, round(coalesce(s, 0) / ((n - 1) * (n - 2)), 6) AS betweenness, round(CASE WHEN t > 0 THEN r / t * (r / (n - 1)) ELSE 0 END, 6) AS closeness, CAST(e AS BIGINT) AS eccentricity, cu.a IS NOT NULL AS is_articulation FROM ca LEFT JOIN be USING (a) LEFT JOIN cu USING (a), nn""")
def node_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph.written(_membership(spark, sf_dir), "membership")
    return rounded(graph.centrality(m.select("config_id", "node_id").distinct(), mapper.nerve(m)))


METHODS = ["AF", "NF", "NO", "RF"]


@query(f"WITH {COVER} SELECT config_id, node_id, " + ", ".join(f"count(*) FILTER (method = '{x}') AS \"{x}\"" for x in METHODS) + " FROM mem GROUP BY ALL")
def node_method_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bias.crosstab(_membership(spark, sf_dir), "method", METHODS)


BIAS = (
    COVER
    + """,
ct AS (SELECT node_id, method, count(*) AS n FROM mem GROUP BY ALL), nm AS (SELECT node_id, CAST(sum(n) AS BIGINT) AS m, count(*) AS k, arg_min(method, (-n, method)) AS top, max(n) / sum(n) AS purity, abs(ln(sum(n)) - sum(n * ln(n)) / sum(n)) AS h FROM ct GROUP BY node_id),
uk AS (SELECT count(DISTINCT method) AS k FROM mem)"""
)


@query(f"WITH {BIAS} SELECT 'cover' AS config_id, node_id, m AS n_members, m AS n_labelled, nm.k AS n_kinds, top, round(purity, 6) AS purity, round(h, 6) AS entropy, round(h / ln(uk.k), 6) AS entropy_norm FROM nm, uk")
def node_purity_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.node_metrics(_membership(spark, sf_dir), "method"))


@query(f"WITH {BIAS} SELECT 'cover' AS config_id, count(*) AS n_nodes, CAST(sum(m) AS BIGINT) AS n_memberships, round(sum(m * purity) / sum(m), 6) AS weighted_purity, round(sum(m * h) / sum(m), 6) AS weighted_entropy FROM nm")
def global_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.global_bias(_membership(spark, sf_dir), "method"))


@query(f"""WITH {BIAS}, t AS (SELECT sum(n) AS a FROM ct), r AS (SELECT node_id, sum(n) AS n FROM ct GROUP BY 1), c AS (SELECT method, sum(n) AS n FROM ct GROUP BY 1),
i AS (SELECT sum(ct.n / a * ln(ct.n * a / (r.n * c.n))) AS mi FROM ct JOIN r USING (node_id) JOIN c USING (method), t)
SELECT round(mi, 6) AS mi, round(mi / (((SELECT -sum(n / a * ln(n / a)) FROM r, t) + (SELECT -sum(n / a * ln(n / a)) FROM c, t)) / 2), 6) AS nmi FROM i""")
def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.mutual_information(_membership(spark, sf_dir), "node_id", "method"))


@query(f"""WITH {NERVE}, {BIAS[len(COVER) + 2 :]}, bt AS (SELECT source AS a, target AS b FROM nv UNION ALL SELECT target, source FROM nv), c AS (SELECT x.top AS la, y.top AS lb, count(*) AS n FROM bt JOIN nm x ON x.node_id = a JOIN nm y ON y.node_id = b GROUP BY ALL),
s AS (SELECT sum(n) AS a, sum(n) FILTER (la = lb) AS d FROM c), e AS (SELECT sum(m * m / (a * a)) AS ab FROM (SELECT la, sum(n) AS m FROM c GROUP BY la), s)
SELECT CASE WHEN ab < 1 THEN round((d / a - ab) / (1 - ab), 6) END AS assortativity FROM s, e""")
def assortativity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph.written(_membership(spark, sf_dir), "membership")
    tops = bias.node_metrics(m, "method").select(F.col("node_id").alias("id"), F.col("top").alias("label"))
    return rounded(stats.assortativity(mapper.nerve(m), tops))


@query(f"""WITH {BIAS}, wl AS (SELECT method, count(DISTINCT row_index) AS n FROM mem GROUP BY method), w AS (SELECT method, n / (SELECT sum(n) FROM wl) AS q FROM wl), l AS (SELECT nm.node_id, w.method, coalesce(ct.n / nm.m, 0) AS p, q FROM nm CROSS JOIN w LEFT JOIN ct ON ct.node_id = nm.node_id AND ct.method = w.method)
SELECT 'cover' AS config_id, node_id, round(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 / ln(2), 0), 6) AS js_bits,
  round(sum(greatest(p, 1e-12) * ln(greatest(p, 1e-12) / greatest(q, 1e-12))) / ln(2), 6) AS kl_bits FROM l GROUP BY node_id""")
def js_kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.divergence(_membership(spark, sf_dir), "method"))


@query()
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph.written(_membership(spark, sf_dir), "membership")
    return rounded(bias.permutation_tests(m, "method", edges=mapper.nerve(m)))


@query(f"""WITH {NERVE}, {BIAS[len(COVER) + 2 :]}, t AS (SELECT sum(n) AS a FROM ct), r AS (SELECT node_id, sum(n) AS n FROM ct GROUP BY 1), c AS (SELECT method, sum(n) AS n FROM ct GROUP BY 1), i AS (SELECT sum(ct.n / a * ln(ct.n * a / (r.n * c.n))) AS mi FROM ct JOIN r USING (node_id) JOIN c USING (method), t),
bt AS (SELECT source AS a, target AS b FROM nv UNION ALL SELECT target, source FROM nv), e AS (SELECT x.top AS la, y.top AS lb, count(*) AS n FROM bt JOIN nm x ON x.node_id = a JOIN nm y ON y.node_id = b GROUP BY ALL), s AS (SELECT sum(n) AS a, sum(n) FILTER (la = lb) AS d FROM e), ab AS (SELECT sum(m * m / (a * a)) AS ab FROM (SELECT la, sum(n) AS m FROM e GROUP BY la), s)
SELECT 'cover' AS config_id, 'weighted_purity' AS metric, round(sum(m * purity) / sum(m), 6) AS value FROM nm UNION ALL SELECT 'cover', 'weighted_entropy', round(sum(m * h) / sum(m), 6) FROM nm
UNION ALL SELECT 'cover', 'node_method_nmi', round(mi / (((SELECT -sum(n / a * ln(n / a)) FROM r, t) + (SELECT -sum(n / a * ln(n / a)) FROM c, t)) / 2), 6) FROM i UNION ALL SELECT 'cover', 'dominant_method_assortativity', CASE WHEN ab < 1 THEN round((d / a - ab) / (1 - ab), 6) END FROM s, ab""")
def global_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph.written(_membership(spark, sf_dir), "membership")
    return rounded(bias.global_metrics(bias.label_counts(m, "method"), ["config_id"], "method", mapper.nerve(m)))


@query()
def characterise_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as members whose size and mass go by what is known of them."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS row_index", "concat('h', CAST(p_partkey % 500 AS STRING)) AS hostname", "p_retailprice AS pl_orbper", "CAST(p_size AS DOUBLE) AS st_mass", "p_partkey % 17 + p_size / 10e0 AS pl_eqt")
    rows = rows.selectExpr("*", "0.5e0 + st_mass / 5e0 AS pl_rade", "(0.5e0 + st_mass) * (1 + row_index % 7 / 10e0) AS pl_bmasse")
    return rounded(characterise.validate(rows, "multiplanet"), 4)


@query()
def label_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.enrichment(_membership(spark, sf_dir), "method"))


@query(f"""WITH {COVER}, pm AS (SELECT DISTINCT row_index, method FROM mem), pc AS (SELECT method, count(*) AS c FROM pm GROUP BY 1), ptt AS (SELECT count(*) AS t FROM pm), po AS (SELECT node_id, method, count(*) AS o FROM mem GROUP BY ALL),
ps AS (SELECT node_id, CAST(sum(o) AS BIGINT) AS m FROM po GROUP BY 1), pe AS (SELECT po.*, m * (c / t) AS mu, sqrt(m * (c / t) * (1 - c / t) * (t - m) / (t - 1)) AS sd FROM po JOIN ps USING (node_id) JOIN pc USING (method), ptt)
SELECT 'cover' AS config_id, node_id, method, o AS observed, round(mu, 6) AS null_mean, round(sd, 6) AS null_std, round((o - mu) / sd, 6) AS z_score FROM pe""")
def expected_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bias.expected_counts(_membership(spark, sf_dir), "method"))


@query(f"""WITH {COVER}, sg AS (SELECT list(node_id ORDER BY node_id) AS nodes, method FROM mem GROUP BY row_index, method) SELECT 'cover' AS config_id, array_to_string(nodes, ' ') AS nodes, method AS label, count(*) AS n FROM sg GROUP BY ALL""")
def member_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bias.signatures(_membership(spark, sf_dir), "method").withColumn("nodes", F.array_join("nodes", " "))


def _shadowed(m: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = bias.node_metrics(m, "method").select("config_id", "node_id", "n_members", F.col("purity").alias("top_method_fraction"), F.col("entropy_norm").alias("method_entropy_norm"))
    return regions.shadow_scores(nodes.join(regions.node_profiles(m, edges, "method"), ["config_id", "node_id"], "left"))


SHADOW = f"""{NERVE}, {BIAS[len(COVER) + 2 :]}, bt AS (SELECT source AS a, target AS b FROM nv UNION ALL SELECT target, source FROM nv),
nb AS (SELECT a AS node_id, method, sum(n) AS n FROM bt JOIN ct ON ct.node_id = b GROUP BY ALL), nq AS (SELECT node_id, method, n / sum(n) OVER (PARTITION BY node_id) AS q FROM nb), np AS (SELECT node_id, method, n / sum(n) OVER (PARTITION BY node_id) AS p FROM ct),
pr AS (SELECT coalesce(np.node_id, nq.node_id) AS node_id, sum(abs(coalesce(p, 0) - coalesce(q, 0))) AS l1, sum(coalesce(q, 0)) <= 0 AS alone FROM np FULL JOIN nq ON np.node_id = nq.node_id AND np.method = nq.method GROUP BY 1),
sh AS (SELECT 'cover' AS config_id, nm.node_id, m AS n_members, purity, ln(1 + m) / ln(1 + max(m) OVER ()) AS size_weight, alone AS no_neighbors, CASE WHEN NOT alone THEN purity * (1 - h / ln(uk.k)) * l1 END AS raw FROM nm JOIN pr USING (node_id), uk)"""


@query(f"""WITH {SHADOW}, s AS (SELECT *, raw * size_weight AS shadow FROM sh), c AS (SELECT quantile_cont(shadow, 0.9) AS cut FROM s)
SELECT config_id, node_id, n_members, no_neighbors, round(size_weight, 6) AS size_weight, round(shadow, 6) AS shadow_score, CASE WHEN NOT no_neighbors AND shadow >= cut AND n_members < 10 THEN 'small_sample_shadow' WHEN NOT no_neighbors AND shadow >= cut THEN 'high_confidence_shadow' WHEN no_neighbors THEN 'no_neighbor_information' ELSE 'mixed_or_low_shadow' END AS shadow_class FROM s, c""")
def shadow_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph.written(_membership(spark, sf_dir), "membership")
    return rounded(regions.shadow_classes(_shadowed(m, graph.written(mapper.nerve(m), "nerve"))).select("config_id", "node_id", "n_members", "no_neighbors", "size_weight", "shadow_score", "shadow_class"))


# R3, indices, robustness ------------------------------------------------------------------------------------------


def _r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates ride along with the points, so the members needn't be joined back to their rows."""
    points = _points(spark, sf_dir, F.col("l_extendedprice").alias("pl_bmasse"), F.col("l_quantity").alias("pl_orbper"), F.col("l_tax").alias("pl_orbsmax"))
    return regions.r3(mapper.cover(points).selectExpr(*MEMBER, *regions.R3))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, log10(l_extendedprice) AS a, log10(l_quantity) AS b, CASE WHEN l_tax > 0 THEN log10(l_tax) END AS c FROM lineitem),
s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM l)
SELECT l_orderkey, l_linenumber, round((a - ma) / sa, 6) AS z_0, round((b - mb) / sb, 6) AS z_1, round((c - mc) / sc, 6) AS z_2, c IS NOT NULL AS r3_valid FROM l, s""")
def r3_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rounded(regions.r3(rows, ["l_extendedprice", "l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber", "z_0", "z_1", "z_2", "r3_valid"))


R3SQL = f"""xr AS (SELECT m.node_id, m.row_index, log10(l_extendedprice) AS a, log10(l_quantity) AS b, CASE WHEN l_tax > 0 THEN log10(l_tax) END AS c FROM mem m JOIN lineitem ON row_index = {ITEM}),
xs AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM xr),
xz AS (SELECT node_id, row_index, (a - ma) / sa AS z0, (b - mb) / sb AS z1, (c - mc) / sc AS z2 FROM xr, xs WHERE c IS NOT NULL),
xc AS (SELECT node_id, count(*) AS n_valid, avg(z0) AS c0, avg(z1) AS c1, avg(z2) AS c2 FROM xz GROUP BY node_id),
xg AS (SELECT xc.*, (SELECT avg(sqrt((z0 - c0) ** 2 + (z1 - c1) ** 2 + (z2 - c2) ** 2)) FROM xz WHERE xz.node_id = xc.node_id) AS spread FROM xc)"""


@query(f"WITH {COVER}, {R3SQL} SELECT 'cover' AS config_id, node_id, n_valid, round(c0, 6) AS c_0, round(c1, 6) AS c_1, round(c2, 6) AS c_2, round(spread, 6) AS spread FROM xg")
def node_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regions.node_geometry(_r3(spark, sf_dir)))


def _toi(m: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    sums = sums if sums is not None else graph.written(graph.signatures(m, regions.Z, "r3_valid"), "signatures")
    edges = graph.written(mapper.nerve_of(sums), "nerve")
    degree = graph.both_ways(edges).groupBy("config_id", F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    nodes = _shadowed(m.select("config_id", "node_id", "row_index", "method"), edges).join(degree, ["config_id", "node_id"], "left").na.fill(0, ["degree"]).withColumn("I_R3", F.lit(0.0))
    nodes = nodes.join(regions.distance_to_neighbours(m, edges, sums).select("config_id", "node_id", "physical_distance_v_to_N1"), ["config_id", "node_id"], "left")
    return regions.toi(regions.network_support(nodes))


TOI = f"""{SHADOW}, {R3SQL}, dg AS (SELECT a AS node_id, count(*) AS degree FROM bt GROUP BY a), nn AS (SELECT DISTINCT a AS node_id, row_index, z0, z1, z2 FROM bt JOIN xz ON xz.node_id = b), nc AS (SELECT node_id, avg(z0) AS n0, avg(z1) AS n1, avg(z2) AS n2 FROM nn GROUP BY node_id),
tn AS (SELECT sh.*, coalesce(degree, 0) AS degree, sqrt((c0 - n0) ** 2 + (c1 - n1) ** 2 + (c2 - n2) ** 2) AS d FROM sh LEFT JOIN dg USING (node_id) LEFT JOIN xg USING (node_id) LEFT JOIN nc USING (node_id)),
ts AS (SELECT *, coalesce(raw * size_weight, 0) * coalesce(exp(-d * d / 2), 0) * coalesce(sqrt(ln(1 + n_members) / ln(1 + max(n_members) OVER ()) * ln(1 + degree) / ln(1 + max(degree) OVER ())), 0) AS toi FROM tn),
tq AS (SELECT quantile_cont(toi, 0.9) AS hi, quantile_cont(toi, 0.75) AS mid FROM ts)"""


@query(f"""WITH {TOI} SELECT config_id, node_id, round(toi, 6) AS "TOI", row_number() OVER (ORDER BY toi DESC, node_id) AS "TOI_rank",
  CASE WHEN n_members < 3 OR degree <= 0 THEN 'isolated_or_low_support_region' WHEN toi >= hi THEN 'high_toi_region' WHEN toi >= mid THEN 'moderate_toi_region' ELSE 'low_toi_region' END AS region_class FROM ts, tq""")
def toi_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_toi(graph.written(_r3(spark, sf_dir), "r3")).select("config_id", "node_id", "TOI", F.col("TOI_rank").cast("long").alias("TOI_rank"), "region_class"))


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], DataFrame]:
    """(members, nerve, places and standing, signatures): what anchors and deficits are made from, each worked out once."""
    m = graph.written(_r3(spark, sf_dir), "r3")
    held = regions.standing(m)
    sums = regions.standing_sums(held)
    return m, graph.written(mapper.nerve_of(sums), "nerve"), {"points": regions.places(m), "held": held}, sums


def _anchor(m: DataFrame, points: DataFrame) -> DataFrame:
    return graph.written(regions.anchors(m.withColumnRenamed("method", "discoverymethod"), prefer="AF", points=points), "anchors")


_D = "sqrt((a.z0 - b.z0) ** 2 + (a.z1 - b.z1) ** 2 + (a.z2 - b.z2) ** 2)"
ANCHOR = f"""qm AS (SELECT a.node_id, a.row_index, round(sum({_D}), 9) AS t FROM xz a JOIN xz b ON a.node_id = b.node_id GROUP BY ALL), qd AS (SELECT node_id, arg_min(row_index, (t, row_index)) AS row_index FROM qm GROUP BY node_id),
qc AS (SELECT xz.* FROM xz JOIN qd USING (node_id, row_index)), qa AS (SELECT * EXCLUDE (k) FROM (SELECT a.node_id, a.row_index, a.z0, a.z1, a.z2, {_D} AS d, row_number() OVER (PARTITION BY a.node_id ORDER BY method <> 'AF', {_D}, a.row_index) AS k FROM xz a JOIN qc b ON a.node_id = b.node_id JOIN mem m ON m.node_id = a.node_id AND m.row_index = a.row_index) WHERE k = 1)"""
DEFICIT = f"""{ANCHOR}, qt AS (SELECT source AS a, target AS b FROM nv UNION ALL SELECT target, source FROM nv), q2 AS (SELECT DISTINCT x.a, y.b FROM qt x JOIN qt y ON y.a = x.b WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM qt w WHERE w.a = x.a AND w.b = y.b)),
qr AS (SELECT node_id, node_id AS other, 0 AS ring FROM qa UNION ALL SELECT a, b, 1 FROM qt UNION ALL SELECT a, b, 2 FROM q2),
qh AS (SELECT qr.node_id, b.row_index AS anchor, a.row_index, min({_D}) AS d, CAST(max(CASE ring WHEN 0 THEN 1 ELSE 0 END) AS INTEGER) AS in0, CAST(max(CASE ring WHEN 1 THEN 1 ELSE 0 END) AS INTEGER) AS in1, CAST(max(CASE ring WHEN 2 THEN 1 ELSE 0 END) AS INTEGER) AS in2 FROM qr JOIN xz a ON a.node_id = other JOIN qa b ON b.node_id = qr.node_id GROUP BY ALL),
qi AS (SELECT *, row_index = anchor AS self, row_number() OVER (PARTITION BY node_id ORDER BY row_index = anchor, d, row_index) AS rk, least(greatest(floor(sqrt(count(*) OVER (PARTITION BY node_id))), 3), 10) AS k FROM qh),
qs AS (SELECT node_id, anchor, median(d) FILTER (NOT self AND in0 = 1) AS m, quantile_cont(d, 0.75) FILTER (NOT self AND in0 = 1) AS q, max(d) FILTER (NOT self AND rk <= k) AS k, sum(in1) AS n1, sum(in2) AS n2 FROM qi GROUP BY ALL),
ql AS (SELECT node_id, anchor, n1, n2, 'r_node_median' AS radius_type, m AS radius FROM qs UNION ALL SELECT node_id, anchor, n1, n2, 'r_node_q75', q FROM qs UNION ALL SELECT node_id, anchor, n1, n2, 'r_kNN', k FROM qs),
qn AS (SELECT l.node_id, l.anchor, radius_type, radius, n1, n2, count(*) FILTER (NOT self AND d <= radius) AS o, count(*) FILTER (in1 = 1 AND d <= radius) AS e1, count(*) FILTER (in2 = 1 AND d <= radius) AS e2 FROM ql l JOIN qi USING (node_id) WHERE radius IS NOT NULL GROUP BY ALL),
qe AS (SELECT *, CASE WHEN n1 >= 3 THEN e1 WHEN n2 >= 3 THEN e2 END AS e FROM qn), qf AS (SELECT *, e - o AS dn, (e - o) / (e + 1e-9) AS dr FROM qe)"""


@query(f"WITH {COVER}, {R3SQL}, {ANCHOR} SELECT 'cover' AS config_id, node_id, row_index, CAST(0 AS DOUBLE) AS anchor_imputed_fraction, CAST(0 AS DOUBLE) AS r3_imputation_score, round(d, 6) AS distance_to_medoid, round(z0, 6) AS z_0, round(z1, 6) AS z_1, round(z2, 6) AS z_2 FROM qa")
def anchor_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graph.written(_r3(spark, sf_dir), "r3")
    return rounded(_anchor(m, regions.places(m)))


@query(f"""WITH {NERVE}, {R3SQL}, {DEFICIT} SELECT 'cover' AS config_id, node_id, anchor, radius_type, round(radius, 6) AS radius, o AS "N_obs", e AS "N_exp_neighbors", dn AS "delta_N_neighbors", round(dr, 6) AS delta_rel_neighbors,
  CASE WHEN dr IS NULL OR e <= 0 THEN 'undefined_reference' WHEN dr < 0 THEN 'overpopulated_reference' WHEN dr <= 0.1 THEN 'no_deficit' WHEN dr <= 0.3 THEN 'weak_deficit' WHEN dr <= 0.6 THEN 'moderate_deficit' ELSE 'strong_deficit' END AS deficit_class FROM qf""")
def neighbor_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, edges, known, _ = _placed(spark, sf_dir)
    out = regions.deficits(_anchor(m, known["points"]), m, edges, **known)
    return rounded(out.select("config_id", "node_id", "anchor", "radius_type", "radius", "N_obs", "N_exp_neighbors", "delta_N_neighbors", "delta_rel_neighbors", "deficit_class"))


ANALOG = f"""an AS (SELECT sh.node_id, raw * size_weight AS s, n_members, n_valid / n_members AS vf, c0, c1, c2 FROM sh LEFT JOIN xg USING (node_id)), ak AS (SELECT quantile_cont(s, 0.5) AS cut FROM an), av AS (SELECT * FROM an WHERE c2 IS NOT NULL),
ad AS (SELECT a.node_id, b.node_id AS other, b.s, b.n_members, b.vf, sqrt((a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2) AS d FROM av a JOIN av b ON a.node_id <> b.node_id), atau AS (SELECT quantile_cont(d, 0.35) AS tau FROM ad WHERE d > 0 AND node_id < other),
al AS (SELECT node_id, other FROM ad, atau, ak WHERE d <= tau AND s <= cut AND n_members >= 3 AND vf >= 0.6), ao AS (SELECT DISTINCT other FROM al), am AS (SELECT qc.* FROM qc JOIN ao ON qc.node_id = ao.other),
au AS (SELECT qr.node_id AS other, a.row_index, min({_D}) AS d FROM qr JOIN am b ON b.node_id = qr.node_id JOIN xz a ON a.node_id = qr.other WHERE a.row_index <> b.row_index GROUP BY ALL),
ab AS (SELECT l.node_id, radius_type, al.other, count(u.d) AS n FROM qf l JOIN al USING (node_id) JOIN am ON am.node_id = al.other LEFT JOIN au u ON u.other = al.other AND u.d <= l.radius GROUP BY ALL),
ax AS (SELECT node_id, radius_type, CASE WHEN count(*) >= 3 THEN median(n) END AS ea FROM ab GROUP BY ALL), az AS (SELECT node_id, count(*) AS n FROM al GROUP BY 1),
ay AS (SELECT qf.*, CASE WHEN n1 >= 3 THEN 'N1' WHEN n2 >= 3 THEN 'N2' ELSE 'unavailable' END AS used, coalesce(az.n, 0) AS na, ea, (ea - o) / (ea + 1e-9) AS ra FROM qf LEFT JOIN az USING (node_id) LEFT JOIN ax USING (node_id, radius_type))"""


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, edges, known, _ = _placed(spark, sf_dir)
    nodes = regions.node_geometry(m, known["points"]).join(_shadowed(m.select("config_id", "node_id", "row_index", "method"), edges).select("config_id", "node_id", "shadow_score", "n_members"), ["config_id", "node_id"], "right")
    analogs = graph.written(context.analog_nodes(nodes.withColumn("r3_valid_fraction", F.col("n_valid") / F.col("n_members")), reach=0.35, least_members=3, least_valid=0.6), "analogs")
    long = graph.written(regions.deficits(_anchor(m, known["points"]), m, edges, **known), "deficits")
    return regions.analog_deficits(long, analogs, m, edges, **known)


@query(f"""WITH {SHADOW}, {R3SQL}, {DEFICIT}, {ANALOG} SELECT 'cover' AS config_id, node_id, radius_type, o AS "N_obs", e1 AS "N_exp_first", e2 AS "N_exp_second", used AS reference_used, e AS "N_exp_neighbors", na AS n_analog_nodes, ea AS "N_exp_analog", ea - o AS "delta_N_analog", round(ra, 6) AS delta_rel_analog,
  CASE WHEN e IS NULL THEN 'insufficient_neighbors' WHEN ea IS NULL THEN 'insufficient_analogs' END AS warning FROM ay""")
def three_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_three(spark, sf_dir).select("config_id", "node_id", "radius_type", "N_obs", "N_exp_first", "N_exp_second", "reference_used", "N_exp_neighbors", "n_analog_nodes", "N_exp_analog", "delta_N_analog", "delta_rel_analog", "warning"))


@query(f"""WITH {SHADOW}, {R3SQL}, {DEFICIT}, {ANALOG} SELECT 'cover' AS config_id, node_id, anchor, round(max(dr) FILTER (radius_type = 'r_node_median'), 6) AS delta_rel_neighbors_median_radius, round(max(dr) FILTER (radius_type = 'r_node_q75'), 6) AS delta_rel_neighbors_q75_radius, round(max(dr) FILTER (radius_type = 'r_kNN'), 6) AS delta_rel_neighbors_knn_radius,
  round(avg(dr), 6) AS delta_rel_neighbors_mean, round(median(dr), 6) AS delta_rel_neighbors_median, round(greatest(max(dr), 0), 6) AS delta_rel_neighbors_best, round(greatest(max(ra), 0), 6) AS delta_rel_analog_best FROM ay GROUP BY node_id, anchor""")
def reference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regions.deficit_summary(_three(spark, sf_dir)))


_LOCAL = f"""lc AS (SELECT CAST(slot AS INTEGER) AS slot, node_id FROM (SELECT row_number() OVER (ORDER BY o, k) AS slot, node_id FROM (SELECT 0 AS o, 0 AS k, node_id FROM nm WHERE node_id = '55'
  UNION ALL SELECT 1, row_number() OVER (ORDER BY raw * size_weight DESC, sh.n_members DESC, sh.node_id), sh.node_id FROM sh JOIN nm USING (node_id) WHERE nm.top = 'AF' AND sh.n_members >= 10 AND sh.node_id <> '55')) WHERE slot <= 5),
lm AS (SELECT node_id, median(a - b / 3) AS m FROM xr GROUP BY node_id), lr AS (SELECT node_id, ring, count(*) AS n, median(v) AS m FROM (SELECT DISTINCT qr.node_id, ring, xr.row_index, a - b / 3 AS v FROM qr JOIN xr ON xr.node_id = other WHERE ring > 0 AND c IS NOT NULL) GROUP BY ALL),
lu AS (SELECT lm.node_id, lm.m, CASE WHEN x.node_id IS NOT NULL THEN x.m WHEN y.node_id IS NOT NULL THEN y.m ELSE lm.m END AS r FROM lm LEFT JOIN lr x ON x.node_id = lm.node_id AND x.ring = 1 AND x.n >= 3 LEFT JOIN lr y ON y.node_id = lm.node_id AND y.ring = 2 AND y.n >= 3),
lb AS (SELECT node_id, max(dr) AS dn, max(ra) AS da FROM ay GROUP BY node_id)"""


@query(f"""WITH {SHADOW}, {R3SQL}, {DEFICIT}, {ANALOG}, {_LOCAL} SELECT slot, 'cover' AS config_id, lc.node_id, round(raw * size_weight, 6) AS shadow_score, qa.row_index AS anchor, CASE WHEN mem.method = 'AF' THEN 'preferred_method_least_imputed_near_medoid' WHEN mem.method IS NOT NULL THEN 'no_preferred_member_least_imputed_near_medoid' END AS selection_reason,
  round(dn, 6) AS delta_rel_neighbors_best, round(da, 6) AS delta_rel_analog_best, CASE WHEN lb.node_id IS NULL OR qa.node_id IS NULL THEN 'not_available' WHEN lu.m >= lu.r THEN 'lower_rv_proxy_at_like_orbit' ELSE 'lower_mass_at_like_orbit' END AS expected_missing_direction,
  CASE WHEN coalesce(dn, 0) <= 0.1 THEN 'no_deficit' WHEN dn <= 0.3 THEN 'weak_deficit' WHEN dn <= 0.6 THEN 'moderate_deficit' ELSE 'strong_deficit' END AS deficit_class,
  CASE WHEN raw * size_weight >= 0.22 AND dn >= 0.3 THEN 'higher' WHEN raw * size_weight >= 0.15 THEN 'medium' ELSE 'lower' END AS confidence_level
  FROM lc JOIN sh ON sh.node_id = lc.node_id LEFT JOIN qa ON qa.node_id = lc.node_id LEFT JOIN mem ON mem.node_id = qa.node_id AND mem.row_index = qa.row_index LEFT JOIN lb ON lb.node_id = lc.node_id LEFT JOIN lu ON lu.node_id = lc.node_id""")
def local_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five case nodes: chosen, anchored, measured against three references and put side by side."""
    m, edges, known, _ = _placed(spark, sf_dir)
    shadowed = graph.written(_shadowed(m.select("config_id", "node_id", "row_index", "method"), edges).join(bias.node_metrics(m, "method").select("config_id", "node_id", F.col("top").alias("top_method")), ["config_id", "node_id"]), "shadowed")
    chosen = cases.choose_nodes(shadowed, shadowed, "cover", ["55"], "AF", 5, 10).select("slot", "node_id")
    chosen = graph.written(shadowed.select("config_id", "node_id", "shadow_score").join(chosen, "node_id").withColumn("I_R3", F.lit(0.0)), "cases")
    a = graph.written(studies.local_anchors(m, chosen, "method", "AF"), "anchors")
    nodes = regions.node_geometry(m, known["points"]).join(shadowed.select("config_id", "node_id", "shadow_score", "n_members"), ["config_id", "node_id"], "right")
    analogs = context.analog_nodes(nodes.withColumn("r3_valid_fraction", F.col("n_valid") / F.col("n_members")), reach=0.35, least_members=3, least_valid=0.6)
    analogs = graph.written(analogs.join(chosen.select("config_id", "node_id"), ["config_id", "node_id"], "left_semi"), "analogs")
    long = graph.written(regions.deficits(a, m, edges, **known), "deficits")
    out = studies.compare_cases(chosen, a, regions.analog_deficits(long, analogs, m, edges, **known), studies.missing_direction(a, m, edges))
    return rounded(out.select("slot", "config_id", "node_id", "shadow_score", "anchor", "selection_reason", "delta_rel_neighbors_best", "delta_rel_analog_best", "expected_missing_direction", "deficit_class", "confidence_level"))


@query(f"""WITH {TOI}, {DEFICIT}, qb AS (SELECT node_id, greatest(coalesce(max(dr), 0), 0) AS best, count(dr) AS n, count(*) FILTER (dr > 0) AS plus FROM qf GROUP BY node_id),
qp AS (SELECT qa.node_id, row_index, exp(-((z0 - c0) ** 2 + (z1 - c1) ** 2 + (z2 - c2) ** 2) / (2 * CASE WHEN spread > 0 THEN spread ELSE 1e-9 END ** 2)) AS rep, toi, best, CASE WHEN n < 2 THEN 'undefined' WHEN plus = n THEN 'consistent_positive_deficit' WHEN plus > 0 THEN 'radius_sensitive_deficit' ELSE 'no_consistent_deficit' END AS st
  FROM qa JOIN xg USING (node_id) LEFT JOIN qb USING (node_id) JOIN ts USING (node_id))
SELECT 'cover' AS config_id, node_id, row_index, round(toi, 6) AS "TOI", round(best, 6) AS delta_rel_best, st AS deficit_stability, round(rep, 6) AS representativeness, round(toi * coalesce(best, 0) * rep, 6) AS "ATI", CAST(row_number() OVER (ORDER BY toi * coalesce(best, 0) * rep DESC, node_id) AS INTEGER) AS "ATI_rank" FROM qp""")
def ati_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, edges, known, sums = _placed(spark, sf_dir)
    a = _anchor(m, known["points"])
    best = regions.best_deficit(regions.deficits(a, m, edges, **known)).drop("anchor")
    rows = regions.representativeness(a, regions.node_geometry(m, known["points"])).join(best, ["config_id", "node_id"], "left").join(_toi(m, sums).select("config_id", "node_id", "TOI", "n_members"), ["config_id", "node_id"])
    return rounded(regions.ati(rows).select("config_id", "node_id", "row_index", "TOI", "delta_rel_best", "deficit_stability", "representativeness", "ATI", "ATI_rank"))


_FACTORS = {"f1": "avg(s_acctbal) / 10000e0", "f2": "count(1) / 100e0", "f3": "1 - avg(s_suppkey % 7) / 7e0", "f4": "max(s_acctbal) / 10000e0 - 0.5e0"}


@query(f"""WITH n AS (SELECT n_name AS node_id, {', '.join(f'{e} AS {c}' for c, e in _FACTORS.items())} FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name), e AS (SELECT unnest([0.5, 1.0, 2.0]) AS e),
c AS (SELECT node_id, a.e * 1000 + b.e * 100 + c.e * 10 + d.e AS combo, {' * '.join(f'pow(greatest({f}, 0) + 1e-9, {x}.e)' for f, x in zip(_FACTORS, 'abcd', strict=True))} AS s FROM n, e a, e b, e c, e d), r AS (SELECT *, rank() OVER (PARTITION BY combo ORDER BY s DESC) + (count(*) OVER (PARTITION BY combo, s) - 1) / 2.0 AS rk FROM c)
SELECT 'x' AS config_id, node_id, round(avg(CAST(rk AS DOUBLE)), 6) AS mean_rank, round(stddev_pop(CAST(rk AS DOUBLE)), 6) AS rank_std, CAST(min(rk) AS DOUBLE) AS best_rank, CAST(max(rk) AS DOUBLE) AS worst_rank,
  CASE WHEN stddev_pop(rk) <= 2 THEN 'robust_region' WHEN stddev_pop(rk) <= 5 THEN 'moderately_sensitive_region' ELSE 'fragile_region' END AS region_robustness_class FROM r GROUP BY node_id""")
def rank_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = both.groupBy(F.lit("x").alias("config_id"), F.col("n_name").alias("node_id")).agg(*[F.expr(e).alias(c) for c, e in _FACTORS.items()])
    return rounded(regions.robustness(regions.rank_sensitivity(rows, list(_FACTORS))))


@query("""SELECT p_partkey, CASE WHEN s >= 0.22 AND coalesce(i, 1) <= 0.1 AND coalesce(d, 0) >= 0.3 THEN 'higher' WHEN s >= 0.15 AND coalesce(i, 1) <= 0.2 THEN 'medium' ELSE 'lower' END AS confidence FROM (SELECT p_partkey, p_size / 100.0 AS s, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 30 / 100.0 END AS i, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 50 / 100.0 END AS d FROM part)""")
def case_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size / 100e0 AS s", "CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 30 / 100e0 END AS i", "CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 50 / 100e0 END AS d")
    return c.select("p_partkey", labels.confidence(F.col("s"), F.col("i"), F.col("d")).alias("confidence"))


# Neighbours, clusters, models -------------------------------------------------------------------------------------

DIMS = [f"e{k}" for k in range(8)]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.element_at("embedding", k + 1).cast("double").alias(d) for k, d in enumerate(DIMS)])


VECTORS = "v AS (SELECT vec_id AS id, label, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {d}" for k, d in enumerate(DIMS)) + " FROM embeddings)"
NEAR = VECTORS + ", dd AS (SELECT a.id AS query, b.id AS neighbour, b.label, sqrt(" + " + ".join(f"(a.{d} - b.{d}) ** 2" for d in DIMS) + ") AS distance FROM v a, v b WHERE a.id <> b.id), rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM dd)"


@query(f"WITH {NEAR} SELECT query, neighbour, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 5")
def knn_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return rounded(knn.nearest(v, v, DIMS, 5))


@query(f"WITH {NEAR} SELECT round(quantile_cont(distance, 0.9), 6) AS eps FROM rk WHERE rank = 3 AND distance > 0")
def dbscan_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.dbscan_eps(_vectors(spark, sf_dir), DIMS))


_LACKING = "l AS (SELECT id, label, CASE WHEN id % 5 <> 0 THEN e0 END AS e0, CASE WHEN id % 3 <> 0 THEN e1 END AS e1, e2, CASE WHEN label <> 1 THEN e3 END AS e3, label IS NOT NULL AND CAST(id % 5 <> 0 AS INTEGER) + CAST(id % 3 <> 0 AS INTEGER) + CAST(label <> 1 AS INTEGER) > 0 AS ok FROM v)"
_SPACE = f"""{VECTORS}, {_LACKING}, pool AS (SELECT * FROM l WHERE ok), md AS (SELECT {', '.join(f'median({d}) AS m{k}' for k, d in enumerate(DIMS[:4]))} FROM pool),
fl AS (SELECT id, label, ok, {', '.join(f'coalesce({d}, m{k}) AS x{k}' for k, d in enumerate(DIMS[:4]))} FROM l, md), qs AS (SELECT {', '.join(f'median(x{k}) AS c{k}, quantile_cont(x{k}, 0.75) - quantile_cont(x{k}, 0.25) AS s{k}' for k in range(4))} FROM fl WHERE ok),
sp AS (SELECT id, label, ok, {', '.join(f'(x{k} - c{k}) / CASE WHEN s{k} > 0 THEN s{k} ELSE 1 END AS z{k}' for k in range(4))} FROM fl, qs),
an AS (SELECT a.id, b.id AS other, b.label, sqrt({' + '.join(f'(a.z{k} - b.z{k}) ** 2' for k in range(4))}) AS d FROM sp a, sp b WHERE b.ok), ak AS (SELECT *, exp(-d * d / 2) AS w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rk FROM an) WHERE rk <= 15)"""


def _lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return v.selectExpr("id", "label", "CASE WHEN id % 5 <> 0 THEN e0 END AS e0", "CASE WHEN id % 3 <> 0 THEN e1 END AS e1", "e2", "CASE WHEN label <> 1 THEN e3 END AS e3", "label * 1e0 AS y", "CAST(label AS STRING) AS kind")


@query(f"""WITH {_SPACE} SELECT id, count(*) AS n_analogs, round(min(d), 5) AS nearest_distance, round(median(d), 5) AS median_distance, round(coalesce(sum(w) FILTER (label = 0), 0) / sum(w), 5) AS analog_prob_0, round(coalesce(sum(w) FILTER (label = 1), 0) / sum(w), 5) AS analog_prob_1 FROM ak GROUP BY id""")
def weighted_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _lacking(spark, sf_dir)
    out = knn.weighted_analogs(v, v.dropna(subset=["label"]), DIMS[:4], ["y"], 15, classes=("kind", ["0", "1"]))
    return rounded(out.select("id", "n_analogs", "nearest_distance", "median_distance", "analog_prob_0", "analog_prob_1"), 5)


@query(f"WITH {_SPACE} SELECT id AS query, other AS neighbour, round(d, 5) AS distance, CAST(rk AS INTEGER) AS rank, round(w, 5) AS weight FROM ak")
def analog_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _lacking(spark, sf_dir)
    out = knn.analog_neighbours(v, v.dropna(subset=["label"]), DIMS[:4], ["y"], 15)
    return rounded(out.select("query", "neighbour", "distance", "rank", "weight"), 5)


_POOL = "p AS (SELECT p_partkey AS id, log10(p_retailprice) AS lp, log10(p_size) AS la, CASE WHEN p_partkey % 3 <> 0 THEN log10(1 + p_partkey % 17) END AS lm, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 1.5::DOUBLE END AS mass, CASE WHEN p_partkey % 2 <> 0 THEN NULL ELSE p_retailprice END AS radius FROM part)"
_ASK = "c AS (SELECT s_suppkey AS id, log10(900 + s_suppkey * 10) AS lp, log10(1 + s_suppkey % 50) AS la, CASE WHEN s_suppkey % 4 <> 0 THEN log10(1 + s_suppkey % 13) END AS lm FROM supplier)"


@query(f"""WITH {_POOL}, {_ASK}, s3 AS (SELECT stddev_pop(lp) AS a, stddev_pop(la) AS b, stddev_pop(lm) AS c FROM p WHERE lm IS NOT NULL), s2 AS (SELECT stddev_pop(lp) AS a, stddev_pop(la) AS b FROM p),
d AS (SELECT c.id, p.id AS other, mass, radius, sqrt(((c.lp - p.lp) / s3.a) ** 2 + ((c.la - p.la) / s3.b) ** 2 + ((c.lm - p.lm) / s3.c) ** 2) AS d FROM c, p, s3 WHERE c.lm IS NOT NULL AND p.lm IS NOT NULL
  UNION ALL SELECT c.id, p.id, mass, radius, sqrt(((c.lp - p.lp) / s2.a) ** 2 + ((c.la - p.la) / s2.b) ** 2) FROM c, p, s2 WHERE c.lm IS NULL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM d) WHERE r <= 10), e AS (SELECT id, count(*) AS n_analogs, median(mass) AS mm, quantile_cont(mass, 0.16) AS m16, CASE WHEN id % 5 = 0 THEN NULL ELSE median(radius) END AS rm FROM k GROUP BY id)
SELECT id, n_analogs, round(mm, 6) AS mass_median, round(m16, 6) AS mass_q16, round(coalesce(rm, pow(10, 0.5)), 6) AS radius_median, CASE WHEN rm IS NULL THEN 'local_interpolation' ELSE 'analog_neighbors' END AS candidate_estimation_method FROM e""")
def candidate_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "log10(p_retailprice) AS lp", "log10(p_size) AS la", "CASE WHEN p_partkey % 3 <> 0 THEN log10(1 + p_partkey % 17) END AS lm", "CASE WHEN p_partkey % 7 <> 0 THEN p_size * 1.5e0 END AS mass", "CASE WHEN p_partkey % 2 <> 0 THEN NULL ELSE p_retailprice END AS radius")
    asked = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "log10(900 + s_suppkey * 10) AS lp", "log10(1 + s_suppkey % 50) AS la", "CASE WHEN s_suppkey % 4 <> 0 THEN log10(1 + s_suppkey % 13) END AS lm")
    found = knn.analog_estimates(asked, pool, ["lp", "la"], ["mass", "radius"], 10, optional=["lm"])
    # Every fifth has no analog with a radius.
    found = found.withColumns({f"radius_{s}": F.when(F.col("id") % 5 != 0, F.col(f"radius_{s}")) for s in ("median", "q16", "q84")} | {"interp_mass": F.lit(0.25), "interp_radius": F.lit(0.5)})
    return rounded(knn.with_fallback(found, ["mass", "radius"]).select("id", "n_analogs", "mass_median", "mass_q16", "radius_median", "candidate_estimation_method"))


GRIDS = mapper.grid(["phys_min", "phys_density"], ["domain"], [4, 7, 10], [0.2, 0.35])
GRID_SPACES = {"phys_min": ("l_quantity", "l_extendedprice"), "phys_density": ("l_discount", "l_tax", "l_quantity")}


@query(f"""WITH pt AS (SELECT 'phys_min' AS space, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'phys_density', l_discount, l_tax FROM lineitem),
bd AS (SELECT space, min(x) AS x0, max(x) - min(x) AS sx, min(y) AS y0, max(y) - min(y) AS sy FROM pt GROUP BY space), cell AS (SELECT CAST(i AS INTEGER) AS i FROM range(10) AS t(i)),
cfg AS (SELECT * FROM (VALUES {", ".join(f"('{c.id}', '{c.space}', {c.n_cubes}, CAST({c.overlap} AS DOUBLE))" for c in GRIDS)}) AS t(config_id, space, n, o)),
k AS (SELECT config_id, a.i * n + b.i AS cube_id FROM pt JOIN bd USING (space) JOIN cfg USING (space) JOIN cell a ON a.i < n AND greatest(ceil((x - x0 - sx / (2.0::DOUBLE * n * (1.0::DOUBLE - o))) / (sx / n) - 0.5), 0) <= a.i AND a.i <= least(floor((x - x0 + sx / (2.0::DOUBLE * n * (1.0::DOUBLE - o))) / (sx / n) - 0.5), n - 1)
  JOIN cell b ON b.i < n AND greatest(ceil((y - y0 - sy / (2.0::DOUBLE * n * (1.0::DOUBLE - o))) / (sy / n) - 0.5), 0) <= b.i AND b.i <= least(floor((y - y0 + sy / (2.0::DOUBLE * n * (1.0::DOUBLE - o))) / (sy / n) - 0.5), n - 1))
SELECT config_id, cube_id, count(*) AS n FROM k GROUP BY ALL""")
def cover_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of twelve configurations, from one join of the lenses with the table of configurations."""
    points = table(spark, sf_dir, "lineitem").withColumn("row_index", _item())
    return mapper.covers(mapper.lenses(points, GRIDS, GRID_SPACES), GRIDS).groupBy("config_id", "cube_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def mapper_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of twelve configurations of two spaces and two lenses over all vectors, built together."""
    spaces = {"phys_min": DIMS[:2], "orbital": DIMS}
    configs = mapper.grid(list(spaces), ["pca2", "domain"], [3, 5, 8], [0.35])
    return rounded(mapper.build_all(_vectors(spark, sf_dir).withColumnRenamed("id", "row_index"), configs, spaces)[2])


@query()
def mapper_nodes_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumnRenamed("id", "row_index")
    eps = knn.dbscan_eps(v, DIMS, id_column="row_index").first()[0]
    return mapper.build(v, DIMS, eps, mapper.Config("orbital", n_cubes=6))[0]


@query()
def quantile_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("y", F.col("e7"))
    train, test = models.split(v, "random", 0.2, id_column="id")
    ready = models.prepared(train, DIMS[:7])
    forest = models.QuantileForest.fit(ready, "y")
    return forest.predict(models.prepared(test, DIMS[:7], train), "y").select("id", "y", "y_q05", "y_q50", "y_q95")


@query()
def class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("kind", F.col("label").cast("string"))
    train, test = models.split(v, "random", 0.2, id_column="id")
    model, classes = models.class_model(models.prepared(train, DIMS), "kind")
    out = models.predict_classes(model, classes, models.prepared(test, DIMS, train))
    return out.select("id", "kind", labels.most_probable({c: F.col(f"prob_{c}") for c in classes}).alias("predicted"))


@query("""SELECT * FROM (VALUES ('money', CAST(2 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS DOUBLE), 'high'), ('keys', CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS DOUBLE), 'none')) AS t("group", n_features, n_available, mean_missing_fraction, max_risk)""")
def feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = Registry.of({"money": [{"name": "balance", "aliases": ["c_acctbal"], "risk": "low"}, {"name": "debt", "risk": "high"}], "keys": ["c_custkey"]})
    return Registry.audit_summary(reg.audit(table(spark, sf_dir, "customer")))
