"""Mapper graphs: lens, overlapping cover, clusters per cell, nerve; all configurations in one job."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrerium.functions.numeric import ratio, z_score
from orrerium.operators.graph import component_stats, components, graph_metrics, signatures
from orrerium.operators.knn import FEW, LEAF, dbscan_eps, leaves, nearest, spans
from orrerium.sources.tables import written

#: Feature spaces and their other names.
SPACES = {
    "phys_min": ("pl_rade", "pl_bmasse"),
    "phys_density": ("pl_rade", "pl_bmasse", "pl_dens"),
    "orbital": ("pl_orbper", "pl_orbsmax"),
    "thermal": ("pl_insol", "pl_eqt"),
    "orb_thermal": ("pl_orbper", "pl_orbsmax", "pl_insol", "pl_eqt"),
    "joint_no_density": ("pl_rade", "pl_bmasse", "pl_orbper", "pl_orbsmax", "pl_insol", "pl_eqt"),
    "joint": ("pl_rade", "pl_bmasse", "pl_dens", "pl_orbper", "pl_orbsmax", "pl_insol", "pl_eqt"),
}
SPACE_NAMES = {"phys": "phys_density", "orb": "orb_thermal"}
LENSES = ("pca2", "density", "domain")


def space(name: str) -> str:
    found = SPACE_NAMES.get(name, name)
    if found not in SPACES:
        raise ValueError(f"unknown space {name!r}; known: {', '.join(SPACES)}")
    return found


def spaces(name: str) -> list[str]:
    return list(SPACES) if name == "all" else [space(n.strip()) for n in name.split(",")]


@dataclass(frozen=True)
class Config:
    space: str = "orbital"
    lens: str = "pca2"
    n_cubes: int = 10
    overlap: float = 0.35
    min_samples: int = 4

    @property
    def id(self) -> str:
        return f"{self.space}_{self.lens}_cubes{self.n_cubes}_overlap{self.overlap:g}".replace(".", "p")


def grid(names: Sequence[str], lenses: Sequence[str], cubes: Sequence[int], overlaps: Sequence[float]) -> list[Config]:
    return [Config(space(s), lens, n, o) for s, lens, n, o in itertools.product(names, lenses, cubes, overlaps)]


def parse_config(config_id: Column) -> Column:
    """Struct of space, lens, n_cubes and overlap from a configuration id."""
    at = r"^(.+)_([a-z0-9]+)_cubes(\d+)_overlap([0-9p]+)$"
    return F.struct(F.regexp_extract(config_id, at, 1).alias("space"), F.regexp_extract(config_id, at, 2).alias("lens"), F.regexp_extract(config_id, at, 3).try_cast("int").alias("n_cubes"), F.replace(F.regexp_extract(config_id, at, 4), F.lit("p"), F.lit(".")).try_cast("double").alias("overlap"))


def principal(df: DataFrame, features: Sequence[str], n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(means, components): from one aggregation of the covariance; a component's largest loading is positive."""
    features = list(features)
    k = len(features)
    cells = [F.avg(f).alias(f"m{i}") for i, f in enumerate(features)] + [F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    got = df.dropna(subset=features).agg(*cells).first().asDict()
    cov = np.array([[got[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    _, vec = np.linalg.eigh(cov)
    parts = vec[:, ::-1][:, :n].T
    parts = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])[:, None]
    return np.array([got[f"m{i}"] or 0.0 for i in range(k)]), parts


def pca_lens(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """lens_0 and lens_1: the first two principal coordinates (a second of one feature is 0); complete rows only."""
    rows = df.dropna(subset=list(features))
    mean, parts = principal(rows, features)
    dots = [sum((float(p) * (F.col(f) - float(m)) for p, f, m in zip(part, features, mean, strict=True)), F.lit(0.0)) for part in parts]
    return rows.withColumns({"lens_0": dots[0], "lens_1": dots[1] if len(dots) > 1 else F.lit(0.0)})


def density_lens(df: DataFrame, features: Sequence[str], k: int = 15, id_column: str = "row_index") -> DataFrame:
    """lens_0: first principal coordinate; lens_1: log distance to the k-th other row."""
    rows = pca_lens(df, features)
    far = nearest(rows, rows, features, k, id_column, id_column).groupBy(F.col("query").alias(id_column)).agg(F.max("distance").alias("_d"))
    return rows.join(far, id_column).withColumn("lens_1", F.log(F.col("_d") + 1e-8)).drop("_d")


def domain_lens(df: DataFrame, first: str, second: str) -> DataFrame:
    """Two physical coordinates; complete rows only."""
    return df.dropna(subset=[first, second]).withColumns({"lens_0": F.col(first), "lens_1": F.col(second)})


def cover(points: DataFrame, n_cubes: int = 10, overlap: float = 0.35, dims: Sequence[str] = ("lens_0", "lens_1")) -> DataFrame:
    """Each point once for every cell that holds it: columns cube_<d> and cube_id.

    Cells of a dimension are centred on n equal steps of its range and reach r = range / (2 n (1 - overlap)) to either side.
    The cells of a value come from arithmetic, so the cover is a projection and an explode.
    """
    bounds = points.agg(*[f(d).alias(f"_{n}{k}") for k, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))])
    out = points.dropna(subset=list(dims)).join(F.broadcast(bounds), how="cross")
    return _cells(out, dims, F.lit(n_cubes), F.lit(float(overlap))).drop(*bounds.columns)


def _cells(rows: DataFrame, dims: Sequence[str], n_cubes: Column, overlap: Column) -> DataFrame:
    """rows, with bounds _lo<k> and _hi<k> of each dimension, once for every cell that holds them."""
    out, cube = rows, F.lit(0)
    for k, d in enumerate(dims):
        span = F.col(f"_hi{k}") - F.col(f"_lo{k}")
        w, r = span / n_cubes, span / (2.0 * n_cubes * (1.0 - overlap))
        at = F.col(d) - F.col(f"_lo{k}")
        first = F.greatest(F.ceil(F.try_divide(at - r, w) - 0.5), F.lit(0)).cast("int")
        last = F.least(F.floor(F.try_divide(at + r, w) - 0.5), n_cubes - 1).cast("int")
        cells = F.when(w > 0, F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).otherwise(F.array(F.lit(0)))
        out = out.withColumn(f"cube_{k}", F.explode(cells))
        cube = cube * n_cubes + F.col(f"cube_{k}")
    return out.withColumn("cube_id", cube)


def lenses(points: DataFrame, configs: Sequence[Config], features: Mapping[str, Sequence[str]] = SPACES, domain: Mapping[str, tuple[str, str]] | None = None, k_density: int = 15, id_column: str = "row_index") -> DataFrame:
    """space, lens, row, lens_0, lens_1, x (the space's features): every lens of the configurations once, whatever their grids.

    Domain lenses are two columns of the points by space; by default the first two features.
    """
    parts = []
    for name, lens in sorted({(c.space, c.lens) for c in configs}):
        used = list(features[name])
        if lens == "domain":
            rows = domain_lens(points.dropna(subset=used), *((domain or {}).get(name) or (used[0], used[min(1, len(used) - 1)])))
        elif lens in ("pca2", "density"):
            rows = pca_lens(points, used) if lens == "pca2" else density_lens(points, used, k_density, id_column)
        else:
            raise ValueError(f"unknown lens {lens!r}; known: {', '.join(LENSES)}")
        parts.append(rows.select(F.lit(name).alias("space"), F.lit(lens).alias("lens"), F.col(id_column).alias("row"), F.col("lens_0").cast("double").alias("lens_0"), F.col("lens_1").cast("double").alias("lens_1"), F.array(*[F.col(f).cast("double") for f in used]).alias("x")))
    return functools.reduce(DataFrame.unionByName, parts)


#: Configurations of one build: their table is broadcast.
MOST_CONFIGS = 10_000


def covers(lensed: DataFrame, configs: Sequence[Config], eps: Mapping[str, float] | None = None) -> DataFrame:
    """The rows of lenses() once for every configuration and cell that holds them: config_id, cube_id, row, x, eps, min_samples.

    Configurations are rows of a table that is joined by space and lens, so a grid of them is one explode. eps: by space.
    """
    if len(configs) > MOST_CONFIGS:
        raise ValueError(f"{len(configs)} configurations at once; at most {MOST_CONFIGS}")
    spark = lensed.sparkSession
    rows = [(c.id, c.space, c.lens, c.n_cubes, float(c.overlap), float((eps or {}).get(c.space, 0.0)), c.min_samples) for c in configs]
    table = spark.createDataFrame(rows, "config_id string, space string, lens string, n_cubes int, overlap double, eps double, min_samples int")
    bounds = lensed.groupBy("space", "lens").agg(*[f(f"lens_{k}").alias(f"_{n}{k}") for k in range(2) for n, f in (("lo", F.min), ("hi", F.max))])
    grid = F.broadcast(table.join(bounds, ["space", "lens"]))
    held = lensed.dropna(subset=["lens_0", "lens_1"]).join(grid, ["space", "lens"])
    return _cells(held, ("lens_0", "lens_1"), F.col("n_cubes"), F.col("overlap")).select("config_id", F.col("cube_id").cast("int").alias("cube_id"), "row", "x", "eps", "min_samples")


def build_all(points: DataFrame, configs: Sequence[Config], features: Mapping[str, Sequence[str]] = SPACES, eps: Mapping[str, float] | None = None, domain: Mapping[str, tuple[str, str]] | None = None, k_density: int = 15, percentile: float = 0.90, id_column: str = "row_index", most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership, edges, metrics) of all configurations: lenses once a space, all covers, cells and nerves in one job each.

    Without eps (by space) it is estimated, once a space, from the distances of its rows. Metrics have a row for each
    configuration, those without nodes too.
    """
    lensed = written(lenses(points, configs, features, domain, k_density, id_column), "lenses")
    if eps is None:
        eps = {}
        for name in sorted({c.space for c in configs}):
            least = max(c.min_samples for c in configs if c.space == name)
            eps[name] = dbscan_eps(points.dropna(subset=list(features[name])), features[name], least, percentile, id_column).first().eps or 1e-3
    kind = dict(points.dtypes)[id_column]
    members = clusters(covers(lensed, configs, eps).withColumnRenamed("row", id_column), id_column, most=most or HOT_ROWS)
    members = written(members.withColumn(id_column, F.col(id_column).cast(kind)), "memberships")
    edges = written(nerve(members, id_column), "nerves")
    used = lensed.groupBy("space", "lens").agg(F.count(F.lit(1)).alias("rows_used"), F.max(F.size("x")).alias("n_features"))
    rows = [(c.id, c.space, c.lens, c.n_cubes, float(c.overlap), c.min_samples, float(eps[c.space])) for c in configs]
    table = points.sparkSession.createDataFrame(rows, "config_id string, space string, lens string, n_cubes int, overlap double, min_samples int, eps double")
    metrics = graph_metrics(members.select("config_id", "node_id").distinct(), edges)
    out = table.join(used, ["space", "lens"], "left").join(metrics, "config_id", "left")
    counts = ["rows_used", "n_nodes", "n_edges", "beta_0", "beta_1", "max_degree", "n_isolates", "largest_component"]
    return members, edges, out.na.fill(0, counts).withColumn("largest_component_fraction", F.coalesce(F.try_divide(F.col("largest_component").cast("double"), F.col("n_nodes")), F.lit(0.0)))


def compare_methods(inputs: Mapping[str, DataFrame | None], configs: Sequence[Config], features: Mapping[str, Sequence[str]] = SPACES, eps: Mapping[str, float] | None = None, id_column: str = "row_index", **options) -> tuple[DataFrame, DataFrame]:
    """(metrics, availability): the same configurations over the tables of several imputation methods, in one build_all.

    Metrics: input_method, config_id, space, lens, n_nodes, n_edges, beta_0, beta_1, mean_node_imputation_fraction (over nodes, of
    the mean over their members of the share of the space's features that were imputed, by <feature>_source; 0 without nodes) and
    largest_component_fraction. An input that is None or has no rows is not available and has no metrics.
    Ids are unique within an input; names of methods and spaces hold no double underscore.
    """
    spark = SparkSession.active()
    names = sorted({c.space for c in configs})
    there, wide, shares = [], [], []
    for method, points in inputs.items():
        points = None if points is None else written(points, "method-points")
        n = 0 if points is None else points.count()
        there.append((method, n > 0, n))
        if not n:
            continue
        used = sorted({f for name in names for f in features[name]})
        wide.append(points.select(id_column, *[F.col(f).alias(f"{method}__{f}") for f in used]))
        have = set(points.columns)
        flags = {f: F.coalesce(F.col(f"{f}_source").startswith("imputed"), F.lit(False)).cast("double") for f in used if f"{f}_source" in have}
        by = [F.struct(F.lit(f"{method}__{name}").alias("space"), (sum((flags[f] for f in features[name] if f in flags), F.lit(0.0)) / len(features[name])).alias("share")) for name in names]
        shares.append(points.select(id_column, F.explode(F.array(*by)).alias("s")).select(id_column, "s.*"))
    table = spark.createDataFrame(there, "input_method string, available boolean, n_rows long")
    if not wide:
        empty = "input_method string, config_id string, space string, lens string, n_nodes long, n_edges long, beta_0 long, beta_1 long, mean_node_imputation_fraction double, largest_component_fraction double"
        return spark.createDataFrame([], empty), table
    # A method's table is a set of columns and its spaces are spaces of their own, so that one build serves all methods.
    points = written(functools.reduce(lambda x, y: x.join(y, id_column, "full_outer"), wide), "all-methods")
    known = [m for m, ok, _ in there if ok]
    own = {f"{m}__{name}": tuple(f"{m}__{f}" for f in features[name]) for m in known for name in names}
    every = [replace(c, space=f"{m}__{c.space}") for m in known for c in configs]
    members, _, metrics = build_all(points, every, own, {f"{m}__{name}": e for m in known for name, e in eps.items()} if eps is not None else None, id_column=id_column, **options)
    spaces_of = F.broadcast(metrics.select("config_id", "space"))  # a row a configuration
    share = functools.reduce(DataFrame.unionByName, shares)
    each = members.join(spaces_of, "config_id").join(share, [id_column, "space"]).groupBy("config_id", "node_id").agg(F.avg("share").alias("share"))
    mean = each.groupBy("config_id").agg(F.avg("share").alias("mean_node_imputation_fraction"))
    out = metrics.join(mean, "config_id", "left").na.fill(0.0, ["mean_node_imputation_fraction"])

    def plain(c: str) -> Column:
        return F.substring_index(c, "__", -1).alias(c)

    return out.select(F.substring_index("space", "__", 1).alias("input_method"), plain("config_id"), plain("space"), "lens", "n_nodes", "n_edges", "beta_0", "beta_1", "mean_node_imputation_fraction", "largest_component_fraction"), table


#: Distances that a task holds at once.
AT_ONCE = 500_000


class Close:
    """Rows within eps of each other, leaf by leaf: nothing of the size of all pairs is held."""

    def __init__(self, x: np.ndarray, eps: float):
        self.x, self.most, self.norm = x, eps * eps + 1e-12, (x * x).sum(1)
        self.order, starts, self.lo, self.hi = leaves(x, LEAF if x.shape[1] <= FEW else 8 * LEAF)
        self.cuts = np.append(starts, len(x))

    def whole(self, i: int) -> np.ndarray:
        """The leaves all of whose rows are close to all of leaf i: the farthest corners of both tell."""
        span = np.maximum(self.hi - self.lo[i], self.hi[i] - self.lo)
        return (span * span).sum(1) <= self.most * (1 - 1e-9) - 1e-12 * self.norm.max()

    def met(self, own: np.ndarray, other: np.ndarray, later: bool = False, label: np.ndarray | None = None, mixed: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of `own` in a leaf, rows of `other` near the leaf, which are close). later: no pair of leaves twice. label: leaves that hold
        a single label aren't met by leaves of the same one. mixed: without the pairs of leaves of whole()."""
        n = len(self.cuts) - 1
        for i in range(n):
            a = self.order[self.cuts[i] : self.cuts[i + 1]]
            a = a[own[a]]
            if not len(a):
                continue
            gap = np.maximum(np.maximum(self.lo - self.hi[i], self.lo[i] - self.hi), 0)
            near = (gap * gap).sum(1) <= self.most * (1 + 1e-9) + 1e-12
            if later:
                near[:i] = False
            if mixed:
                near &= ~self.whole(i)
            near = np.flatnonzero(near)
            c = self.order[spans(self.cuts[near], self.cuts[near + 1])]
            c = c[other[c]]
            if label is not None and (label[a] == label[a[0]]).all():
                c = c[label[c] != label[a[0]]]
            step = max(1, AT_ONCE // max(1, len(c)))
            for part in (a[s : s + step] for s in range(0, len(a) if len(c) else 0, step)):
                yield part, c, self.norm[part][:, None] + self.norm[c] - 2 * self.x[part] @ self.x[c].T <= self.most

    def weights(self, w: np.ndarray) -> np.ndarray:
        """Of each row the weight of all rows close to it, itself included."""
        out, every = np.zeros(len(self.x), w.dtype), np.ones(len(self.x), bool)
        leaf = np.add.reduceat(w[self.order], self.cuts[:-1])
        for i in range(len(leaf)):
            out[self.order[self.cuts[i] : self.cuts[i + 1]]] = leaf[self.whole(i)].sum()
        for a, c, hit in self.met(every, every, mixed=True):
            out[a] += hit @ w[c]
        return out

    def parts(self, core: np.ndarray) -> np.ndarray:
        """Of each core the least core that it is joined with through close cores; other rows are by themselves."""
        root = np.arange(len(self.x))
        for i in range(len(self.cuts) - 1):
            a = self.order[self.cuts[i] : self.cuts[i + 1]]
            near = np.flatnonzero(self.whole(i))
            c = self.order[spans(self.cuts[near], self.cuts[near + 1])]
            held = root[c[core[c]]]
            if core[a].any() and len(held) and (held != held[0]).any():  # leaf i is close to all of them, and they are joined through its cores
                root[held] = held.min()
                root[:] = root[root]
        for a, c, hit in self.met(core, core, True, root, mixed=True):
            i, j = np.nonzero(hit & (root[a][:, None] != root[c]))
            i, j = a[i], c[j]
            while len(i):
                high, low = np.maximum(root[i], root[j]), np.minimum(root[i], root[j])
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root[:] = root[root]
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
        return root


def dbscan(x: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Cluster of each row, -1 for noise: clusters number by their least core row; a border row joins the least cluster beside it.

    Equal rows are one point with their number.
    """
    if not len(x):
        return np.full(0, -1)
    points, first, back, w = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)
    points, w, back = points[order], w[order], np.argsort(order)[back.ravel()]
    close = Close(points, eps)
    core = close.weights(w) >= min_samples
    root = close.parts(core)
    tops = np.unique(root[core])
    out = np.full(len(points), len(tops))
    out[core] = np.searchsorted(tops, root[core])
    for a, c, hit in close.met(~core, core):
        out[a] = np.where(hit, out[c], len(tops)).min(1)
    return np.where(out < len(tops), out, -1)[back]


#: Rows of a cell that one task clusters; larger cells are cut into boxes.
HOT_ROWS = 20_000


def cluster(covered: DataFrame, features: Sequence[str], eps: float, min_samples: int = 4, id_column: str = "row_index", keys: Sequence[str] = ("config_id",), most: int = HOT_ROWS) -> DataFrame:
    """config_id, node_id, cube_id, cluster_id, row_index: the clusters of every cell, noise left out."""
    rows = covered.select(*keys, "cube_id", id_column, F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.lit(float(eps)).alias("eps"), F.lit(int(min_samples)).alias("min_samples"))
    return clusters(rows, id_column, keys, most)


def clusters(rows: DataFrame, id_column: str = "row_index", keys: Sequence[str] = ("config_id",), most: int = HOT_ROWS) -> DataFrame:
    """The clusters of every cell by its own eps and min_samples: keys, node_id, cube_id, cluster_id, row.

    A cell is one task; one of more than `most` rows is cut into boxes (see spread_clusters) with the same result. Cells of
    fewer rows than a cluster needs have none. rows: keys, cube_id, the row, x (its features), eps, min_samples.
    """
    cell = [*keys, "cube_id"]
    hot = written(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*cell), "hot-cells")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(id_column)
        least = int(group["min_samples"].iloc[0])
        label = dbscan(np.stack(group["x"].to_list()).astype(float), float(group["eps"].iloc[0]), least) if len(group) >= least else np.full(len(group), -1)
        held, label = group[label >= 0], label[label >= 0]
        return pd.DataFrame({**{k: held[k].to_numpy() for k in cell}, "cluster_id": label, id_column: held[id_column].to_numpy()})

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in cell), "cluster_id long", f"{id_column} {kinds[id_column]}"])
    if hot.limit(1).count():
        cool = rows.join(hot, cell, "left_anti")
        out = cool.groupBy(*cell).applyInPandas(run, schema).unionByName(spread_clusters(rows.join(hot, cell, "left_semi"), id_column, keys, most))
    else:
        out = rows.groupBy(*cell).applyInPandas(run, schema)
    return out.select(*keys, F.concat(F.lit("cube"), F.col("cube_id").cast("string"), F.lit("_cluster"), F.col("cluster_id").cast("string")).alias("node_id"), "cube_id", "cluster_id", id_column)


def spread_clusters(rows: DataFrame, id_column: str = "row_index", keys: Sequence[str] = ("config_id",), most: int = HOT_ROWS) -> DataFrame:
    """The clusters of cells of any size, as dbscan() numbers them: keys, cube_id, cluster_id, row.

    Equal rows are one point with their number. Points are cut into boxes of at least eps by the two features that spread most,
    each with a rim of eps of the points around it. A box tells which of its points are cores, then links cores with each
    other and its border points with clusters; clusters that share a core are joined as components. A task holds a box,
    which is as small as its rows allow, but not narrower than eps.
    """
    cell = [*keys, "cube_id"]
    rows = written(rows, "hot-rows")
    points = written(rows.groupBy(*cell, "x", "eps", "min_samples").agg(F.min(id_column).alias("point"), F.count(F.lit(1)).alias("w")), "hot-points")
    wide = points.agg(F.max(F.size("x"))).first()[0] or 1
    spreads = F.sort_array(F.array(*[F.struct(F.coalesce(F.stddev_pop(F.get("x", F.lit(k))), F.lit(-1.0)).alias("sd"), F.lit(k).alias("k"), F.min(F.get("x", F.lit(k))).alias("lo"), F.max(F.get("x", F.lit(k))).alias("hi")) for k in range(wide)]), asc=False)
    shape = points.groupBy(*cell).agg(spreads.alias("d"), F.count(F.lit(1)).alias("n"))
    boxed = points.join(shape, cell).withColumn("reach", F.sqrt(F.col("eps") * F.col("eps") + 1e-12) * (1 + 1e-9))
    parts = F.greatest(F.lit(1.0), F.ceil(F.sqrt(F.col("n") * 4.0 / most)))
    for i in range(min(2, wide)):
        d = F.col("d")[i]
        side = F.greatest((d["hi"] - d["lo"]) / parts, F.col("reach"))
        at = (F.element_at("x", d["k"] + 1) - d["lo"]) / side
        own = F.floor(at)
        steps = F.filter(F.array(F.when((at - own) * side <= F.col("reach"), F.lit(-1)), F.lit(0), F.when((own + 1 - at) * side <= F.col("reach"), F.lit(1))), lambda s: s.isNotNull())
        boxed = boxed.withColumns({f"own{i}": own, f"steps{i}": steps})
    for i in range(min(2, wide)):
        boxed = boxed.withColumn(f"step{i}", F.explode(f"steps{i}"))
    names = [F.col(f"own{i}") + F.col(f"step{i}") for i in range(min(2, wide))]
    mine = functools.reduce(lambda a, b: a & b, [F.col(f"step{i}") == 0 for i in range(min(2, wide))])
    boxed = written(boxed.select(*cell, F.concat_ws(",", *[n.cast("string") for n in names]).alias("box"), mine.alias("own"), "point", "w", "x", "eps", "min_samples"), "hot-boxes")
    kinds = dict(boxed.dtypes)
    ident = ", ".join(f"{k} {kinds[k]}" for k in cell)

    def cores(group: pd.DataFrame) -> pd.DataFrame:
        x, w = np.stack(group["x"].to_list()).astype(float), group["w"].to_numpy()
        near = Close(x, float(group["eps"].iloc[0])).weights(w)
        group = group[group["own"].to_numpy() & (near >= int(group["min_samples"].iloc[0]))]
        return pd.DataFrame({k: group[k].to_numpy(object) for k in (*cell, "point")})

    known = written(boxed.groupBy(*cell, "box").applyInPandas(cores, f"{ident}, point {kinds['point']}").withColumn("core", F.lit(True)), "hot-cores")

    def local(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        x, core, own, point = np.stack(group["x"].to_list()).astype(float), group["core"].to_numpy(bool), group["own"].to_numpy(bool), group["point"].to_numpy()
        close = Close(x, float(group["eps"].iloc[0]))
        top = close.parts(core)
        out = [(point[i], top[i], True) for i in np.flatnonzero(core).tolist()]
        for a, c, hit in close.met(own & ~core, core):
            for i in np.flatnonzero(hit.any(1)).tolist():
                out += [(point[a[i]], r, False) for r in np.unique(top[c[hit[i]]]).tolist()]
        part = f"{group['box'].iloc[0]}:"
        cols = {"point": [o[0] for o in out], "part": [f"{part}{o[1]}" for o in out], "core": [o[2] for o in out]}
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in ({k: [group[k].iloc[0]] * len(out) for k in cell} | cols).items()})

    flagged = boxed.join(known, [*cell, "point"], "left").na.fill(False, ["core"])
    found = written(flagged.groupBy(*cell, "box").applyInPandas(local, f"{ident}, point {kinds['point']}, part string, core boolean"), "hot-parts")
    name = F.to_json(F.struct(*cell))
    held = found.where("core").groupBy(*cell, "point").agg(F.sort_array(F.collect_set("part")).alias("parts"))  # nine boxes at most
    edges = held.where(F.size("parts") > 1).select(name.alias("config_id"), F.col("parts")[0].alias("source"), F.explode(F.slice("parts", F.lit(2), F.size("parts"))).alias("target"))
    comps = components(found.select(name.alias("config_id"), F.col("part").alias("node_id")), edges)
    whole = written(found.withColumn("config", name).join(comps.select(F.col("config_id").alias("config"), F.col("node_id").alias("part"), "component_id"), ["config", "part"]), "hot-whole")
    order = whole.where("core").groupBy("config", "component_id").agg(F.min("point").alias("first"))
    order = order.withColumn("cluster_id", (F.row_number().over(Window.partitionBy("config").orderBy("first")) - 1).cast("long"))
    label = whole.join(order, ["config", "component_id"]).groupBy(*cell, "point").agg(F.min("cluster_id").alias("cluster_id"))
    at = points.join(label, [*cell, "point"]).select(*cell, "x", "cluster_id")
    return rows.join(at, [*cell, "x"]).select(*cell, "cluster_id", id_column)


def nerve(membership: DataFrame, id_column: str = "row_index") -> DataFrame:
    """config_id, source, target, n_shared_members, source_size, target_size, jaccard_members: nodes that share rows.

    A row stands in at most a few cells of the cover: one shuffle brings its nodes together, and what leaves it are counts of sets of nodes.
    """
    return nerve_of(signatures(membership, id_column=id_column))


def nerve_of(rows: DataFrame) -> DataFrame:
    """The nerve from graph.signatures()."""
    size = rows.select("config_id", "n", F.explode("nodes").alias("node_id")).groupBy("config_id", "node_id").agg(F.sum("n").alias("n"))
    pairs = F.expr("flatten(transform(nodes, (a, i) -> transform(slice(nodes, i + 2, size(nodes)), b -> struct(a AS source, b AS target))))")
    shared = rows.where(F.size("nodes") > 1).select("config_id", "n", F.explode(pairs).alias("p")).groupBy("config_id", "p.source", "p.target").agg(F.sum("n").alias("n_shared_members"))
    out = shared.join(size.select("config_id", F.col("node_id").alias("source"), F.col("n").alias("source_size")), ["config_id", "source"]).join(size.select("config_id", F.col("node_id").alias("target"), F.col("n").alias("target_size")), ["config_id", "target"])
    out = out.withColumn("jaccard_members", ratio("n_shared_members", F.col("source_size") + F.col("target_size") - F.col("n_shared_members")))
    return out.select("config_id", "source", "target", "n_shared_members", "source_size", "target_size", "jaccard_members")


def build(points: DataFrame, features: Sequence[str], eps: float, config: Config, lens: DataFrame | None = None, id_column: str = "row_index") -> tuple[DataFrame, DataFrame]:
    """(membership, edges) of one configuration."""
    rows = lens if lens is not None else pca_lens(points, features)
    covered = cover(rows, config.n_cubes, config.overlap).withColumn("config_id", F.lit(config.id))
    members = cluster(covered, features, eps, config.min_samples, id_column)
    return members, nerve(members, id_column)


def bootstrap(points: DataFrame, n: int = 30, share: float = 0.8, seed: int = 42, id_column: str = "row_index") -> DataFrame:
    """Every row once for each time that a draw with replacement takes it: boot_id and the row. Draws follow Poisson's law by a hash of row and draw."""
    # The number of times: how many of the law's cumulative bounds the row's uniform number passes.
    bounds, p, total = [], float(np.exp(-share)), 0.0
    for k in range(1, 12):
        total += p
        bounds.append(total)
        p *= share / k
    rows = points.withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("boot_id"), F.col(id_column)), F.lit(1 << 52)) / float(1 << 52))
    times = sum((F.when(u >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    return rows.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def shuffled(points: DataFrame, features: Sequence[str], n: int = 30, seed: int = 42, id_column: str = "row_index") -> DataFrame:
    """null_id and the rows with every feature's values dealt out anew, each feature by itself.

    Both sides of a pairing are ranked by hashes within null_id, so the draws are the tasks.
    """
    base = points.select(id_column, *features).withColumn("null_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = base.select("null_id", id_column, F.row_number().over(Window.partitionBy("null_id").orderBy(id_column)).alias("_at"))
    for k, f in enumerate(features):
        dealt = base.select("null_id", f, F.row_number().over(Window.partitionBy("null_id").orderBy(F.xxhash64(F.lit(seed + k), F.col("null_id"), F.col(id_column)))).alias("_at"))
        out = out.join(dealt, ["null_id", "_at"])
    return out.drop("_at")


def resampled(points: DataFrame, features: Sequence[str], eps: float, config: Config, draws: int = 30, seed: int = 42, id_column: str = "row_index") -> DataFrame:
    """kind (bootstrap or column_shuffle), metric, observed, mean, std, low and high (5th and 95th percentile), z: the graph of the
    points against graphs of bootstrap draws and of points whose features have been dealt out anew, all under one configuration.

    Every draw is a configuration of its own, so that all draws of a kind are one job. The lens is that of the plain points
    (for shuffled ones of their shuffled values), so no draw fits one of its own, and the cells are those of all draws of a kind.
    """
    features = list(features)
    points = written(points.select(id_column, *features).repartition(id_column), "resampled-points")  # read by every draw
    centre, w = principal(points, features)

    def lensed(df: DataFrame) -> DataFrame:
        return df.withColumns({f"lens_{k}": sum(((F.col(f) - float(c)) * float(v) for f, c, v in zip(features, centre, w[k], strict=True)), F.lit(0.0)) for k in range(min(2, len(w)))} | ({"lens_1": F.lit(0.0)} if len(w) < 2 else {}))

    def metrics(df: DataFrame, ident: str) -> DataFrame:
        covered = cover(lensed(df), config.n_cubes, config.overlap).withColumn("config_id", F.col("_draw"))
        members = written(cluster(covered, features, eps, config.min_samples, ident), "resampled")
        edges = written(nerve(members, ident), "resampled-edges")
        nodes = members.select("config_id", "node_id").distinct()
        size = members.groupBy("config_id", "node_id").agg(F.count(F.lit(1)).alias("n")).groupBy("config_id").agg(F.count(F.lit(1)).cast("double").alias("n_nodes"), F.avg("n").alias("mean_node_size"))
        e = edges.groupBy("config_id").agg(F.count(F.lit(1)).cast("double").alias("n_edges"))
        b = component_stats(nodes, edges).groupBy("config_id").agg(F.count(F.lit(1)).cast("double").alias("beta_0"), F.sum("beta_1").cast("double").alias("beta_1"))
        out = size.join(e, "config_id", "left").join(b, "config_id", "left").na.fill(0.0, ["n_edges", "beta_1"])
        return out.unpivot(["config_id"], ["n_nodes", "n_edges", "beta_0", "beta_1", "mean_node_size"], "metric", "value")

    plain = metrics(points.withColumn("_draw", F.lit("plain")), id_column).select("metric", F.col("value").alias("observed"))
    boot = bootstrap(points, draws, seed=seed, id_column=id_column).withColumn("_draw", F.concat(F.lit("b"), F.col("boot_id").cast("string")))
    boot = boot.withColumn("_row", F.col(id_column) * 64 + F.col("copy"))
    null = shuffled(points, features, draws, seed, id_column).withColumn("_draw", F.concat(F.lit("s"), F.col("null_id").cast("string")))
    every = metrics(boot, "_row").withColumn("kind", F.lit("bootstrap")).unionByName(metrics(null, id_column).withColumn("kind", F.lit("column_shuffle")))
    out = every.groupBy("kind", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", 0.05).alias("low"), F.percentile("value", 0.95).alias("high"))
    return out.join(F.broadcast(plain), "metric").withColumn("z", F.when(F.col("std") > 0, (F.col("observed") - F.col("mean")) / F.col("std")))


def compare(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distance of every two configurations in z-scored metrics, over those that both have."""
    z = metrics.select("config_id", F.array(*[z_score(F.col(c).cast("double")) for c in columns]).alias("z"))
    pairs = z.alias("a").join(z.alias("b"), F.col("a.config_id") < F.col("b.config_id"))
    gap = F.zip_with("a.z", "b.z", lambda x, y: (x - y) * (x - y))
    return pairs.select(F.col("a.config_id").alias("config_a"), F.col("b.config_id").alias("config_b"), F.sqrt(F.aggregate(F.filter(gap, lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v)).alias("distance"))

