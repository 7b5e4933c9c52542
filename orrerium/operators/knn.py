"""Exact nearest neighbours in blocks, and what is estimated from them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrerium.sources.tables import written

#: Rows of a block on either side: what a task holds is two blocks and a strip of their distances.
BLOCK = 8192
STRIP = 64
#: Pivots that rows are placed by, and rows that they are chosen from.
PIVOTS, SAMPLE = 16, 2048
_BLOCKS = "g string, block long, n long, ids binary, x binary, lo array<double>, hi array<double>"


def _packed(df: DataFrame, id_column: str, features: Sequence[str], group: str | None, block: int) -> DataFrame:
    """Blocks of complete rows by hash: g, block, ids, matrix."""
    rows = _complete(df, id_column, features, group)
    counts = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(counts, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [key[0]], "block": [key[1]], "blocks": [int(rows["blocks"].iloc[0])], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "x": [rows[list(features)].to_numpy(np.float64).tobytes()]})

    return rows.groupBy("g", "block").applyInPandas(pack, "g string, block int, blocks int, ids binary, x binary")


def _complete(df: DataFrame, id_column: str, features: Sequence[str], group: str | None) -> DataFrame:
    rows = df.select(F.col(id_column).cast("long").alias("id"), *[F.col(f).cast("double").alias(f) for f in features], (F.col(group).cast("string") if group else F.lit("")).alias("g"))
    return rows.dropna(subset=["id", *features])


def pivots(rows: DataFrame, features: Sequence[str], block: int) -> tuple[np.ndarray, bool]:
    """(rows far from each other, whether there are blocks enough to place rows by their second nearest pivot, too).

    As many as there are blocks (PIVOTS at most): each is the farthest of a bounded sample from those before.
    """
    sample = np.array([tuple(r) for r in rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select(*features).collect()], float).reshape(-1, len(features))
    n = rows.count()
    most = min(PIVOTS, 1 + n // block, len(sample))
    if not most:
        return sample, False
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen], n > block * len(chosen) ** 2 // 2


def _from(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distance of each row of x to each of a few points."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in points], 1)


def _ringed(rows: DataFrame, features: Sequence[str], points: np.ndarray, twice: bool, block: int) -> DataFrame:
    """Blocks of at most about `block` rows that lie together: those nearest to one pivot (and next to another, if `twice`), in rings
    around it, and how near and far the block's rows are from each pivot. Rows at one distance from their pivot, such as copies,
    are dealt out by hash, as all are around a single pivot."""
    features = list(features)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[features].to_numpy(np.float64)
        d = _from(points, x)
        return pd.DataFrame({"g": [key[0]], "n": [len(x)], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "lo": [d.min(0)], "hi": [d.max(0)]})

    def blocks(rows: DataFrame, *by: str) -> DataFrame:
        return written(rows.groupBy("g", *by).applyInPandas(pack, _BLOCKS.replace("block long, ", "")).withColumn("block", F.monotonically_increasing_id()), "knn-blocks")

    if len(points) == 1:
        counts = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
        return blocks(rows.join(counts, "g").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))), "part")

    @F.pandas_udf("struct<cell: int, far: double>")
    def place(*cols: pd.Series) -> pd.DataFrame:
        d = _from(points, np.stack([c.to_numpy(float) for c in cols], 1)) if len(cols[0]) else np.zeros((0, len(points)))
        order = np.argsort(d, axis=1, kind="stable")
        cell = order[:, 0] * len(points) + (order[:, 1] if twice else 0)
        return pd.DataFrame({"cell": cell.astype("int32"), "far": d.min(1)})

    placed = written(rows.withColumn("p", place(*features)).select("*", "p.cell", "p.far").drop("p"), "knn-placed")
    size = placed.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi"))
    # Rings by a histogram of the distance: steps are joined until a block is full.
    step = F.least(F.floor(F.when(F.col("hi") > F.col("lo"), (F.col("far") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 4096).otherwise(0)), F.lit(4095)).cast("int")
    stepped = placed.join(size, ["g", "cell"]).withColumn("step", step)
    steps = stepped.groupBy("g", "cell", "step").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("g", "cell").orderBy("step")) - F.col("m")  # 4,096 rows a cell at most
    rings = steps.withColumn("ring", F.floor(before / block)).withColumn("parts", F.ceil(F.col("m") / block))
    ringed = stepped.drop("n", "lo", "hi").join(rings.select("g", "cell", "step", "ring", "parts"), ["g", "cell", "step"])
    ringed = ringed.withColumn("part", F.when(F.col("parts") > 1, F.struct("step", F.pmod(F.xxhash64("id"), F.col("parts")).alias("k"))))

    return blocks(ringed, "cell", "ring", "part")


def _apart(lo: str, hi: str, other_lo: str, other_hi: str) -> Column:
    """How far two blocks are from each other at least, by the triangle inequality at every pivot."""
    gaps = F.zip_with(F.arrays_zip(lo, hi), F.arrays_zip(other_lo, other_hi), lambda a, b: F.greatest(a[lo] - b[other_hi], b[other_lo] - a[hi], F.lit(0.0)))
    return F.array_max(gaps)


def block_pairs(left: DataFrame, right: DataFrame, salts: int = 16) -> DataFrame:
    """g, q_block, block, n, apart, offset of all pairs of a group's blocks, from their summaries alone.

    Pairs of summaries, not of rows; a group's are dealt out over `salts` tasks and more.
    """
    q = left.select("g", F.col("block").alias("q_block"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), F.pmod(F.col("block"), F.lit(salts)).cast("int").alias("salt"))
    k = right.select("g", "block", "n", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    middle = F.array_max(F.zip_with(F.zip_with("q_lo", "q_hi", lambda a, b: a + b), F.zip_with("lo", "hi", lambda a, b: a + b), lambda a, b: F.abs(a - b)))
    return q.join(k, ["g", "salt"]).select("g", "q_block", "block", "n", _apart("q_lo", "q_hi", "lo", "hi").alias("apart"), middle.alias("offset"))


#: Rows of a leaf of a block, and the most features by which leaves are told apart.
LEAF, FEW = 32, 4


def leaves(x: np.ndarray, size: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, lows, highs): rows halved along their widest feature until `size` are left, and the boxes of the parts."""
    order, todo, starts = np.arange(len(x)), [(0, len(x))], []
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            starts.append(a)
            continue
        part, m = order[a:b], (b - a) // 2
        rows = x[part]
        order[a:b] = part[np.argpartition(rows[:, (rows.max(0) - rows.min(0)).argmax()], m)]
        todo += [(a, a + m), (a + m, b)]
    starts = np.sort(starts)
    return order, starts, np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts)


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


def _nearest_by_leaves(qi: np.ndarray, q: np.ndarray, ki: np.ndarray, x: np.ndarray, k: int, skip_self: bool, bound: np.ndarray | None = None, scale: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k nearest of a block within the queries' bounds, ties by id; infinite where there are fewer.

    scale: squares are multiplied and divided by these before the root.
    """
    far, ids = np.full((len(qi), k), np.inf), np.zeros((len(qi), k), np.int64)
    some = [j for j in range(x.shape[1]) if j == 0 or x[:, j].any() or q[:, j].any()]
    x, q = x[:, some], q[:, some]
    order, starts, lo, hi = leaves(x)
    # A feature a row: sums over few features are sums of rows.
    x, ki, ends, lo, hi = x[order].T.copy(), ki[order], np.append(starts[1:], len(x)), lo.T.copy(), hi.T.copy()
    want = min(len(starts), 1 + 2 * -(-(k + 1) // LEAF))
    asked, first, qlo, qhi = leaves(q)

    def squares(own: np.ndarray, c: np.ndarray) -> np.ndarray:
        return sum((np.square(x[j, c] - q[own, j, None]) for j in range(len(x))), 0.0)

    for i, (a, b) in enumerate(zip(first, np.append(first[1:], len(q)), strict=True)):
        apart = sum((np.square(np.maximum(np.maximum(lo[j] - qhi[i, j], qlo[i, j] - hi[j]), 0.0)) for j in range(len(x))), 0.0)
        if bound is None:
            c = spans(*((e[np.argpartition(apart, want - 1)[:want]]) for e in (starts, ends)))
            d2 = squares(asked[a:b], c)
            limit = np.partition(d2, k, 1)[:, k].max() if len(c) > k else np.inf
        else:
            limit = bound[asked[a:b]].max() ** 2 * scale[1] / scale[0]
        at = apart <= limit * (1 + SLACK)
        c = spans(starts[at], ends[at])
        if not len(c):
            continue
        step = max(1, 1_000_000 // len(c))
        for own in (asked[s : min(s + step, b)] for s in range(a, b, step)):
            d = np.sqrt(squares(own, c) * scale[0] / scale[1])
            if skip_self:
                d[qi[own, None] == ki[c]] = np.inf
            most = np.partition(d, k - 1, 1)[:, k - 1, None] if len(c) > k else np.inf
            row, col = np.nonzero((d <= most) & np.isfinite(d) & (d <= (bound[own, None] if bound is not None else np.inf)))
            best = np.lexsort((ki[c[col]], d[row, col], row))
            row, col = row[best], col[best]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, rank = row[rank < k], col[rank < k], rank[rank < k]
            far[own[row], rank], ids[own[row], rank] = d[row, col], ki[c[col]]
    return far, ids


def _nearest_in(qi: np.ndarray, q: np.ndarray, ki: np.ndarray, x: np.ndarray, k: int, skip_self: bool, bound: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first query, distances, ids, whether there is one) of strips of queries: the k nearest of a block, ties by id.

    Rows of few features go by leaves, those of many by strips.
    """
    if not len(qi) or not len(ki):
        return
    if x.shape[1] <= FEW:
        far, ids = _nearest_by_leaves(qi, q, ki, x, k, skip_self, bound)
        yield 0, far, ids, np.isfinite(far)
        return
    norm = (x * x).sum(1)
    for lo in range(0, len(qi), STRIP):
        s = q[lo : lo + STRIP]
        d2 = np.maximum((s * s).sum(1)[:, None] + norm - 2 * s @ x.T, 0)
        if skip_self:
            d2[qi[lo : lo + STRIP, None] == ki] = np.inf
        m = min(k + 8, len(ki))
        near = np.argpartition(d2, m - 1, 1)[:, :m]
        # The strip's formula loses digits; the few that are kept are measured again.
        exact = np.sqrt(((x[near] - s[:, None]) ** 2).sum(2))
        exact[~np.isfinite(np.take_along_axis(d2, near, 1))] = np.inf
        order = np.lexsort((ki[near], exact), axis=1)[:, :k]
        exact, near = np.take_along_axis(exact, order, 1), np.take_along_axis(near, order, 1)
        if m < len(ki):  # more ties with the last than were kept, such as copies: all of them are measured
            last = exact[:, -1] ** 2 + 1e-11 * ((s * s).sum(1) + norm.max())
            for i in np.flatnonzero(np.isfinite(last) & ((d2 <= last[:, None]).sum(1) > m)).tolist():
                some = np.flatnonzero(d2[i] <= last[i])
                far = np.sqrt(((x[some] - s[i]) ** 2).sum(1))
                best = np.lexsort((ki[some], far))[:k]
                exact[i], near[i] = far[best], some[best]
        yield lo, exact, ki[near], np.isfinite(exact)


def nearest(queries: DataFrame, known: DataFrame, features: Sequence[str], k: int, query_id: str = "id", known_id: str = "id", group: str | None = None, skip_self: bool = True, block: int = BLOCK) -> DataFrame:
    """query, neighbour, distance, rank of the k nearest known rows (ties by id), within a group if one is named.

    Rows lie in blocks around pivots. Each block of queries first meets one block near it that can hold k neighbours, which
    bounds their distances; then only the blocks that may hold a nearer one, and there only the queries for which they may.
    Rows with a null feature are left aside.
    """
    features = list(features)
    kept = written(_complete(known, known_id, features, group), "knn-known")
    points, twice = pivots(kept, features, block)
    if not len(points):
        return kept.sparkSession.createDataFrame([], "query long, neighbour long, distance double, rank int")
    right = _ringed(kept, features, points, twice, block)
    same = queries is known and query_id == known_id
    left = right if same else _ringed(_complete(queries, query_id, features, group), features, points, twice, block)
    pairs = block_pairs(left, right)
    if len(points) > 1:
        pairs = written(pairs, "knn-pairs")
    able = pairs.where(F.col("n") > (k if skip_self else k - 1))
    home = able.groupBy("g", "q_block").agg(F.min_by("block", F.struct("apart", "offset", "block")).alias("block"))
    q_side = left.select("g", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    k_side = right.select("g", "block", "ids", "x", "lo", "hi")

    # A pair of blocks is a group, so that a task holds one and no batch of them.
    def first(pair: pd.DataFrame) -> pd.DataFrame:
        for r in pair.itertuples():
            qi, ki = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
            q, x = np.frombuffer(r.q_x).reshape(len(qi), -1), np.frombuffer(r.x).reshape(len(ki), -1)
            ids, far = np.zeros((len(qi), k), np.int64), np.full((len(qi), k), np.inf)
            for lo, d, i, ok in _nearest_in(qi, q, ki, x, k, skip_self):
                at = slice(lo, lo + len(d))
                ids[at, : i.shape[1]], far[at, : d.shape[1]] = i, np.where(ok, d, np.inf)
            bound = far[:, -1]
            return pd.DataFrame({"g": [r.g], "q_block": [r.q_block], "home": [r.block], "bound": [bound.tobytes()], "worst": [float(bound.max())], "near": [ids.tobytes()], "far": [far.tobytes()]})

    met = q_side.join(home, ["g", "q_block"]).join(k_side, ["g", "block"])
    bounds = written(met.select("g", "q_block", "block", "q_ids", "q_x", "ids", "x").groupBy("g", "q_block").applyInPandas(first, "g string, q_block long, home long, bound binary, worst double, near binary, far binary"), "knn-bounds")
    rest = visited(pairs, bounds)

    def again(pair: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "distance": np.zeros(0)})]
        for r in pair.itertuples():
            qi, ki = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
            q, x = np.frombuffer(r.q_x).reshape(len(qi), -1), np.frombuffer(r.x).reshape(len(ki), -1)
            bound = np.frombuffer(r.bound) if r.bound is not None else np.full(len(qi), np.inf)
            d = _from(points, q)
            apart = np.maximum(np.maximum(d - np.array(r.hi), np.array(r.lo) - d), 0).max(1)
            may = np.flatnonzero(apart <= bound * (1 + SLACK) + SLACK)
            for lo, far, i, ok in _nearest_in(qi[may], q[may], ki, x, k, skip_self, bound[may]):
                ok &= far <= bound[may[lo : lo + len(far)], None]
                found.append(pd.DataFrame({"query": np.repeat(qi[may[lo : lo + len(far)]], ok.sum(1)), "neighbour": i[ok], "distance": far[ok]}))
        return pd.concat(found)

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for batch in batches for r in batch.itertuples()):
            qi, far = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.far).reshape(-1, k)
            ok = np.isfinite(far)
            yield pd.DataFrame({"query": np.repeat(qi, ok.sum(1)), "neighbour": np.frombuffer(r.near, np.int64).reshape(-1, k)[ok], "distance": far[ok]})

    hit = "query long, neighbour long, distance double"
    more = rest.join(q_side, ["g", "q_block"]).join(k_side, ["g", "block"]).join(bounds.select("g", "q_block", "bound"), ["g", "q_block"], "left")
    more = more.select("g", "q_block", "block", "q_ids", "q_x", "ids", "x", "lo", "hi", "bound").groupBy("g", "q_block", "block").applyInPandas(again, hit)
    best = bounds.join(q_side.drop("q_x"), ["g", "q_block"]).select("q_ids", "near", "far").mapInPandas(unpacked, hit).unionByName(more)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour")))
    return ranked.where(F.col("rank") <= k)


#: What a bound by pivots may be off.
SLACK = 1e-9


def visited(pairs: DataFrame, bounds: DataFrame) -> DataFrame:
    """g, q_block, block of the pairs that are still to be met: not farther apart than the worst bound of the block's queries."""
    near = pairs.join(bounds.select("g", "q_block", "home", "worst"), ["g", "q_block"], "left")
    return near.where(F.col("worst").isNull() | ((F.col("block") != F.col("home")) & (F.col("apart") <= F.col("worst") * (1 + SLACK) + SLACK))).select("g", "q_block", "block")


#: Known rows and queries of a box, and rows that boxes are chosen from.
BOX, ASKED, BOX_SAMPLE = 50_000, 200_000, 20_000


class Boxes:
    """A group's space, halved along the widest feature of some of its rows: each place lies in one box."""

    def __init__(self, rows: np.ndarray, parts: int):
        self.cuts: list[tuple[int, float, int, int]] = []
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        wide = rows.shape[1]
        self.top = self._cut(rows, parts, np.full(wide, -np.inf), np.full(wide, np.inf))
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _cut(self, rows: np.ndarray, parts: int, lo: np.ndarray, hi: np.ndarray) -> int:
        """The number of a cut, or -1 less the number of a box."""
        spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(rows.shape[1])
        j = int(spread.argmax())
        if parts < 2 or not spread[j] > 0:
            self.lo.append(lo)
            self.hi.append(hi)
            return -len(self.lo)
        x = np.sort(rows[:, j])
        at = x[(len(x) - 1) * (parts // 2) // parts]
        at = float(at if at < x[-1] else x[x < x[-1]][-1])
        below, low, high = rows[:, j] <= at, lo.copy(), hi.copy()
        low[j] = high[j] = at
        left, right = self._cut(rows[below], parts // 2, lo, high), self._cut(rows[~below], parts - parts // 2, low, hi)
        self.cuts.append((j, at, left, right))
        return len(self.cuts) - 1

    def of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(self.top, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
                continue
            j, cut, left, right = self.cuts[node]
            below = x[at, j] <= cut
            todo += [(left, at[below]), (right, at[~below])]
        return out

    def near(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, box) of all boxes that are not farther than a row's reach."""
        found = []
        for lo in range(0, len(x), 1024):
            s = x[lo : lo + 1024, None]
            row, box = np.nonzero((np.maximum(np.maximum(self.lo - s, s - self.hi), 0) ** 2).sum(2) <= reach[lo : lo + 1024, None] ** 2)
            found.append((row + lo, box))
        return tuple(np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def nearest_in_boxes(queries: DataFrame, known: DataFrame, features: Sequence[str], k: int, scales: Mapping[str, tuple[float, float]], box: int = BOX) -> DataFrame:
    """query, neighbour, distance: known rows among which are the k nearest of the query's group, ties by neighbour, for few features.

    Space is cut into boxes by a bounded sample. A query meets the rows of its own box, and then those of other boxes that its
    k-th distance reaches: what is shuffled are rows, and few of them a second time. Columns: g, id, features, none of them null.
    scales: by group, what squared distances are multiplied and divided by before the root.
    """
    features = list(features)
    known, queries = written(known.select("g", "id", *features), "box-known"), queries.select("g", "id", *features)
    sizes = {r["g"]: r["count"] for r in known.groupBy("g").count().collect()}
    least = F.lit(BOX_SAMPLE / max(1, sum(sizes.values())) * 2.0**64 - 2.0**63)
    some = known.where(F.xxhash64("id", *features).cast("double") <= least).limit(2 * BOX_SAMPLE).toPandas()
    trees = {g: Boxes(some.loc[some["g"] == g, features].to_numpy(float), -(-n // box)) for g, n in sizes.items()}
    columns = ", ".join(f"`{f}` double" for f in features)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["box"] = np.int32(0)
            for g, rows in b.groupby("g").indices.items():
                if g in trees:
                    b.iloc[rows, -1] = trees[g].of(b[features].to_numpy(float)[rows])
            yield b

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, rows in b.groupby("g").indices.items():
                if g in trees:
                    own = b.iloc[rows]
                    reach = own["bound"].to_numpy(float) * (scales[g][1] / scales[g][0]) ** 0.5 * (1 + SLACK) + SLACK
                    row, to = trees[g].near(own[features].to_numpy(float), reach)
                    other = to != own["box"].to_numpy()[row]
                    yield own.iloc[row[other]].assign(box=to[other].astype("int32"))

    def meet(q: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        qi, ki = q["id"].to_numpy(np.int64), near["id"].to_numpy(np.int64)
        far, ids = np.full((len(qi), k), np.inf), np.zeros((len(qi), k), np.int64)
        if len(qi) and len(ki):
            bound = q["bound"].to_numpy(float) if "bound" in q else None
            far, ids = _nearest_by_leaves(qi, q[features].to_numpy(float), ki, near[features].to_numpy(float), k, False, bound, scales[q["g"].iloc[0]])
        return pd.DataFrame({c: q[c] for c in ("g", "id", *features, "box")} | {"bound": far[:, -1], "near": list(ids), "far": list(far)})

    there = written(known.mapInPandas(placed, f"g string, id long, {columns}, box int"), "box-rows")

    def met(q: DataFrame) -> DataFrame:
        parts = F.broadcast(q.groupBy("g", "box").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts")))  # a row a box
        left = q.join(parts, ["g", "box"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        right = there.join(parts, ["g", "box"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        both = left.groupBy("g", "box", "part").cogroup(right.groupBy("g", "box", "part"))
        return both.applyInPandas(meet, f"g string, id long, {columns}, box int, bound double, near array<long>, far array<double>")

    first = written(met(written(queries.mapInPandas(placed, f"g string, id long, {columns}, box int"), "box-asked")), "box-first")
    again = written(first.drop("near", "far").mapInPandas(routed, f"g string, id long, {columns}, box int, bound double"), "box-again")
    hits = first.select("id", "near", "far").unionByName(met(again).select("id", "near", "far"))
    return hits.select(F.col("id").alias("query"), F.explode(F.arrays_zip("near", "far")).alias("r")).select("query", F.col("r.near").alias("neighbour"), F.col("r.far").alias("distance")).where(F.col("distance") < float("inf"))


def dbscan_eps(points: DataFrame, features: Sequence[str], min_samples: int = 4, percentile: float = 0.90, id_column: str = "id") -> DataFrame:
    """One row, eps: the quantile of the distances to the (min_samples - 1)-th other point, positive ones only; then the
    95th, 90th, 75th percentile and the median, then the median of the features' spreads, then a thousandth. A single point has 0.5."""
    k = max(2, min_samples) - 1
    near = nearest(points, points, features, k, id_column, id_column)
    # With fewer points than asked for, the farthest there is.
    d = near.groupBy("query").agg(F.max_by("distance", "rank").alias("distance")).where("distance > 0")
    steps = [percentile, 0.95, 0.90, 0.75, 0.50]
    far = d.agg(*[F.percentile("distance", p).alias(f"p{i}") for i, p in enumerate(steps)])
    whole = points.dropna(subset=list(features)).agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)])
    spread = F.array_sort(F.array(*[F.col(f"s{i}") for i in range(len(features))]))
    middle = (F.get(spread, F.lit((len(features) - 1) // 2)) + F.get(spread, F.lit(len(features) // 2))) / 2.0
    eps = F.coalesce(*[F.when(F.col(f"p{i}") > 0, F.col(f"p{i}")) for i in range(len(steps))], F.when(middle > 0, middle), F.lit(1e-3))
    return far.crossJoin(whole).select(F.when(F.col("n") == 1, 0.5).when(F.col("n") > 1, eps).alias("eps"))  # one row each


def _of_analogs(rows: DataFrame, by: str, targets: Sequence[str]) -> DataFrame:
    cols = []
    for t in targets:
        q = F.percentile(t, F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84)))
        cols += [q[1].alias(f"{t}_median"), q[0].alias(f"{t}_q16"), q[2].alias(f"{t}_q84")]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_analogs"), *cols)


def analog_estimates(candidates: DataFrame, catalog: DataFrame, features: Sequence[str], targets: Sequence[str], k: int = 35, query_id: str = "id", known_id: str = "id", optional: Sequence[str] = ()) -> DataFrame:
    """Of each candidate's k nearest rows: number, median and the 16th and 84th percentile of each target.

    Candidates that have the optional features are compared with rows that have them, too; the others without them. Each
    pool is in units of its own spread. Candidates without the other features have no analogs and aren't returned.
    """
    optional = list(optional)
    lacks = " or ".join(f"`{f}` is null" for f in optional)
    pools = [([*features, *optional], candidates.where(f"not ({lacks})"))] if optional else []
    pools.append((list(features), candidates.where(lacks) if optional else candidates))
    parts = []
    for used, own in pools:
        sd = catalog.dropna(subset=used).agg(*[F.stddev_pop(f).alias(f"_sd_{f}") for f in used])

        def scaled(df: DataFrame, sd: DataFrame = sd, used: Sequence[str] = used) -> DataFrame:
            return df.join(F.broadcast(sd), how="cross").withColumns({f: F.col(f) / F.when(F.col(f"_sd_{f}") > 0, F.col(f"_sd_{f}")).otherwise(1.0) for f in used}).drop(*sd.columns)

        parts.append(nearest(scaled(own), scaled(catalog), used, k, query_id, known_id, skip_self=False))
    near = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = _of_analogs(near.join(catalog.select(F.col(known_id).alias("neighbour"), *targets), "neighbour"), "query", targets)
    known = sum((F.when(F.col(f"{t}_median").isNotNull(), 0.4 / len(targets)).otherwise(0.0) for t in targets), F.lit(0.0))
    return out.withColumnRenamed("query", query_id).withColumn("analog_support_score", F.least(0.6 * F.least(F.col("n_analogs") / k, F.lit(1.0)) + known, F.lit(1.0)))


def with_fallback(estimates: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Targets without analogs from their interpolation between both sides of the gap (columns interp_<target>, logarithms), and
    candidate_estimation_method: analog_neighbors, local_interpolation or hybrid."""
    used = {t: F.col(f"{t}_median").isNull() & F.col(f"interp_{t}").isNotNull() for t in targets}
    method = F.lit("analog_neighbors")
    for t in targets:
        method = F.when(used[t], F.when(method == "analog_neighbors", "local_interpolation").otherwise("hybrid")).otherwise(method)
    out = estimates.withColumn("candidate_estimation_method", method)
    return out.withColumns({f"{t}_{s}": F.when(used[t], F.pow(F.lit(10.0), F.col(f"interp_{t}"))).otherwise(F.col(f"{t}_{s}")) for t in targets for s in ("q16", "q84", "median")})


def analog_space(df: DataFrame, reference: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as they are compared: missing ones as the reference's median, then in units of its interquartile range after that."""
    middle = reference.agg(*[F.median(f).alias(f"_m_{f}") for f in features])
    filled = reference.join(F.broadcast(middle), how="cross").select(*[F.coalesce(F.col(f), F.col(f"_m_{f}")).alias(f) for f in features])
    ends = filled.agg(*[F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{f}") for f in features])
    out = df.join(F.broadcast(middle.crossJoin(ends)), how="cross")  # one row
    scale = {f: F.when(F.col(f"_q_{f}")[2] > F.col(f"_q_{f}")[0], F.col(f"_q_{f}")[2] - F.col(f"_q_{f}")[0]).otherwise(1.0) for f in features}
    return out.withColumns({f: (F.coalesce(F.col(f), F.col(f"_m_{f}")) - F.col(f"_q_{f}")[1]) / scale[f] for f in features}).drop(*middle.columns, *ends.columns)


def analog_neighbours(candidates: DataFrame, catalog: DataFrame, features: Sequence[str], targets: Sequence[str], k: int = 75, temperature: float = 1.0, query_id: str = "id", known_id: str = "id", least: int = 2) -> DataFrame:
    """query, neighbour, distance, rank, weight = exp(-d^2 / 2 t^2) and the neighbour's targets.

    Rows of the catalog with `least` known features and all targets are analogs; candidates are compared whatever they lack.
    """
    known = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in features), F.lit(0))
    pool = catalog.where(known >= least).dropna(subset=list(targets)) if targets else catalog.where(known >= least)
    near = nearest(analog_space(candidates, pool, features), analog_space(pool, pool, features), features, k, query_id, known_id, skip_self=False)
    near = near.withColumn("weight", F.exp(-F.col("distance") * F.col("distance") / (2.0 * max(temperature, 1e-6) ** 2)))
    return near.join(pool.select(F.col(known_id).alias("neighbour"), *targets), "neighbour")


def weighted_analogs(candidates: DataFrame, catalog: DataFrame, features: Sequence[str], targets: Sequence[str], k: int = 75, temperature: float = 1.0, quantiles: Sequence[float] = (0.05, 0.5, 0.95), query_id: str = "id", known_id: str = "id", classes: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """Each candidate's analogs in summary: how many and how near, weighted quantiles of each target, and with `classes` (a column of
    the catalog and its values) the weight of each class among them."""
    from orrerium.functions.stats import weighted_quantiles

    extra = [classes[0]] if classes and classes[0] not in targets else []
    pool = catalog.withColumn("_c", F.coalesce(F.col(extra[0]).cast("string"), F.lit(""))).drop(*extra) if extra else catalog
    rows = written(analog_neighbours(candidates, pool, features, [*targets, *(["_c"] if extra else [])], k, temperature, query_id, known_id), "analogs")
    kinds = [F.coalesce(F.try_divide(F.sum(F.when(F.col("_c") == c, F.col("weight")).otherwise(0.0)), F.sum("weight")), F.lit(0.0)).alias(f"analog_prob_{c}") for c in classes[1]] if extra else []
    out = rows.groupBy("query").agg(F.count(F.lit(1)).alias("n_analogs"), F.min("distance").alias("nearest_distance"), F.median("distance").alias("median_distance"), *kinds)
    for t in targets:
        q = weighted_quantiles(rows, ["query"], t, "weight", list(quantiles))
        out = out.join(q.withColumnsRenamed({c: f"{t}_{c}" for c in q.columns if c != "query"}), "query", "left")
    return out.withColumnRenamed("query", query_id)
