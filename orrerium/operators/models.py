"""Quantile forests and class models of member properties, and their validation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrerium.operators.impute import robust_scale, robust_stats

TREES, LEAF, CLASS_TREES = 96, 3, 180
LEAST_ROWS = 30


def training_rows(df: DataFrame, features: Sequence[str], target: str, least: int = 2) -> DataFrame:
    """Rows with a target and at least `least` known features."""
    known = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in features), F.lit(0))
    return df.where(F.col(target).isNotNull() & (known >= least))


def prepared(df: DataFrame, features: Sequence[str], reference: DataFrame | None = None) -> DataFrame:
    """Features filled with medians and scaled by the reference's median and spread, assembled in `features`."""
    ref = reference if reference is not None else df
    stats = robust_stats(ref, features)
    scaled = robust_scale(df, features, stats).na.fill(0.0, list(features))  # the median is 0 after scaling
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(scaled)


@dataclass
class QuantileForest:
    """A regression forest whose quantiles are those of its trees' predictions."""

    model: RandomForestRegressionModel
    quantiles: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, target: str, quantiles: Sequence[float] = (0.05, 0.5, 0.95), seed: int = 42) -> QuantileForest:
        forest = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=TREES, minInstancesPerNode=LEAF, featureSubsetStrategy="sqrt", seed=seed, maxDepth=12)
        return cls(forest.fit(df), tuple(quantiles))

    def predict(self, df: DataFrame, prefix: str) -> DataFrame:
        """<prefix>_q05 and so on; never crossing, as they are order statistics of one sample. Trees are walked in numpy over Arrow batches."""
        trees = df.sparkSession.sparkContext.broadcast([_flat(t) for t in self.model.trees])  # size set by depth and number of trees
        qs = self.quantiles

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for xs in batches:
                x = np.array(xs.to_list(), float).reshape(len(xs), -1)
                each = np.stack([_walk(t, x) for t in trees.value])
                yield pd.Series(list(np.quantile(each, qs, axis=0).T)) if len(xs) else pd.Series([], dtype=object)

        out = df.withColumn("_q", run(vector_to_array("features")))
        return out.withColumns({f"{prefix}_q{round(q * 100):02d}": F.col("_q")[k] for k, q in enumerate(qs)}).drop("_q")


def _flat(tree) -> tuple[np.ndarray, ...]:
    """A tree as arrays: feature (-1 at leaves), threshold, left, right, value."""
    rows: list[list[float]] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        if node.numDescendants():
            rows[at][:2] = [node.split().featureIndex(), node.split().threshold()]
            rows[at][2] = add(node.leftChild())
            rows[at][3] = add(node.rightChild())
        return at

    add(tree._call_java("rootNode"))
    a = np.array(rows, float)
    return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]


def _walk(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, value = tree
    at = np.zeros(len(x), int)
    while True:
        go = np.flatnonzero(feature[at] >= 0)
        if not len(go):
            return value[at]
        n = at[go]
        at[go] = np.where(x[go, feature[n]] <= threshold[n], left[n], right[n])


def class_model(train: DataFrame, target: str, seed: int = 42):
    """(model, classes): a forest with classes weighted by their rarity."""
    counts = train.groupBy(target).agg(F.count(F.lit(1)).alias("c"))
    total = train.count()
    k = counts.count()
    indexer = StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    weighted = indexer.transform(train).join(F.broadcast(counts.withColumn("_w", total / (k * F.col("c"))).drop("c")), target)
    return RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol="_w", numTrees=CLASS_TREES, seed=seed).fit(weighted), list(indexer.labels)


def predict_classes(model, classes: Sequence[str], df: DataFrame, every: Sequence[str] | None = None) -> DataFrame:
    """prob_<class> columns (0 for classes that the training rows lack)."""
    out = model.transform(df).withColumn("_p", vector_to_array("probability"))
    cols = {f"prob_{c}": F.col("_p")[classes.index(c)] if c in classes else F.lit(0.0) for c in (every or classes)}
    return out.withColumns(cols).drop("_p", "probability", "rawPrediction", "prediction")


def split(df: DataFrame, mode: str = "random", share: float = 0.2, seed: int = 42, id_column: str = "row_index", host: str = "hostname", year: str = "disc_year") -> tuple[DataFrame, DataFrame]:
    """(train, test): at random by a hash of the id, the latest years, or one member of each system of several."""
    h = F.xxhash64(F.lit(seed), F.col(id_column))
    if mode == "random":
        cut = F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))
        return df.where(~cut), df.where(cut)
    if mode == "temporal":
        at = df.agg(F.percentile(F.col(year).cast("double"), 1 - share)).first()[0]
        late = F.coalesce(F.col(year) > at, F.lit(False))
        return df.where(~late), df.where(late)
    if mode == "multiplanet":
        w = Window.partitionBy(host)
        marked = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(h, id_column))})
        held = (F.col("_n") > 1) & (F.col("_r") == 1) & F.col(host).isNotNull()
        return marked.where(~held).drop("_n", "_r"), marked.where(held).drop("_n", "_r")
    raise ValueError(f"unknown mode {mode!r}")


def coverage(df: DataFrame, truth: str, low: str, high: str) -> DataFrame:
    """Share of truths inside their interval, and its mean width."""
    return df.agg(F.avg(F.col(truth).between(F.col(low), F.col(high)).cast("double")).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("mean_width"))


