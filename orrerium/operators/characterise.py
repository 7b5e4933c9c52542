"""Characterisation of hypothetical members: models of size and mass fitted on a catalogue, their predictions, and how good they are."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerium.functions import labels, physics
from orrerium.operators import knn, models, priors
from orrerium.sources.tables import exists, write_json, written

#: What can be known of a member before its size and mass are predicted, and the size classes.
FEATURES = ("log_pl_orbper", "log_pl_orbsmax", "log_pl_insol", "pl_eqt", "st_mass", "st_rad", "st_teff", "st_lum", "st_met", "st_logg", "sy_dist", "sy_pnum", "log_gap_ratio_inner", "log_gap_ratio_outer", "log_gap_width")
SIZE_CLASSES = ("rocky_size", "super_earth_size", "sub_neptune_size", "neptune_sub_jovian_size", "jovian_size")
QUANTILES = (0.05, 0.16, 0.5, 0.84, 0.95)


@dataclass
class Trained:
    """Forests of the logarithms of radius and mass and of the size class, over one set of features with its own fill and scale."""

    radius: models.QuantileForest
    mass: models.QuantileForest
    classes: RandomForestClassificationModel
    class_names: list[str]
    features: list[str]
    reference: DataFrame
    counts: dict[str, int] = field(default_factory=dict)

    def save(self, path: str) -> None:
        """The forests, the reference rows and a JSON document in a folder of any file system."""
        self.radius.model.write().overwrite().save(f"{path}/radius")
        self.mass.model.write().overwrite().save(f"{path}/mass")
        self.classes.write().overwrite().save(f"{path}/classes")
        self.reference.write.mode("overwrite").parquet(f"{path}/reference")
        about = {"features": self.features, "class_names": self.class_names, "quantiles": list(self.radius.quantiles), "counts": self.counts}
        write_json(self.reference.sparkSession, about, f"{path}/about.json")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trained:
        if not exists(spark, f"{path}/about.json"):
            raise FileNotFoundError(f"no models in {path}")
        about = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/about.json", wholetext=True).collect()))  # one document
        q = tuple(about["quantiles"])
        forests = [models.QuantileForest(RandomForestRegressionModel.load(f"{path}/{n}"), q) for n in ("radius", "mass")]
        return cls(*forests, RandomForestClassificationModel.load(f"{path}/classes"), about["class_names"], about["features"], spark.read.parquet(f"{path}/reference"), about["counts"])


def usable(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features that any row knows: one pass."""
    have = [f for f in features if f in df.columns]
    got = df.agg(*[F.count(f).alias(f) for f in have]).first().asDict() if have else {}
    return [f for f in have if got[f]]


def train(catalog: DataFrame, features: Sequence[str] = FEATURES, quantiles: Sequence[float] = QUANTILES, seed: int = 42) -> Trained:
    """Models of log radius, log mass and size class from rows with a target and two known features; fewer than 30 rows raise."""
    rows = written(priors.engineered(catalog), "characterise-rows")
    radius = models.training_rows(rows, [f for f in features if f in rows.columns], "log_pl_rade")
    used = usable(radius, features)
    mass = models.training_rows(rows, used, "log_pl_bmasse")
    used = [f for f in used if f in usable(mass, used)]
    counts = {"radius": radius.count(), "mass": mass.count()}
    if min(counts.values()) < models.LEAST_ROWS or not used:
        raise ValueError(f"not enough rows to fit on: {counts}, features {used}")
    reference = written(radius.select(*used), "characterise-reference")
    ready = {n: models.prepared(df, used, reference) for n, df in (("radius", radius), ("mass", mass))}
    classed = ready["radius"].withColumn("size_class", labels.size_class("pl_rade"))
    classifier, names = models.class_model(classed.where("size_class <> 'unknown'"), "size_class", seed)
    return Trained(models.QuantileForest.fit(ready["radius"], "log_pl_rade", quantiles, seed), models.QuantileForest.fit(ready["mass"], "log_pl_bmasse", quantiles, seed), classifier, names, used, reference, counts)


def predict(candidates: DataFrame, fitted: Trained, catalog: DataFrame | None = None, analogs: int = 75, id_column: str = "candidate_id", known_id: str = "row_index") -> DataFrame:
    """Each candidate with quantiles of radius, mass and density, class probabilities, the likeliest class, observables at the median,
    and with a catalogue (of whole-number ids) what its nearest analogs say. Densities pair quantiles of equal rank."""
    rows = priors.engineered(candidates)
    rows = rows.withColumns({f: F.lit(None).cast("double") for f in fitted.features if f not in rows.columns})
    out = models.prepared(rows, fitted.features, fitted.reference)
    # The scaled features stand in the way of the plain ones.
    out = out.drop(*[f for f in fitted.features if f != id_column]).join(rows.select(id_column, *[f for f in fitted.features if f != id_column]), id_column)
    out = fitted.mass.predict(fitted.radius.predict(out, "log_pl_rade"), "log_pl_bmasse")
    tags = [f"q{round(q * 100):02d}" for q in fitted.radius.quantiles]
    for t in ("pl_rade", "pl_bmasse"):
        out = out.withColumns({f"{t}_{q}": F.pow(F.lit(10.0), F.col(f"log_{t}_{q}")) for q in tags}).drop(*[f"log_{t}_{q}" for q in tags])
    out = out.withColumns({f"pl_dens_{q}": physics.density(F.col(f"pl_bmasse_{q}"), F.col(f"pl_rade_{q}")) for q in tags})
    out = models.predict_classes(fitted.classes, fitted.class_names, out, SIZE_CLASSES).drop("features", "_y")
    out = out.withColumns({"predicted_radius_class": labels.most_probable({c: F.col(f"prob_{c}") for c in SIZE_CLASSES}), "predicted_radius_class_probability": F.greatest(*[F.col(f"prob_{c}") for c in SIZE_CLASSES])})
    out = out.withColumns({"orbit_class": labels.period_class("pl_orbper") if "pl_orbper" in out.columns else F.lit("unknown"), "thermal_class": labels.temperature_class("pl_eqt") if "pl_eqt" in out.columns else F.lit("unknown")})
    if catalog is None:
        return out
    known = priors.engineered(catalog).withColumn("size_class", labels.size_class("pl_rade"))
    near = knn.weighted_analogs(rows, known, fitted.features, ["pl_rade", "pl_bmasse"], analogs, query_id=id_column, known_id=known_id, classes=("size_class", SIZE_CLASSES))
    return out.join(near.withColumnsRenamed({c: f"analog_{c}" for c in near.columns if c != id_column and not c.startswith("analog_")}), id_column, "left")


def validate(catalog: DataFrame, mode: str = "random", share: float = 0.2, features: Sequence[str] = FEATURES, seed: int = 42, id_column: str = "row_index") -> DataFrame:
    """target, mode, n_test, n_train, n_features, mae, coverage (of the outer quantiles) or accuracy, on members that were held out."""
    known, held = models.split(catalog, mode, share, seed, id_column)
    fitted = train(known, features, seed=seed)
    truth = held.select(F.col(id_column).alias("candidate_id"), F.col("pl_rade").alias("_r"), F.col("pl_bmasse").alias("_m"))
    rows = written(predict(held.drop("candidate_id").withColumnRenamed(id_column, "candidate_id"), fitted).join(truth, "candidate_id"), "characterise-held")
    low, high = (f"q{round(q * 100):02d}" for q in (fitted.radius.quantiles[0], fitted.radius.quantiles[-1]))
    parts = []
    for target, truth_column in (("pl_rade", "_r"), ("pl_bmasse", "_m")):
        inside = F.col(truth_column).between(F.col(f"{target}_{low}"), F.col(f"{target}_{high}")).cast("double")
        parts.append(rows.agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(F.col(truth_column) - F.col(f"{target}_q50"))).alias("mae"), F.avg(inside).alias("coverage"), F.lit(None).cast("double").alias("accuracy")).withColumn("target", F.lit(target)))
    same = (labels.size_class("_r") == F.col("predicted_radius_class")).cast("double")
    none = F.lit(None).cast("double")
    parts.append(rows.agg(F.count(F.lit(1)).alias("n_test"), none.alias("mae"), none.alias("coverage"), F.avg(same).alias("accuracy")).withColumn("target", F.lit("radius_class")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("target", F.lit(mode).alias("mode"), "n_test", F.lit(fitted.counts["radius"]).alias("n_train"), F.lit(len(fitted.features)).alias("n_features"), "mae", "coverage", "accuracy")


def ablation(catalog: DataFrame, experiments: dict[str, Sequence[str]], mode: str = "multiplanet", seed: int = 42, id_column: str = "row_index") -> DataFrame:
    """The validation of each named set of features; one that can't be fitted is a row with a warning."""
    spark = catalog.sparkSession
    out = None
    for name, features in experiments.items():
        try:
            rows = validate(catalog, mode, features=features, seed=seed, id_column=id_column).withColumn("warning", F.lit(""))
        except ValueError as e:
            schema = "target string, mode string, n_test long, n_train int, n_features int, mae double, coverage double, accuracy double, warning string"
            rows = spark.createDataFrame([("", mode, 0, 0, 0, None, None, None, f"{name}: {e}")], schema)
        rows = rows.select(F.lit(name).alias("experiment"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out
