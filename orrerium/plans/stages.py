"""The engine's stages in order, on the tables of a context, and the configuration that they read.

A stage takes `catalog` (and what earlier stages made) from the context and returns tables by name. All are lazy: what no one reads
or writes isn't computed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerium.operators import bias, characterise, gaps, graph, impute, knn, mapper, nodes, profile, regions
from orrerium.plans.registry import Context, Pipeline, Registry, merged, override
from orrerium.sources.tables import exists, find, inventory, written

#: What a run does unless a file or an override says otherwise.
DEFAULTS: dict = {
    "inputs": {},
    "features": ["pl_rade", "pl_bmasse", "pl_orbper"],
    "groups": {"physical": ["pl_rade", "pl_bmasse", "pl_dens"], "orbital": ["pl_orbper", "pl_orbsmax"]},
    "label": "discoverymethod",
    "imputation": {"method": "median"},
    "mapper": {"space": "orbital", "lens": "pca2", "n_cubes": 10, "overlap": 0.35, "min_samples": 4},
    "characterisation": {"mode": "random", "features": ["log_pl_orbper", "st_mass", "pl_eqt"]},
    "stages": {},
    "fail_fast": True,
    "dry_run": False,
}
#: Kinds of artifacts by their path's ending.
KINDS = {"table": (".csv", ".tsv", ".parquet", ".xlsx"), "figure": (".png", ".jpg", ".jpeg", ".pdf", ".svg", ".html"), "model": (".joblib", ".pkl", ".pickle"), "report": (".md", ".tex")}


def artifact_kind(path: str) -> str:
    p = PurePosixPath(path)
    end = p.suffix.lower()
    if end in (".yaml", ".yml", ".json"):
        return "config" if "config" in p.name else "manifest"
    return next((k for k, ends in KINDS.items() if end in ends), "other")


def artifacts(spark: SparkSession, pattern: str, stage: str) -> DataFrame:
    """stage, path, kind of all files that a glob matches; none of them is read."""
    return spark.createDataFrame([(stage, p, artifact_kind(p)) for p in find(spark, pattern)], "stage string, path string, kind string")


def load_config(spark: SparkSession, paths: Sequence[str] = (), overrides: Sequence[str] = ()) -> dict:
    """The defaults, then JSON documents in order, then overrides such as mapper.n_cubes=5. A path that isn't there raises."""
    out = DEFAULTS
    for p in paths:
        if not exists(spark, p):
            raise FileNotFoundError(p)
        out = merged(out, json.loads("\n".join(r.value for r in spark.read.text(p, wholetext=True).collect())))  # one document
    return merged(out, *[override(o) for o in overrides])


def enabled(config: dict, names: Sequence[str]) -> list[str]:
    """Stages that the configuration doesn't switch off."""
    return [n for n in names if config.get("stages", {}).get(n, {}).get("enabled", True)]


def data_audit(ctx: Context) -> dict[str, DataFrame]:
    out = {"column_profile": profile.column_profile(ctx.tables["catalog"], exact=False)}
    if ctx.config["inputs"]:
        out["input_inventory"] = inventory(ctx.spark, ctx.config["inputs"])
    return out


def feature_audit(ctx: Context) -> dict[str, DataFrame]:
    registry = Registry.of(ctx.config["groups"])
    audit = registry.audit(ctx.tables["catalog"])
    return {"feature_audit": audit, "feature_audit_summary": Registry.audit_summary(audit)}


def imputation(ctx: Context) -> dict[str, DataFrame]:
    features = [f for f in ctx.config["features"] if f in ctx.tables["catalog"].columns]
    filled = impute.impute(ctx.tables["catalog"], features, ctx.config["imputation"]["method"])
    return {"imputed": written(filled, "stage-imputed"), "missingness": impute.missingness(ctx.tables["catalog"], features)}


def mapper_graph(ctx: Context) -> dict[str, DataFrame]:
    points = ctx.tables.get("imputed", ctx.tables["catalog"])
    features = [f for f in ctx.config["features"] if f in points.columns]
    points = impute.robust_scale(points.dropna(subset=features), features)
    settings = mapper.Config(**ctx.config["mapper"])
    eps = knn.dbscan_eps(points, features, settings.min_samples, id_column="row_index").first()[0]
    members, edges = mapper.build(points, features, eps or 1e-3, settings)
    label = ctx.config["label"]
    members = members.join(ctx.tables["catalog"].select("row_index", label), "row_index", "left") if label not in members.columns else members
    members, edges = written(members, "stage-members"), written(edges, "stage-edges")
    return {"membership": members, "edges": edges, "node_table": nodes.node_table(members, edges, features)}


def audit_bias(ctx: Context) -> dict[str, DataFrame]:
    members, edges, label = ctx.tables["membership"], ctx.tables["edges"], ctx.config["label"]
    metrics = bias.node_metrics(members, label)
    scored = metrics.select("config_id", "node_id", "n_members", F.col("purity").alias("top_method_fraction"), F.col("entropy_norm").alias("method_entropy_norm")).join(regions.node_profiles(members, edges, label), ["config_id", "node_id"], "left")
    return {"node_bias": metrics, "global_bias": bias.global_metrics(bias.label_counts(members, label), ["config_id"], label, edges), "shadow": regions.shadow_classes(regions.shadow_scores(scored)), "components": graph.component_stats(members.select("config_id", "node_id").distinct(), edges)}


def system_gaps(ctx: Context) -> dict[str, DataFrame]:
    found = gaps.candidate_gaps(ctx.tables["catalog"])
    return {"gaps": found, "candidates": gaps.expand(found), "gap_validation": gaps.recall(gaps.leave_one_out(ctx.tables["catalog"]))}


def characterisation(ctx: Context) -> dict[str, DataFrame]:
    c = ctx.config["characterisation"]
    return {"validation_metrics": characterise.validate(ctx.tables["catalog"], c["mode"], features=c["features"])}


def reporting(ctx: Context) -> dict[str, DataFrame]:
    """What each stage made, by name."""
    rows = [(name, len(df.columns)) for name, df in sorted(ctx.tables.items())]
    return {"tables": ctx.spark.createDataFrame(rows, "name string, n_columns int")}


def standard() -> Pipeline:
    p = Pipeline()
    for name, stage in {"data_audit": data_audit, "feature_audit": feature_audit, "imputation": imputation, "mapper": mapper_graph, "observational_bias": audit_bias, "system_missing_planets": system_gaps, "candidate_characterization": characterisation, "reporting": reporting}.items():
        p.stage(name)(stage)
    return p


def run(spark: SparkSession, catalog: DataFrame, config: dict | None = None, wanted: str | Sequence[str] | None = None) -> Context:
    """All stages that the configuration leaves on (or those asked for), on a catalogue with row_index."""
    ctx = Context(spark, merged(DEFAULTS, config or {}), {"catalog": catalog})
    p = standard()
    return p.run(ctx, wanted or enabled(ctx.config, list(p.stages)))
