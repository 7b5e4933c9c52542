"""Many graph files at once, and membership from whichever source has it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerium.operators.graph import graph_metrics
from orrerium.sources.tables import NODE_NAMES, exists, in_lines, member_lists, read_table, standardise, written

_GRAPH = "nodes map<string,array<long>>, links map<string,array<string>>, sample_id_lookup array<long>, _bad string"


def graph_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, config_id, nodes, links, lookup, error: every graph file of a pattern, one scan, a row each; damaged files are rows with
    an error. The configuration is in the file's name (graph_<id>.json) or folder (config_id=<id>).

    By a .jsonl pattern lines are pieces of graphs (tables.graph_lines), a row each: a piece may have links alone, whose nodes aren't checked here.
    """
    whole = not in_lines(pattern)
    path = F.col("_metadata.file_path")
    name = F.coalesce(*[F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in (r"graph_([^/]+)\.json$", r"config_id=([^/]+)/")])
    rows = spark.read.text(pattern, wholetext=whole).select(path.alias("path"), name.alias("config_id"), "value")
    g = F.from_json("value", _GRAPH, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("g", g).withColumn("json", F.get_json_object("value", "$").isNotNull()).select("path", "config_id", "json", "g.nodes", F.coalesce("g.links", F.create_map().cast("map<string,array<string>>")).alias("links"), F.col("g.sample_id_lookup").alias("lookup"), F.col("g._bad").alias("bad"))
    at = F.flatten(F.map_values("nodes"))
    # No column of the document within a lambda: it would be parsed once for each position.
    outside = F.exists(at, lambda x: x.isNull()) | F.coalesce(F.array_min(at) < 0, F.lit(False)) | F.coalesce(F.array_max(at) >= F.size("lookup"), F.lit(False))
    named = F.array_distinct(F.concat(F.map_keys("links"), F.flatten(F.map_values("links"))))
    stray = F.size(F.array_except(named, F.map_keys("nodes"))) > 0
    error = F.when(~F.col("json"), "unreadable JSON").when(F.col("nodes").isNull() & (F.lit(whole) | (F.size("links") == 0)), "no nodes").when(F.col("bad").isNotNull(), "nodes, links or lookup of another shape").when(outside, "position out of bounds").when(F.lit(whole) & stray, "link to an unknown node")
    return rows.withColumn("error", error).select("path", "config_id", "nodes", "links", "lookup", "error")


def _members(files: DataFrame, *keep: str) -> DataFrame:
    rows = files.where("error is null").select(*keep, "lookup", F.explode("nodes").alias("node_id", "at")).withColumn("at", F.explode("at"))
    return rows.select(*keep, "node_id", F.when(F.col("lookup").isNull(), F.col("at")).otherwise(F.get("lookup", F.col("at").cast("int"))).alias("row_index"))


def graph_catalog(spark: SparkSession, pattern: str, manifest: DataFrame | None = None) -> DataFrame:
    """Every graph file and every configuration that the manifest lists: path, config_id, found, listed, error, n_members and the
    metrics of the graph, worked out anew for all files together. Of damaged and missing files they are null.

    manifest: config_id and any other columns. Files of one configuration in several places are rows of their own.
    """
    files = written(graph_files(spark, pattern), "graph-files")
    members = written(_members(files, "path").withColumnRenamed("path", "config_id"), "catalog-members")
    links = files.where("error is null").select(F.col("path").alias("config_id"), F.explode("links").alias("source", "t")).select("config_id", "source", F.explode("t").alias("target"))
    nodes = files.where("error is null").select(F.col("path").alias("config_id"), F.explode(F.map_keys("nodes")).alias("node_id"))
    size = members.groupBy("config_id").agg(F.count_distinct("row_index").alias("n_members"))
    metrics = graph_metrics(nodes, links).join(size, "config_id", "left").na.fill(0, ["n_members"]).withColumnRenamed("config_id", "path")
    out = files.select("path", "config_id", "error").join(metrics, "path", "left").withColumn("found", F.lit(True))
    if manifest is None:
        return out.withColumn("listed", F.lit(None).cast("boolean"))
    listed = manifest.where("config_id is not null").select(F.col("config_id").cast("string")).distinct().withColumn("listed", F.lit(True))
    out = out.join(listed, "config_id", "full_outer").na.fill(False, ["found", "listed"])
    return out.withColumn("error", F.when(~F.col("found"), "missing").otherwise(F.col("error")))


@dataclass(frozen=True)
class MemberSource:
    """Where membership may be: a table of memberships, a partial one (which may lack nodes), a graph file, or a node table with lists."""

    kind: str
    path: str

    def __post_init__(self) -> None:
        if self.kind not in ("table", "partial", "graph", "lists"):
            raise ValueError(f"unknown kind of source {self.kind!r}")


def _read(spark: SparkSession, source: MemberSource, config_id: str) -> DataFrame:
    """config_id, node_id, row_index of a source."""
    if source.kind == "graph":
        files = graph_files(spark, source.path)
        wrong = files.where("error is not null").select("path", "error").first()
        if wrong:
            raise ValueError(f"membership cannot be recovered from {wrong.path}: {wrong.error}")
        if in_lines(source.path):
            named = files.select(F.explode("links").alias("a", "bs")).select(F.explode(F.concat(F.array("a"), "bs")).alias("node")).distinct()
            lost = named.join(files.select(F.explode(F.map_keys("nodes")).alias("node")).distinct(), "node", "left_anti").first()
            if lost:
                raise ValueError(f"membership cannot be recovered from {source.path}: link to an unknown node")
        return _members(files).select(F.lit(config_id).alias("config_id"), "node_id", "row_index")
    df = standardise(read_table(spark, source.path), {"node_id": NODE_NAMES})
    if "config_id" in df.columns:
        df = df.where(F.col("config_id") == config_id)
    rows = member_lists(df) if source.kind == "lists" else df
    return rows.select(F.lit(config_id).alias("config_id"), F.col("node_id").cast("string").alias("node_id"), F.col("row_index").cast("long").alias("row_index"))


def resolve_membership(spark: SparkSession, config_id: str, sources: Sequence[MemberSource], catalog: DataFrame | None = None, strict: bool = True) -> tuple[DataFrame, list[str]]:
    """(config_id, node_id, row_index, source, path and with a catalogue in_catalog; warnings) of the first source, in order, that has
    members of the configuration. Later ones aren't read.

    Rows that the catalogue (of row_index) doesn't have are an error, or are marked if not `strict`; so are null rows.
    """
    tried, warnings = [], []
    for source in sources:
        tried.append(source.path)
        if not exists(spark, source.path):
            continue
        rows = _read(spark, source, config_id)
        if rows.isEmpty():
            warnings.append(f"{source.path} has no members of {config_id}")
            continue
        if source.kind == "partial":
            warnings.append(f"{source.path} may not have all nodes of {config_id}")
        elif source.kind in ("graph", "lists"):
            warnings.append(f"members of {config_id} are rebuilt from {source.path}")
        rows = rows.withColumns({"source": F.lit(source.kind), "path": F.lit(source.path)})
        if catalog is not None:
            rows = _checked(rows, catalog, source.path, strict)
        return rows, warnings
    raise FileNotFoundError(f"no members of {config_id}; tried {', '.join(tried) or 'nothing'}")


def _checked(rows: DataFrame, catalog: DataFrame, path: str, strict: bool) -> DataFrame:
    known = catalog.select(F.col("row_index").cast("long")).distinct().withColumn("in_catalog", F.lit(True))
    rows = rows.join(known, "row_index", "left").withColumn("in_catalog", F.coalesce("in_catalog", F.lit(False)))
    if strict:
        bad = rows.where(~F.col("in_catalog")).agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first")).first()
        if bad.n:
            raise ValueError(f"{bad.n} members in {path} aren't in the catalogue, the first of them row {bad.first}")
    return rows.select("config_id", "node_id", "row_index", "source", "path", "in_catalog")
