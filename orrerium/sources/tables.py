"""Readers, writers and path discovery for catalogues, graphs and result tables.

Paths go through Spark or its file systems only, so any store that Spark reads will do.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where it is unset, one of our own on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="orrerium-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: cuts lineage, outlives executors. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session has ended: the folder's owner clears it
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of floating columns as null."""
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")})


def read_catalog(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV with # comment lines and a header. Without a schema all is read once more to infer one."""
    reader = spark.read.option("header", True).option("comment", "#").option("nullValue", "").option("nanValue", "NaN").option("multiLine", False)
    return nan_to_null((reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path))


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet, CSV or JSON by the path's suffix: .json files are one document each, .jsonl and .ndjson have one a line."""
    kind = re.sub(r"[/*]+$", "", path).rpartition(".")[2].lower()
    if kind in ("json", "jsonl", "ndjson"):
        reader = spark.read.option("multiLine", kind == "json")
        return (reader.schema(schema) if schema is not None else reader).json(path)
    if kind in ("csv", "tsv", "txt"):
        return read_catalog(spark, path, schema)
    return nan_to_null((spark.read.schema(schema) if schema is not None else spark.read).parquet(path))


def column_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """column, description: from header lines like `# COLUMN name: text`."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^#\s*COLUMN\s+"))
    return lines.select(F.regexp_extract("value", r"^#\s*COLUMN\s+([^:\s]+)\s*:", 1).alias("column"), F.trim(F.regexp_extract("value", r":\s*(.*)$", 1)).alias("description")).where("column <> ''")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def first_existing(spark: SparkSession, paths: Sequence[str], required: bool = True) -> str | None:
    for p in paths:
        if exists(spark, p):
            return p
    if required:
        raise FileNotFoundError(f"none of {list(paths)} exists")
    return None


def find(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of a glob, sorted."""
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))


def latest(spark: SparkSession, pattern: str, explicit: str | None = None) -> str:
    """The explicit path, or the last of the sorted glob."""
    if explicit:
        return first_existing(spark, [explicit])
    found = find(spark, pattern)
    if not found:
        raise FileNotFoundError(f"nothing matches {pattern}")
    return found[-1]


def read_optional(spark: SparkSession, path: str | None, schema: StructType | str) -> DataFrame:
    """The table, or an empty one of the schema."""
    return read_table(spark, path, schema) if path and exists(spark, path) else spark.createDataFrame([], schema)


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(gone)}")
    return df


def snake(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip()).lower()).strip("_")


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


def resolve_column(df: DataFrame, aliases: Sequence[str]) -> str | None:
    """The first of the aliases that the table has, whatever the case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[a.lower()] for a in aliases if a.lower() in have), None)


def standardise(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Each canonical column from the first alias that is there; columns that have the name already stay."""
    new = {c: F.col(f"`{found}`") for c, names in aliases.items() if c not in df.columns and (found := resolve_column(df, names))}
    return df.withColumns(new)


#: Other names of the columns that tables are joined by.
NODE_NAMES = ("node_id", "node", "mapper_node", "node_name")
MEMBER_NAMES = ("pl_name", "planet_name", "planet", "anchor_pl_name")
EDGE_NAMES = {"source": ("source", "u", "from", "node_a", "src"), "target": ("target", "v", "to", "node_b", "dst")}


def with_catalog(membership: DataFrame, catalog: DataFrame, id_column: str = "row_index", name: str = "pl_name") -> DataFrame:
    """Membership with the catalogue's columns, by id, or by name where a member has no id. What the membership knows itself stays.

    Ids and names of the catalogue are taken to be unique; of repeated ones the least row counts.
    """
    rest = [c for c in catalog.columns if c not in (id_column, name)]

    def once(key: str) -> DataFrame:
        one = catalog.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
        return one.select(key, *[F.col(f"_row.{c}").alias(f"_c_{c}") for c in rest])

    by_id = membership.where(F.col(id_column).isNotNull()).join(once(id_column), id_column, "left")
    lost = membership.where(F.col(id_column).isNull())
    by_name = lost.join(once(name), name, "left") if name in membership.columns and name in catalog.columns else lost.withColumns({f"_c_{c}": F.lit(None).cast(catalog.schema[c].dataType) for c in rest})
    out = by_id.unionByName(by_name)
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) if c in membership.columns else F.col(f"_c_{c}") for c in rest})
    return out.drop(*[f"_c_{c}" for c in rest])


def discover(spark: SparkSession, pattern: str, preferred: Sequence[str] = (), explicit: str | None = None) -> str | None:
    """The explicit path; else of a glob's paths the first that has the earliest preferred word in its name; else the first; None for none."""
    if explicit:
        return first_existing(spark, [explicit])
    found = find(spark, pattern)
    for word in preferred:
        if at := next((p for p in found if word in p.rpartition("/")[2]), None):
            return at
    return found[0] if found else None


def edges_of(df: DataFrame) -> DataFrame:
    return standardise(df, EDGE_NAMES)


def by_config(df: DataFrame, config_id: str) -> DataFrame:
    """Rows of a configuration; all rows of a table that has none of it."""
    if "config_id" not in df.columns:
        return df
    mine = df.where(F.col("config_id") == config_id)
    return df if mine.isEmpty() else mine


def _graph_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Graph documents: one a file, or by a .jsonl path one a line, whose nodes and links add up."""
    return spark.read.schema(schema).option("multiLine", not in_lines(path)).json(path)


def in_lines(path: str) -> bool:
    return re.sub(r"[/*]+$", "", path).rpartition(".")[2].lower() in ("jsonl", "ndjson")


def graph_members(spark: SparkSession, path: str, config_id: str | None = None) -> DataFrame:
    """Membership of a graph JSON {nodes: {id: [position]}, sample_id_lookup: [id]}: config_id, node_id, row_index."""
    rows = _graph_rows(spark, path, "nodes map<string,array<long>>, sample_id_lookup array<long>")
    rows = rows.select(F.explode("nodes").alias("node_id", "at"), "sample_id_lookup").withColumn("at", F.explode("at"))
    row = F.when(F.col("sample_id_lookup").isNull(), F.col("at")).otherwise(F.try_element_at("sample_id_lookup", (F.col("at") + 1).cast("int")))
    return rows.select(F.lit(config_id).alias("config_id"), "node_id", row.alias("row_index")).where("row_index is not null")


def graph_edges(spark: SparkSession, path: str, config_id: str | None = None) -> DataFrame:
    """Undirected edges of a graph JSON's links, each once, no loops."""
    rows = _graph_rows(spark, path, "links map<string,array<string>>").select(F.explode("links").alias("a", "bs")).withColumn("b", F.explode("bs"))
    return rows.where("a <> b").select(F.lit(config_id).alias("config_id"), F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).distinct()


def member_lists(nodes: DataFrame, column: str = "member_indices") -> DataFrame:
    """Membership from JSON lists in a node table; what doesn't parse has no members."""
    listed = F.coalesce(F.from_json(column, "array<long>"), F.array().cast("array<long>"))
    return nodes.select(*[c for c in ("config_id", "node_id") if c in nodes.columns], F.explode(listed).alias("row_index"))


def graph_json(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document for each configuration."""
    nodes = membership.groupBy("config_id", "node_id").agg(F.array_sort(F.collect_set("row_index")).alias("m")).groupBy("config_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", "m")))).alias("nodes"))
    both = edges.select("config_id", "source", "target").unionByName(edges.select("config_id", F.col("target").alias("source"), F.col("source").alias("target")))
    links = both.groupBy("config_id", "source").agg(F.array_sort(F.collect_set("target")).alias("t")).groupBy("config_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "t")))).alias("links"))
    return nodes.join(links, "config_id", "left").select("config_id", F.to_json(F.struct("nodes", "links")).alias("json"))


def graph_lines(membership: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """The documents of graph_json in pieces, for graphs of any size: config_id, json; to be written as .jsonl.

    A piece has one node with about `most` of its members, or one node's links; no task holds a node.
    """
    n = membership.groupBy("config_id", "node_id").agg(F.ceil(F.count(F.lit(1)) / most).alias("pieces"))  # follows the cover
    dealt = membership.join(F.broadcast(n), ["config_id", "node_id"]).withColumn("piece", F.pmod(F.xxhash64("row_index"), F.col("pieces")))
    nodes = dealt.groupBy("config_id", "node_id", "piece").agg(F.array_sort(F.collect_set("row_index")).alias("m")).select("config_id", F.to_json(F.struct(F.create_map("node_id", "m").alias("nodes"))).alias("json"))
    both = edges.select("config_id", "source", "target").unionByName(edges.select("config_id", F.col("target").alias("source"), F.col("source").alias("target")))
    links = both.groupBy("config_id", "source").agg(F.array_sort(F.collect_set("target")).alias("t")).select("config_id", F.to_json(F.struct(F.create_map("source", "t").alias("links"))).alias("json"))
    return nodes.unionByName(links)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A table sink: parquet, csv (with header) or json (a document a line, to be read as .jsonl)."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    {"parquet": writer.parquet, "csv": lambda p: writer.option("header", True).csv(p), "json": writer.json}[kind](path)


def inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, path, exists, n_rows, n_columns of input tables."""
    rows = []
    for name, path in paths.items():
        there = exists(spark, path)
        df = read_table(spark, path) if there else None
        rows.append((name, path, there, df.count() if there else None, len(df.columns) if there else None))
    return spark.createDataFrame(rows, "name string, path string, exists boolean, n_rows long, n_columns int")


def write_json(spark: SparkSession, obj: dict, path: str) -> None:
    """A small JSON document through the path's file system."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(obj, indent=1, sort_keys=True, default=str).encode()))
    finally:
        out.close()
