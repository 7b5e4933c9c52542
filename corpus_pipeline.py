"""A document pipeline of five stages, each writing Parquet that the next one reads.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerium.llm import language
from orrerium.llm.common import materialise, quiet_arrow, remove, settled, split_by_ids, step, table
from orrerium.llm.decontaminate import decontaminate
from orrerium.llm.ngram_join import ngram_join
from orrerium.llm.packing import pack_documents
from orrerium.llm.queries import tokenizer_path
from orrerium.llm.repeats import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share this many of 100 five-word shingles.
SHINGLE, SHARE, OF = 5, 80, 100
#: Bytes of a passage that may not repeat: passages of over 50 words have as many at four bytes a word with its space.
PASSAGE = 200


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a unique `row`: the id where ids are unique and not null, else a number that is written with the rows."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    return materialise(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; lang becomes that language. Blank texts go."""
    quiet_arrow(spark, 2000)
    found = language.identify(docs, language.train(docs)).where("accepted")
    return found.withColumn("lang", F.col("language")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest id. Rows without an id or with another row's id are
    documents of their own (the first of them stands for its component); blank texts are no copies of each other."""
    quiet_arrow(spark, 2000)
    docs = _numbered(docs)
    with step() as held:
        found = ngram_join(docs.select(F.col("row").alias("doc_id"), "text"), SHINGLE, SHARE, OF)
    gone = settled(found.where("doc_id <> component_id").select(F.col("doc_id").alias("row")), "copies", held)
    maybe, rest = split_by_ids(docs, gone, "row")
    return maybe.join(gone, "row", "left_anti").select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat among them."""
    quiet_arrow(spark, 2000)
    docs = _numbered(docs)
    with step() as held:
        found = remove_repeats(docs.select(F.col("row").alias("doc_id"), "text"), PASSAGE)
    cut = settled(found.where("n_removed > 0").select(F.col("doc_id").alias("row"), "kept"), "cut", held)
    maybe, rest = split_by_ids(docs, cut.select("row"), "row")
    text = F.coalesce("kept", "text")
    changed = maybe.join(cut, "row", "left").select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))
    return changed.unionByName(rest.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; rows of one id, or of none, are judged one by one."""
    quiet_arrow(spark, 2000)
    docs = _numbered(docs)
    hit = decontaminate(docs.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("row"))
    hit = materialise(hit, "contaminated")
    maybe, rest = split_by_ids(docs, hit, "row")
    return maybe.join(hit, "row", "left_anti").select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    quiet_arrow(spark, 2000)
    return pack_documents(docs, tokenizer_path(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]
#: The stages aren't SQL: tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with step() as held:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{k}-{name}", keep=True)
        for path in held:  # what the stage wrote on its way: its result has been written
            remove(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
