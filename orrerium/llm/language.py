"""Language identification by fusing Bayesian evidence.

Evidence: a hashed byte-trigram likelihood of the text, the declared language, and priors of the
host, smoothed towards those of its address suffix and these towards the corpus. All tables are
grouped counts over the whole corpus.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrerium.llm.common import LOWER, materialise, text_chunks

#: Buckets of trigrams; the share of a trigram's weight (each byte stands in three); pseudo-counts of the parent level.
BUCKETS = 1 << 13
TEMPER = 1 / 3
SMOOTHING = 5.0
#: Pseudo-counts of trigrams by which a language is smoothed towards the corpus.
SMOOTHING_TRIGRAMS = 500.0
#: The commonest labels are languages, up to this many; those of all further labels together are one other language.
MOST_LANGUAGES = 200
#: A text is kept if its language is this likely.
CONFIDENCE = 0.5
RESULT = ("text_lang", "language", "confidence", "accepted")


def _trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every three bytes of a row; white space counts as a space, A-Z as a-z."""
    b = LOWER[buf].astype(np.uint32)
    b[(b < 33)] = 32
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok = row[:-2] == row[2:]
    return row[:-2][ok], (t[ok] >> np.uint32(19)).astype(np.int64)


def labels_of(docs: DataFrame, label: str) -> tuple[list[str], bool]:
    """(the languages, whether there are further ones): the MOST_LANGUAGES commonest labels of texts, however rare."""
    counts = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).groupBy(F.lower(F.col(label).cast("string")).alias("l")).count()
    top = [r[0] for r in counts.orderBy(F.desc("count"), "l").limit(MOST_LANGUAGES + 1).select("l").collect()]
    return sorted(top[:MOST_LANGUAGES]), len(top) > MOST_LANGUAGES


def train(docs: DataFrame, label: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bucket by language) from all labelled texts, smoothed towards the corpus.

    Where there are labels beyond MOST_LANGUAGES, one more row of probabilities is that of all of them.
    """
    names, more = labels_of(docs, label)
    code = {n: k for k, n in enumerate(names)}
    classes = len(names) + more

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * BUCKETS, np.int64)
        for batch in batches:
            lang = np.array([-1 if x is None else code.get(x, len(names)) for x in batch.column(0).to_pylist()])
            for i, _, buf, off in text_chunks(batch.column(1)):
                row, t = _trigrams(buf, off)
                k = lang[i + row] if len(row) else row
                total += np.bincount((k * BUCKETS + t)[k >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    seen = docs.select(F.lower(F.col(label).cast("string")), F.col("text").cast("string")).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # at most 201 languages' buckets
    n = np.zeros((max(classes, 1), BUCKETS))
    for slot, c in seen:
        n[slot // BUCKETS, slot % BUCKETS] += c
    whole = n.sum(0) + 0.5
    n += SMOOTHING_TRIGRAMS * whole / whole.sum()
    return names, np.log(n / n.sum(1, keepdims=True))


def _array(cols: list[Column]) -> Column:
    return F.array(*cols) if cols else F.array().cast("array<double>")


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], declared: str = "lang", host: str = "source") -> DataFrame:
    """All columns of docs plus text_lang, language, confidence and accepted (which replace columns of docs of those names).

    docs: text, a column of declared languages and one of hosts (either may be null in any row). Texts of under three
    bytes have no likelihood of their own and go by the other evidence; null and blank ones are never accepted. A declared value
    that is no known language counts as one 'other'; a text of the model's other language has its declared value as language (null
    without one) and `other` as text_lang; hosts differ by letter case only are one; without a dot a host has an
    empty suffix. Ties go to the language first in order. Repeated rows are judged one by one. Columns
    that begin with `_zz` are reserved.
    """
    names, logp = model
    spark = docs.sparkSession
    n = len(logp)
    if not names:
        return docs.withColumns({"text_lang": F.lit(None).cast("string"), "language": F.lit(None).cast("string"), "confidence": F.lit(0.0), "accepted": F.lit(False)})
    known = spark.sparkContext.broadcast(logp)  # at most 201 x BUCKETS numbers

    @F.pandas_udf("array<double>")
    def likelihood(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), n))
        for i, j, buf, off in text_chunks(pa.array(texts, pa.large_string(), from_pandas=True)):
            row, t = _trigrams(buf, off)
            for k in range(n):
                out[i:j, k] = np.bincount(row, known.value[k][t], minlength=j - i) * TEMPER
        return pd.Series(list(out))

    rows = docs.withColumn("_zzll", likelihood(F.col("text").cast("string")))
    best = F.array_position("_zzll", F.array_max("_zzll")).cast("int")
    rows = rows.withColumns({"_zzguess": F.when(F.octet_length(F.trim(F.coalesce("text", F.lit("")))) > 2, best), "_zzhost": F.lower(F.coalesce(F.col(host).cast("string"), F.lit("")))})
    rows = rows.withColumn("_zzsaid", F.coalesce(F.array_position(_array([F.lit(x) for x in names]), F.lower(F.col(declared).cast("string"))), F.lit(-1)).cast("int"))
    # What is counted is written without the texts; likelihoods are worked out once more for the result.
    seen = materialise(rows.select("_zzguess", "_zzsaid", "_zzhost"), "evidence")
    said = np.full((n + 2, n), 0.5)
    for g, s, c in seen.where("_zzguess is not null").groupBy("_zzguess", "_zzsaid").count().collect():  # at most 201 x 203 rows
        said[s, g - 1] += c
    said = np.log(said / said.sum(0))
    # Row -1 is a missing or unknown declaration, 0 an other one.
    evidence = F.create_map(*[x for s in range(-1, n + 1) for x in (F.lit(s), _array([F.lit(float(v)) for v in said[s]]))])
    counts, priors_of_all = _host_counts(seen, n)
    rows = rows.join(materialise(counts, "host-counts"), "_zzhost", "left")
    # A text's own guess is evidence already: its host and suffix speak without it.
    whole = _array([F.lit(float(x)) for x in priors_of_all])
    own = F.when(F.col("_zzguess").isNotNull(), 1.0).otherwise(0.0)

    def prior(c: Column, i: Column) -> Column:
        me = F.when(F.col("_zzguess") == i + 1, 1.0).otherwise(0.0)
        parent = (F.get("_zzsuffix", i) - me + SMOOTHING * F.get(whole, i)) / (F.col("_zzsuffixes") - own + SMOOTHING)
        return F.log((c - me + SMOOTHING * parent) / (F.col("_zzhosts") - own + SMOOTHING))

    score = F.zip_with(F.zip_with("_zzll", evidence[F.col("_zzsaid")], lambda a, b: a + b), F.transform("_zzcounts", prior), lambda a, b: a + b)
    rows = rows.withColumn("_zzscore", score).withColumn("_zztop", F.array_max("_zzscore"))
    at = F.array_position("_zzscore", F.col("_zztop"))
    total = F.aggregate("_zzscore", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_zztop")))
    spelled = [F.lit(x) for x in names]
    others, most = ([F.lit("other")], [F.col(declared).cast("string")]) if n > len(names) else ([], [])
    # The declared value is read before a column of its name is replaced.
    rows = rows.withColumn("_zzfound", F.struct(F.element_at(_array(spelled + others), F.col("_zzguess")).alias("text_lang"), F.element_at(_array(spelled + most), at.cast("int")).alias("language"), (1.0 / total).alias("confidence")))
    rows = rows.withColumns({c: F.col(f"_zzfound.{c}") for c in RESULT[:3]})
    rows = rows.withColumn("accepted", (F.col("confidence") >= CONFIDENCE) & (F.octet_length(F.trim(F.coalesce("text", F.lit("")))) > 0))
    return rows.select(*[c for c in docs.columns if c not in RESULT], *RESULT)


def _host_counts(rows: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(guesses of each language by host and by its suffix with their sums, the share of each language in all)."""
    counts = [F.sum(F.when(F.col("_zzguess") == k + 1, 1.0).otherwise(0.0)).alias(f"n{k}") for k in range(n)]
    hosts = materialise(rows.groupBy("_zzhost").agg(*counts).withColumn("suffix", F.regexp_extract("_zzhost", r"\.([^.]+)$", 1)), "hosts")
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"n{k}").alias(f"s{k}") for k in range(n)])
    total = hosts.agg(*[F.sum(f"n{k}") for k in range(n)]).first()
    t = np.array([x or 0.0 for x in total]) + 1.0
    columns = {"_zzcounts": [F.col(f"n{k}") for k in range(n)], "_zzsuffix": [F.col(f"s{k}") for k in range(n)]}
    both = hosts.join(suffixes, "suffix").select("_zzhost", *[_array(c).alias(name) for name, c in columns.items()], *[sum(c, F.lit(0.0)).alias(name) for name, c in (("_zzhosts", columns["_zzcounts"]), ("_zzsuffixes", columns["_zzsuffix"]))])
    return both, t / t.sum()
