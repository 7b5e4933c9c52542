"""Shared pieces: table access, written tables, and byte-level kernels over Arrow batches."""

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel turns into 64-bit arrays at a time (a longer text is one chunk by itself).
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where it is unset, one of our own on a single machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="orrerium-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_STEP: ContextVar[list[str] | None] = ContextVar("step", default=None)


@contextlib.contextmanager
def step() -> Iterator[list[str]]:
    """The paths of the tables that are written within: for callers who know when all that reads them has itself been written."""
    held: list[str] = []
    token = _STEP.set(held)
    try:
        yield held
    finally:
        _STEP.reset(token)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and executors may be lost.

    Tables go when the driver ends, or with the step that wrote them unless kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    if not keep and (held := _STEP.get()) is not None:
        held.append(path)
    return spark.read.schema(schema).parquet(path)


def settled(df: DataFrame, name: str, held: list[str]) -> DataFrame:
    """df written, and the tables of a step that only df has read removed, with the shuffle files that nothing reads any more."""
    out = materialise(df, name)
    for path in held:
        remove(df.sparkSession, path)
    forget(df.sparkSession)
    return out


def forget(spark: SparkSession) -> None:
    """Spark deletes the files of a shuffle when the driver's collector finds that nothing refers to it; idle memory lets that wait for long."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most `most` bytes, or one longer row. Null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    trim()


#: Byte tables of A-Z to a-z, and of the two word alphabets.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_R = 0xD6E8FEB86659FD93
_RINV = pow(_R, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _POW[base] = have
    return have[:n]


class Rolling:
    """64-bit polynomial hashes of any spans of a byte string."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * powers(_R, n), out=self.prefix[1:])
        self.inv = powers(_RINV, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inv[start])

    def windows(self, k: int) -> np.ndarray:
        """Of every k bytes, by start."""
        n = len(self.prefix) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[k:] - self.prefix[: n + 1 - k]) * self.inv[: n + 1 - k])


def words(buf: np.ndarray, off: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of the alphabet's bytes; a run never crosses rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = alphabet[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | edge[1:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def quiet_arrow(spark: SparkSession, rows: int) -> None:
    """Rows of an Arrow batch, and its bytes: whole texts travel in it, so the batch is kept small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


BATCH_BYTES = 4 << 20
#: Bits of an id filter: what is broadcast is this many, whatever the number of ids.
FILTER_BITS = 1 << 24


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame):
    """A broadcast bit set of fixed size over one column of longs: too many ids make it let more through, never less."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_slots(batch.column(0).drop_null().to_numpy(zero_copy_only=False))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    packed = np.zeros(FILTER_BITS // 8, np.uint8)
    for (got,) in ids.select(ids.columns[0]).coalesce(4).mapInArrow(gather, "bits binary").collect():  # 4 sets of 2 MB
        packed |= np.frombuffer(got, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(packed.tobytes())


def may_have(bits: bytes, ids: np.ndarray) -> np.ndarray:
    s = _slots(ids)
    return (np.frombuffer(bits, np.uint8)[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1).astype(bool)


def split_by_ids(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the ids, rows that surely have none): only the first need a join. Null ids are among the second."""
    known = id_filter(ids)

    @F.pandas_udf("boolean")
    def may(x: pd.Series) -> pd.Series:
        there = x.notna().to_numpy()
        out = np.zeros(len(x), bool)
        out[there] = may_have(known.value, x[there].to_numpy())
        return pd.Series(out)

    test = may(F.col(column).cast("long"))
    return df.where(test), df.where(~test)


def rows_of(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows that have one of the ids, and maybe others: by the filter, or by a join if there are too many ids for it. Rows without an id stay."""
    if ids.count() > FILTER_BITS:
        known = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
        return df.join(known, column, "left_semi").unionByName(df.where(F.col(column).isNull()))
    return split_by_ids(df, ids, column)[0].unionByName(df.where(F.col(column).isNull()))


def trim() -> None:
    """Give freed memory back to the system: workers live on, and what one group took would else be held beside the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep their own ways
        ctypes.CDLL(None).malloc_trim(0)
