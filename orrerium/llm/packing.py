"""Best-fit packing of tokenised documents by linear grouping.

Lengths are integers up to the capacity, so the driver only needs their histogram (at most
`capacity` rows, whatever the corpus). On it: large lengths are cut, in descending order, into
groups of equal cardinality and rounded up to the group's largest; a Gilmore-Gomory linear
program over those few sizes gives configurations; actual lengths take the groups' places, which
splits configurations into runs of equal content; small lengths then go, longest first, into the
tightest remaining gaps. The outcome is a plan of runs: "the documents of length L with ranks a
to b go to sequences s, s+1, ... at offset o". Ranks come from a window over (length, salt), so a
length that a third of the corpus shares is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrerium.llm import tokens
from orrerium.llm.common import materialise

#: Sizes that large lengths are rounded to; lengths up to capacity / divisor are small. Each divisor is
#: planned and the plan of fewest sequences kept.
GROUPS = 48
SMALL_DIVISORS = (4, 3, 2)
#: Salts of a length's ranks.
SALTS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Documents as pieces of at most `capacity` ids, an end id after each document's own.

    Null and empty texts are one piece, the end id alone. Repeated rows each give their pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode(batch.column(1)), strict=True):
                full = np.append(ids, end_id).astype("<u4")
                out += [(doc, k, s, len(p := full[s : s + capacity]), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(full), capacity))]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Gilmore-Gomory: configurations of the sizes and how often each is used in the linear optimum."""
    k = len(sizes)
    base = np.diag(capacity // sizes).astype(float)
    cols = [base[:, i] for i in range(k)]
    inv = np.diag(1.0 / np.diag(base))
    x = inv @ demand
    for _ in range(60 * k):
        price = inv.sum(0)
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        low = int(sizes.min())
        order = np.argsort(sizes)
        asc, val = sizes[order], price[order]
        for c in range(low, capacity + 1):
            m = int(np.searchsorted(asc, c, "right"))
            gain = best[c - asc[:m]] + val[:m]
            j = int(gain.argmax())
            if gain[j] > best[c - 1] + 1e-12:
                best[c], take[c] = gain[j], order[j]
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        pattern, c = np.zeros(k), capacity
        while c >= low:
            if take[c] < 0:
                c -= 1
                continue
            pattern[take[c]] += 1
            c -= int(sizes[take[c]])
        d = inv @ pattern
        able = d > 1e-9
        out = int(np.argmin(np.where(able, x / np.where(able, d, 1), np.inf)))
        step = x[out] / d[out]
        x = x - step * d
        x[out] = step
        row = inv[out] / d[out]
        inv = inv - np.outer(d, row)
        inv[out] = row
        cols[out] = pattern
    return [(cols[i].astype(int), float(x[i])) for i in range(k)]


class Plan:
    """Runs of sequences of equal content, and where each length's ranks go."""

    def __init__(self, histogram: dict[int, int], capacity: int = 2048, groups: int = GROUPS, divisor: int = 4):
        self.capacity = capacity
        self.next_rank = dict.fromkeys(histogram, 0)
        self.left = dict(histogram)
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, end rank, first sequence, offset
        self.used = 0
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, how many)
        small = capacity // divisor
        large = {n: c for n, c in histogram.items() if n > small and c}
        if large:
            self._large(large, groups)
        self._small()

    def _place(self, length: int, n: int, seq: int, offset: int) -> None:
        r = self.next_rank[length]
        self.rows.append((length, r, r + n, seq, offset))
        self.next_rank[length] = r + n
        self.left[length] -= n

    def _large(self, large: dict[int, int], groups: int) -> None:
        lengths = np.array(sorted(large, reverse=True))
        count = np.array([large[n] for n in lengths])
        each = -(-count.sum() // groups)
        # Equal cardinality: a length that straddles a border is shared out between the groups.
        members: list[list[list[int]]] = [[]]
        room = each
        for n, c in zip(lengths.tolist(), count.tolist(), strict=True):
            while c:
                if not room:
                    members.append([])
                    room = each
                m = min(c, room)
                members[-1].append([n, m])
                c -= m
                room -= m
        # Groups that round up to one size are one group.
        merged: dict[int, list[list[int]]] = {}
        for g in members:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(list(merged))
        queue = [merged[s] for s in merged]
        demand = np.array([sum(m for _, m in q) for q in queue], float)
        for pattern, times in configurations(sizes, demand, self.capacity):
            self._substitute(pattern, int(times + 1e-9), queue)
        # What rounding the linear optimum down leaves, longest first into the tightest gap.
        for q in queue:
            for n, m in q:
                if m:
                    self._best_fit(n, m)

    def _substitute(self, pattern: np.ndarray, times: int, queue: list[list[list[int]]]) -> None:
        """Fill `times` copies of a configuration with the groups' own lengths, in runs of equal content."""
        slots = [g for g, n in enumerate(pattern) for _ in range(n)]
        while times and slots:
            # Slots of one group take from its queue side by side; a length is enough for m runs of all of them.
            fill, run = [], times
            taken: dict[tuple[int, int], int] = {}
            for g in slots:
                k = next((k for k, (_, m) in enumerate(queue[g]) if m - taken.get((g, k), 0) > 0), None)
                if k is not None:
                    fill.append((g, k))
                    taken[g, k] = taken.get((g, k), 0) + 1
            if not fill:
                return
            for (g, k), n in taken.items():
                run = min(run, max(1, queue[g][k][1] // n))
            offset = 0
            for g, k in fill:
                n = queue[g][k][0]
                self._place(n, run, self.used, offset)
                queue[g][k][1] -= run
                offset += n
            self._gap(self.capacity - offset, self.used, run)
            self.used += run
            times -= run
            for g in {g for g, _ in fill}:
                queue[g] = [x for x in queue[g] if x[1]]

    def _gap(self, gap: int, seq: int, n: int) -> None:
        if gap:
            self.gaps.setdefault(gap, []).append((seq, n))

    def _best_fit(self, length: int, n: int) -> None:
        """n documents of the length, each into the tightest gap, or new sequences."""
        while n:
            gap = min((g for g, runs in self.gaps.items() if g >= length and runs), default=None)
            if gap is None:
                per = self.capacity // length
                full, rest = divmod(n, per)
                for m, k in ((full, per), (1 if rest else 0, rest)):
                    if m:
                        for i in range(k):
                            self._place(length, m, self.used, i * length)
                        self._gap(self.capacity - k * length, self.used, m)
                        self.used += m
                return
            seq, m = self.gaps[gap].pop()
            take = min(n, m)
            if take < m:
                self.gaps[gap].append((seq + take, m - take))
            self._place(length, take, seq, self.capacity - gap)
            self._gap(gap - length, seq, take)
            n -= take

    def _small(self) -> None:
        for length in sorted((n for n, c in self.left.items() if c), reverse=True):
            self._best_fit(length, self.left[length])

    def table(self) -> pd.DataFrame:
        return pd.DataFrame(sorted(self.rows), columns=["length", "first", "end", "seq", "offset"], dtype="int64")


def pack(parts: DataFrame, capacity: int = 2048, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length and any other columns).

    `parts` is read more than once: give a written table. Ties between equal lengths go by a hash
    of (doc_id, piece); repeated rows are packed one by one. An empty table stays empty.
    """
    spark = parts.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS))
    salted = parts.withColumn("_salt", salt.cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    # At most capacity * SALTS rows of three integers.
    counts = counts.toPandas().sort_values(["length", "_salt"])
    histogram = counts.groupby("length")["_n"].sum()
    lengths = {int(k): int(v) for k, v in histogram.items()}
    plan = min((Plan(lengths, capacity, groups, d) for d in SMALL_DIVISORS), key=lambda p: p.used).table()
    counts["_before"] = counts.groupby("length")["_n"].cumsum() - counts["_n"]
    # At most capacity * SALTS offsets and the plan's runs, whose number follows lengths and groups, not rows.
    known = spark.sparkContext.broadcast(
        (
            counts["length"].to_numpy() * SALTS + counts["_salt"].to_numpy(),
            counts["_before"].to_numpy(),
            (plan["length"].to_numpy() << 44) + plan["first"].to_numpy(),
            plan["first"].to_numpy(),
            plan["seq"].to_numpy(),
            plan["offset"].to_numpy(),
        )
    )
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")).cast("long") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, before, runs, first, seq, offset = known.value
        n = length.to_numpy()
        r = before[np.searchsorted(keys, n * SALTS + salt.to_numpy())] + rank.to_numpy()
        at = np.searchsorted(runs, (n << 44) + r, "right") - 1
        return pd.DataFrame({"sequence_id": seq[at] + r - first[at], "offset": offset[at]})

    return ranked.withColumn("_at", place("length", "_salt", "_rank")).select(*parts.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Tokenise, cut and pack whole documents (doc_id, text; other columns are left aside)."""
    return pack(materialise(pieces(docs, tokenizer, capacity), "pieces"), capacity)
