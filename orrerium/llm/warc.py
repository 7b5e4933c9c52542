"""WARC records, and not-modified revisits resolved by an as-of join.

A revisit takes its body from the latest strictly earlier full response of the same canonical URL, if
their validators agree, and its headers from that response with the permitted ones of its own merged in.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrerium.llm.common import materialise

#: Query parameters that don't name a resource; headers that a 304 must not change (RFC 9111, 3.2).
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
FIXED_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "connection", "transfer-encoding", "keep-alive", "trailer", "upgrade", "te", "proxy-authenticate", "proxy-authorization", "proxy-connection")
#: Slices of time that a URL's captures are cut into, so that one URL's are not one task's.
SLICES = 64

RECORD = "record_id string, url string, ts long, type string, status int, headers map<string,string>, body binary"


def canonical(url: Column) -> Column:
    """Host in lower case without www. and default port, path without trailing slashes, query sorted and without
    tracking parameters, no scheme or fragment. Null stays null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(query, lambda q: (q != "") & ~q.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _said(headers: Column, name: str) -> Column:
    return headers[name]


def resolve(captures: DataFrame) -> DataFrame:
    """Every revisit with what it resolves to: record_id, url, canonical_url, ts, state, source_id, headers, body.

    captures: record_id, url, ts (integer), type ('response' or 'revisit'), status, headers (names in lower case),
    body; other columns are left aside. A full response has status 200 and a body. Equal times are not earlier;
    of several latest responses of one time the greatest record_id counts. state is 'resolved', 'mismatched' (the
    validators that both carry differ, in the order etag, last-modified, warc-payload-digest; the first that both
    carry decides), 'unvalidated' (they share none: not resolved) or 'unmatched' (no earlier response). Only resolved
    rows have headers and a body. Revisits with a null URL or time are unmatched. Repeated rows are resolved one by one.
    """
    rows = captures.withColumns({"canonical_url": canonical(F.col("url")), "ts": F.col("ts").cast("long")})
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("body").isNotNull()
    validators = ("etag", "last-modified", "warc-payload-digest")
    seen = F.struct("ts", "record_id", *[_said(F.col("headers"), v).alias(f"v{k}") for k, v in enumerate(validators)])
    slim = rows.select("record_id", "url", "canonical_url", "ts", "type", F.coalesce(full, F.lit(False)).alias("full"), F.when(F.col("type") == "revisit", F.col("headers")).alias("headers"), seen.alias("seen"))
    slim = materialise(slim, "captures-slim")
    # Borders are quantiles of the times, so that slices hold about as many captures each; a time is in one slice only.
    borders = sorted({int(x) for x in slim.stat.approxQuantile("ts", [k / SLICES for k in range(1, SLICES)], 0.002)})
    slim = materialise(slim.withColumn("slice", F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in borders]).cast("array<long>"), lambda x: x <= F.col("ts")))), "captures")
    known = slim.where("canonical_url is not null and ts is not null")
    # The latest response by slice, then before each slice; at most SLICES rows a URL.
    last = known.where("full").groupBy("canonical_url", "slice").agg(F.max("seen").alias("last"))
    every = known.select("canonical_url", "slice").distinct().join(last, ["canonical_url", "slice"], "left")
    before = every.withColumn("before", F.max("last").over(Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("canonical_url", "slice", "before")
    within = F.max(F.when(F.col("full"), F.col("seen"))).over(Window.partitionBy("canonical_url", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1))
    asof = known.withColumn("within", within).where("type = 'revisit'").join(materialise(before, "before"), ["canonical_url", "slice"]).withColumn("found", F.coalesce("within", "before"))
    lost = slim.where("type = 'revisit' and (canonical_url is null or ts is null)").withColumn("found", F.lit(None).cast(slim.schema["seen"].dataType))
    cols = ("record_id", "url", "canonical_url", "ts", "headers", "seen", "found")
    asof = asof.select(*cols).unionByName(lost.select(*cols))
    verdict = F.lit("unvalidated")
    for k in reversed(range(len(validators))):
        mine, theirs = F.col(f"seen.v{k}"), F.col(f"found.v{k}")
        verdict = F.when(mine.isNotNull() & theirs.isNotNull(), F.when(mine == theirs, "resolved").otherwise("mismatched")).otherwise(verdict)
    asof = asof.withColumn("state", F.when(F.col("found").isNull(), "unmatched").otherwise(verdict)).withColumn("source_id", F.col("found.record_id")).withColumn("source_ts", F.col("found.ts"))
    bodies = rows.where(full).select("canonical_url", F.col("ts").alias("source_ts"), F.col("record_id").alias("source_id"), F.col("headers").alias("stored"), "body").dropDuplicates(["canonical_url", "source_ts", "source_id"])
    fixed = F.array(*[F.lit(h) for h in FIXED_HEADERS])
    own = F.map_filter("headers", lambda k, v: ~F.array_contains(fixed, k))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(own, k)), own)
    done = asof.where("state = 'resolved'").join(bodies, ["canonical_url", "source_ts", "source_id"]).withColumn("merged", F.coalesce(merged, F.col("stored")))
    kind = done.schema["body"].dataType
    out = ("record_id", "url", "canonical_url", "ts", "state", "source_id")
    open_ = asof.where("state <> 'resolved'").select(*out, F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast(kind).alias("body"))
    return done.select(*out, F.col("merged").alias("headers"), "body").unionByName(open_)


def _records(raw: bytes) -> Iterator[tuple]:
    """Records of a WARC file, its members gzipped or not.

    A record that is cut off, a damaged gzip member and a length that is no number end the file; a date that is none is null.
    """
    with contextlib.suppress(_Damaged):
        yield from _read(raw)


class _Damaged(Exception):
    """Where the next record begins can't be told."""


class _Inflated(io.RawIOBase):
    """The bytes of gzip members one after the other, up to where they can't be inflated."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.member, self.held = memoryview(raw), 0, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        while not self.held and self.at < len(self.raw):
            if self.member is None:
                self.member = zlib.decompressobj(31)
            piece = self.raw[self.at : self.at + 4096]
            try:
                self.held = self.member.decompress(piece)
            except zlib.error:
                self.at = len(self.raw)
                break
            self.at += len(piece) - len(self.member.unused_data)
            if self.member.eof:
                self.member = None
        n = min(len(to), len(self.held))
        to[:n], self.held = self.held[:n], self.held[n:]
        return n


def _read(raw: bytes) -> Iterator[tuple]:
    f = io.BufferedReader(_Inflated(raw) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw))
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        if (head := _headers(f)) is None:
            return
        length = head.get("content-length") or "0"
        if not (length.isascii() and length.isdigit()):
            raise _Damaged
        size = int(length)
        block = f.read(size)
        if len(block) < size:
            return
        kind = head.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        first, _, rest = block.partition(b"\r\n")
        b = io.BytesIO(rest)
        http = _headers(b) or {}
        if d := head.get("warc-payload-digest"):
            http["warc-payload-digest"] = d
        status = first.split()
        yield (head.get("warc-record-id"), head.get("warc-target-uri"), _micros(head.get("warc-date")), kind, int(status[1]) if len(status) > 1 and status[1].isdigit() else None, http, b.read() if kind == "response" else None)


def _micros(date: str | None) -> int | None:
    try:
        when = datetime.fromisoformat((date or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() * 1_000_000)


def _headers(f: io.BufferedIOBase) -> dict[str, str] | None:
    """Header lines up to the blank one; None if the file ends before it."""
    out: dict[str, str] = {}
    while line := f.readline():
        if not (line := line.rstrip(b"\r\n")):
            return out
        name, _, value = line.partition(b":")
        out[name.decode("latin-1").strip().lower()] = value.decode("latin-1").strip()
    return None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The responses and revisits of the WARC files of a path, a file to a task; times in microseconds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "url", "ts", "type", "status", "headers", "body"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for raw in batch.column(0):
                held: list[tuple] = []
                for r in _records(raw.as_py()):
                    held.append(r)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def warc_record(record_id: str, url: str, date: str, kind: str, status: int, headers: dict[str, str], body: bytes | None) -> bytes:
    """One gzipped record."""
    http = f"HTTP/1.1 {status} -\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items() if k != "warc-payload-digest") + "\r\n"
    block = http.encode("latin-1") + (body or b"")
    digest = f"WARC-Payload-Digest: {headers['warc-payload-digest']}\r\n" if "warc-payload-digest" in headers else ""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n{digest}Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode("latin-1") + block + b"\r\n\r\n", mtime=0)
