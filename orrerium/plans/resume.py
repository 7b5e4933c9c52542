"""Stage results that outlive a run: written, committed by rename, and kept as long as what they were made of is the same."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrerium.plans.registry import Context, Pipeline
from orrerium.sources.tables import _fs, exists, write_json


class Noted(dict):
    """A dictionary that notes which keys were asked for; one that is walked has had all of them."""

    def __init__(self, base: dict):
        super().__init__(base)
        self.asked: set[str] = set()

    def __getitem__(self, key: str):
        self.asked.add(key)
        return super().__getitem__(key)

    def get(self, key: str, default=None):
        self.asked.add(key)
        return super().get(key, default)

    def __contains__(self, key: object) -> bool:
        self.asked.add(key)
        return super().__contains__(key)

    def _all(self) -> None:
        self.asked |= set(super().keys())

    def __iter__(self):
        self._all()
        return super().__iter__()

    def keys(self):
        self._all()
        return super().keys()

    def items(self):
        self._all()
        return super().items()

    def values(self):
        self._all()
        return super().values()


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def content(df: DataFrame) -> str:
    """Fingerprint of a table's schema and rows, whatever their order: one pass, one row to the driver."""
    h = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})) if df.columns else F.lit(0)
    got = df.select(h.alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h") % F.lit(1_000_003)), F.sum(F.shiftright("h", 40))).first()
    return digest(df.schema.json(), list(got))


class Store:
    """Results of stages in a shared folder: <stage>/<fingerprint>/<table>, and <stage>/manifest.json that names the current ones."""

    def __init__(self, ctx: Context, folder: str):
        self.spark, self.folder = ctx.spark, folder.rstrip("/")

    def entry(self, stage: str) -> dict | None:
        path = f"{self.folder}/{stage}/manifest.json"
        if not exists(self.spark, path):
            return None
        return json.loads("\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect()))  # one small document

    def tables(self, stage: str, entry: dict) -> dict[str, DataFrame] | None:
        at = f"{self.folder}/{stage}/{entry['fingerprint']}"
        if not all(exists(self.spark, f"{at}/{t}/_SUCCESS") for t in entry["tables"]):
            return None
        return {t: self.spark.read.parquet(f"{at}/{t}") for t in entry["tables"]}

    def attempt(self, stage: str, made: dict[str, DataFrame]) -> str:
        """Write a stage's tables where nobody reads them yet."""
        path = f"{self.folder}/{stage}/_attempt-{uuid.uuid4().hex}"
        for name, df in made.items():
            df.write.parquet(f"{path}/{name}")
        return path

    def commit(self, stage: str, attempt: str, entry: dict) -> None:
        """Rename the attempt to its fingerprint, then the manifest to its place: a reader sees the old results or the new ones."""
        at = f"{self.folder}/{stage}/{entry['fingerprint']}"
        self._rename(attempt, at)
        draft = f"{self.folder}/{stage}/_manifest-{uuid.uuid4().hex}.json"
        write_json(self.spark, entry, draft)
        self._rename(draft, f"{self.folder}/{stage}/manifest.json")

    def _rename(self, source: str, target: str) -> None:
        fs, p = _fs(self.spark, source)
        to = _fs(self.spark, target)[1]
        if fs.exists(to):
            fs.delete(to, True)
        if not fs.rename(p, to):
            raise OSError(f"{source} can't be renamed to {target}")

    def sweep(self, stage: str, keep: str | None) -> None:
        """Remove attempts that were cut, and results that the manifest doesn't name."""
        fs, p = _fs(self.spark, f"{self.folder}/{stage}")
        if fs.exists(p):
            for s in fs.listStatus(p):
                if s.getPath().getName() not in ("manifest.json", ".manifest.json.crc", keep):
                    fs.delete(s.getPath(), True)


def run_resumable(pipeline: Pipeline, ctx: Context, folder: str, wanted: str | Iterable[str] | None = None, version: str = "") -> Context:
    """Run the stages, but for those whose results in the folder were made of the same tables and settings by the same version.

    A stage's fingerprint covers the tables that it asked for (input tables by content, others by the fingerprint of the stage that
    made them) and the settings that it asked for; both are noted as it runs. A stage that fails, or is cut, leaves nothing
    that a later run takes for a result. Stages kept are noted as such in the manifest. One run at a time may use a folder.
    """
    store = Store(ctx, folder)
    inputs, prints = dict(ctx.tables), {}

    def table_print(name: str) -> str | None:
        if name not in prints:
            prints[name] = content(inputs[name]) if name in inputs else None
        return prints[name]

    def fingerprint(stage: str, tables: Iterable[str], settings: Iterable[str]) -> str:
        return digest(version, stage, {t: table_print(t) for t in sorted(tables)}, {s: ctx.config.get(s) for s in sorted(settings)})

    for name in pipeline.select(wanted):
        entry = store.entry(name)
        if entry and fingerprint(name, entry["reads"], entry["settings"]) == entry["fingerprint"] and (made := store.tables(name, entry)) is not None:
            note = {"name": name, "status": "kept"}
        else:
            seen = Context(ctx.spark, Noted(ctx.config), Noted(ctx.tables), ctx.manifest)
            note = {"name": name, "status": "done"}
            try:
                fresh = pipeline.stages[name](seen)
                attempt = store.attempt(name, fresh)
            except Exception as e:
                ctx.manifest["stages"].append(note | {"status": "failed", "error": str(e)[:500]})
                raise
            reads, settings = sorted(seen.tables.asked), sorted(seen.config.asked)
            entry = {"fingerprint": fingerprint(name, reads, settings), "reads": reads, "settings": settings, "tables": sorted(fresh)}
            store.commit(name, attempt, entry)
            made = store.tables(name, entry)
        store.sweep(name, entry["fingerprint"])
        for t in made:
            inputs.pop(t, None)
            prints[t] = digest(entry["fingerprint"], t)
        ctx.tables |= made
        ctx.manifest["stages"].append(note | {"fingerprint": entry["fingerprint"]})
    return ctx
