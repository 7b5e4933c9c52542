"""Feature registry, leakage rules, configuration and the stage runner: driver-side plans only."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of risk.
RISKS = ("none", "low", "medium", "high", "forbidden")


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    role: str = "model"
    risk: str = "none"
    aliases: tuple[str, ...] = ()


@dataclass
class Registry:
    """Features by group, named sets as expressions over groups and features, and what a target excludes."""

    features: dict[str, Feature]
    sets: dict[str, str] = field(default_factory=dict)
    excluded: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, groups: dict[str, Iterable[str | dict]], sets: dict[str, str] | None = None, excluded: dict[str, Iterable[str]] | None = None) -> Registry:
        found = {}
        for group, items in groups.items():
            for item in items:
                f = Feature(item, group) if isinstance(item, str) else Feature(item["name"], group, item.get("role", "model"), item.get("risk", "none"), tuple(item.get("aliases", ())))
                found[f.name] = f
        return cls(found, dict(sets or {}), {k: tuple(v) for k, v in (excluded or {}).items()})

    def group(self, name: str) -> list[Feature]:
        return [f for f in self.features.values() if f.group == name]

    def resolve(self, expression: str, _open: tuple[str, ...] = ()) -> list[str]:
        """Features of "a + b - c", where each term is a set, a group or a feature; each once, in order."""
        if expression in _open:
            raise ValueError(f"set {expression!r} contains itself")
        out: list[str] = []
        for sign, term in _terms(expression):
            if term in self.sets and term not in _open:
                names = self.resolve(self.sets[term], (*_open, term))
            elif self.group(term):
                names = [f.name for f in self.group(term)]
            elif term in self.features:
                names = [term]
            else:
                raise ValueError(f"unknown set, group or feature {term!r}")
            out = [n for n in out if n not in names] + (names if sign > 0 else [])
        return list(dict.fromkeys(out))

    def without_leaks(self, names: Iterable[str], target: str | None = None, diagnostics: bool = False, audit: bool = False) -> tuple[list[str], dict[str, str]]:
        """(kept, reasons): the target and its logarithm, what it excludes, and audit and diagnostic features go."""
        kept, why = [], {}
        bare = (target or "").removeprefix("log_")
        for n in names:
            f = self.features.get(n)
            if target and n in (bare, f"log_{bare}"):
                why[n] = "target"
            elif target and n in self.excluded.get(bare, ()):
                why[n] = "excluded_by_target"
            elif f and f.role == "audit" and not audit:
                why[n] = "audit_only"
            elif f and f.role == "diagnostic" and not diagnostics:
                why[n] = "diagnostic_only"
            elif f and f.risk == "forbidden":
                why[n] = "forbidden"
            else:
                kept.append(n)
        return kept, why

    def model_columns(self, df: DataFrame, names: Iterable[str]) -> dict[str, str]:
        """Each feature's column: its name or the first alias in the table."""
        have = {c.lower(): c for c in df.columns}
        out = {}
        for n in names:
            spelled = (n, *(self.features[n].aliases if n in self.features else ()))
            if c := next((have[s.lower()] for s in spelled if s.lower() in have), None):
                out[n] = c
        return out

    def audit(self, df: DataFrame) -> DataFrame:
        """feature, group, role, risk, column, available, n_missing, missing_fraction: one pass over the table."""
        at = self.model_columns(df, self.features)
        got = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(n) for n, c in at.items()]).first().asDict()
        rows = [(f.name, f.group, f.role, f.risk, at.get(f.name), f.name in at, got.get(f.name), got[f.name] / got["n"] if f.name in at and got["n"] else None) for f in self.features.values()]
        return df.sparkSession.createDataFrame(rows, "feature string, group string, role string, risk string, column string, available boolean, n_missing long, missing_fraction double")

    @staticmethod
    def audit_summary(audit: DataFrame) -> DataFrame:
        """By group: features, available ones, mean missing share, greatest risk."""
        order = F.array_position(F.array(*[F.lit(r) for r in RISKS]), F.col("risk"))
        return audit.groupBy("group").agg(F.count(F.lit(1)).alias("n_features"), F.count_if("available").alias("n_available"), F.avg("missing_fraction").alias("mean_missing_fraction"), F.max_by("risk", order).alias("max_risk"))


def _terms(expression: str) -> list[tuple[int, str]]:
    out, sign = [], 1
    for part in expression.replace("+", " + ").replace(" - ", " − ").split():
        if part in ("+", "−"):
            sign = 1 if part == "+" else -1
        else:
            out.append((sign, part))
            sign = 1
    return out


def merged(base: dict, *over: dict) -> dict:
    """Nested dictionaries, later ones winning; the inputs stay as they are."""
    out = copy.deepcopy(base)
    for o in over:
        for k, v in o.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def override(text: str) -> dict:
    """a.b=1 as {a: {b: 1}}; the value is JSON where it parses, else text."""
    path, sep, raw = text.partition("=")
    if not sep or not path.strip():
        raise ValueError(f"not an override: {text!r}")
    try:
        value = json.loads(raw)
    except ValueError:
        value = raw.strip()
    for key in reversed(path.strip().split(".")):
        value = {key: value}
    return value


#: What a text about candidates may not claim.
FORBIDDEN = ("confirmed planet", "discovered planet", "proves the existence", "definitive detection")


def prudent(text: str, forbidden: Iterable[str] = FORBIDDEN) -> str:
    if found := [f for f in forbidden if f in text.lower()]:
        raise ValueError(f"claims too much: {', '.join(found)}")
    return text


@dataclass
class Context:
    spark: SparkSession
    config: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)
    manifest: dict = field(default_factory=lambda: {"stages": [], "warnings": [], "started": datetime.now(UTC).isoformat()})


Stage = Callable[[Context], dict[str, DataFrame]]


class Pipeline:
    """Named stages in order. A stage takes the context and returns tables that later stages read; Spark runs what is used."""

    def __init__(self) -> None:
        self.stages: dict[str, Stage] = {}

    def stage(self, name: str) -> Callable[[Stage], Stage]:
        def add(f: Stage) -> Stage:
            self.stages[name] = f
            return f

        return add

    def select(self, wanted: str | Iterable[str] | None = None, skip: Iterable[str] = ()) -> list[str]:
        names = list(self.stages) if wanted in (None, "all") else [n.strip() for n in (wanted.split(",") if isinstance(wanted, str) else wanted)]
        if bad := [n for n in [*names, *skip] if n not in self.stages]:
            raise ValueError(f"unknown stages: {', '.join(bad)}")
        return [n for n in self.stages if n in names and n not in set(skip)]

    def run(self, ctx: Context, wanted: str | Iterable[str] | None = None, skip: Iterable[str] = (), fail_fast: bool | None = None, dry_run: bool | None = None) -> Context:
        """Unset flags come from the configuration. A failing stage is noted and, unless fail_fast, passed over."""
        fail_fast = ctx.config.get("fail_fast", True) if fail_fast is None else fail_fast
        dry_run = ctx.config.get("dry_run", False) if dry_run is None else dry_run
        for name in self.select(wanted, skip):
            note: dict = {"name": name, "status": "planned" if dry_run else "done"}
            if not dry_run:
                try:
                    ctx.tables |= self.stages[name](ctx)
                except Exception as e:
                    note |= {"status": "failed", "error": str(e)[:500]}
                    if fail_fast:
                        ctx.manifest["stages"].append(note)
                        raise
            ctx.manifest["stages"].append(note)
        return ctx


def status(manifest: dict) -> str:
    return "; ".join(f"{s['name']}: {s['status']}" for s in manifest["stages"])
