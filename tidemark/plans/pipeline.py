"""A whole run: a folder of tables in, ranked findings with evidence out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import discovery, fact, periods
from ..schema import CANONICAL, FactSchema, Settings
from ..session import held
from ..sources import tables
from . import narrative, ranking, report
from .findings import Finder, Finding, read_columns, test_causes


@dataclass
class Result:
    source: str
    profiles: dict[str, discovery.TableProfile]
    joins: list[discovery.Join]
    findings: list[Finding]
    summary: str
    by_model: bool
    seconds: float
    monthly: list[tuple[str, float]] = field(default_factory=list)
    quarterly: list[tuple[str, float]] = field(default_factory=list)


def run(spark: SparkSession, folder: str, settings: Settings = Settings(), schema: FactSchema = FactSchema(), model: narrative.Model | None = None, exact_profile: bool = True) -> Result:
    """Load, profile, detect, test, rank and describe. A row limit samples orders and keeps what refers to them."""
    began = time.time()
    found = tables.canonical(tables.load_raw(spark, folder))
    if settings.row_limit and CANONICAL["orders"] in found:
        found = tables.sample_orders(found, settings.row_limit, settings.seed)
    profiles = {name: discovery.profile_table(name, df, exact_profile) for name, df in found.items()}
    joins = discovery.discover_joins(found, settings.join_overlap)
    with held(read_columns(fact.build_fact(found, schema), schema)) as facts:
        candidates = test_causes(Finder(facts, found, settings, schema).run(), facts, settings, schema)
        ranked = ranking.rank(candidates, settings.top_findings, diversity=False)
        shapes = [{"name": p.name, "rows": p.n_rows, "cols": len(p.dtypes), "missing": p.missing} for p in profiles.values()]
        by_model, words, chosen = narrative.decide(ranked, shapes, settings.top_findings, model)
        series = {p: [(r["period"], r["revenue"]) for r in periods.series(facts, p, schema).select("period", "revenue").orderBy(F.col("period")).collect()] for p in ("month", "quarter")}
    return Result(folder, profiles, joins, chosen, words, by_model, time.time() - began, series["month"], series["quarter"])


def to_report(spark: SparkSession, folder: str, out: str, settings: Settings = Settings(), model: narrative.Model | None = None) -> dict[str, Path]:
    return report.write(run(spark, folder, settings, model=model), out)
