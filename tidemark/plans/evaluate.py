"""Whether a run recovers the anomalies that were put into generated data, and finds none of them in clean data."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from ..schema import Settings
from ..sources import synthetic
from ..sources.tables import write_csv
from . import pipeline
from .findings import Finding


def matches(f: Finding, key: str, shape: synthetic.Shape = synthetic.Shape()) -> bool:
    """Whether a finding reports the anomaly: ``drop``, ``region`` or ``spike``."""
    h = f.headline
    if key == "drop":
        return f.kind == "time_change" and f.target_metric == "revenue" and h["period"] == shape.drop[0] and h["delta_pct"] < -0.15
    if key == "region":
        return f.kind == "graph" and (h.get("state"), h.get("category")) == shape.region[:2]
    return f.kind == "time_anomaly" and h["period"] == shape.spike[0] and h["z_score"] >= 2.0


def evaluate(spark: SparkSession, folder: str, shape: synthetic.Shape = synthetic.Shape(), settings: Settings = Settings(), seed: int = 42) -> dict[str, dict]:
    """anomaly -> {recovered, rank, score, verified, ghosted}; also written to folder/eval.md."""
    found = {}
    for kind in ("clean", "injected"):
        write_csv(synthetic.sales(spark, shape, kind == "injected", seed), f"{folder}/{kind}")
        found[kind] = pipeline.run(spark, f"{folder}/{kind}", settings).findings
    rows = {}
    for key in ("drop", "region", "spike"):
        hit = next((f for f in found["injected"] if matches(f, key, shape)), None)
        ghost = any(matches(f, key, shape) for f in found["clean"])
        rows[key] = {"recovered": hit is not None, "rank": hit.rank if hit else None, "score": hit.score if hit else None, "verified": bool(hit and any(e.verified for e in hit.evidence)), "ghosted": ghost}
    Path(folder, "eval.md").write_text("# Recovery of known anomalies\n\n" + "\n".join(f"- {k}: {v}" for k, v in rows.items()) + "\n")
    return rows
