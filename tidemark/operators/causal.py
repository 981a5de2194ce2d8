"""Whether a change survives controls: a panel of state and category, least squares on it, and a verdict."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..schema import FactSchema, Settings
from .periods import money

CONTROLS = ("n_items", "avg_price", "freight_ratio", "reviews_mean", "review_rate")
#: Rows of a panel that come to the driver: states x categories x 2 are far fewer.
PANEL_ROWS = 200_000


@dataclass(frozen=True)
class Verdict:
    verdict: str
    method: str
    effect: float | None = None
    p_value: float | None = None
    interval: tuple[float, float] | None = None
    details: list[str] = field(default_factory=list)


def panel(fact: DataFrame, period: str, prev_period: str, schema: FactSchema = FactSchema()) -> DataFrame:
    """One row per state, category and period with revenue, orders, controls and ``treatment`` (1 in the later period).

    Null states and categories are left out, and so are cells without a price. Ratios over 0 are null; reviews that are no numbers count as none.
    """
    return sided(cells(fact, (period, prev_period), schema), period, prev_period)


def cells(fact: DataFrame, quarters: Sequence[str], schema: FactSchema = FactSchema()) -> DataFrame:
    """panel() of any number of quarters, without ``treatment``."""
    rows = fact.where(F.col("quarter").isin(list(quarters)) & F.col(schema.state_col).isNotNull() & F.col(schema.category_col).isNotNull())
    score = F.col("review_score").cast("string").try_cast("double")
    found = rows.groupBy(F.col(schema.state_col).alias("state"), F.col(schema.category_col).alias("category"), F.col("quarter").alias("period")).agg(
        money(schema.revenue_col).alias("revenue"), F.count_distinct(schema.order_col).alias("orders"), F.count("*").alias("n_items"), F.try_divide(money("price"), F.count("price").cast("double")).alias("avg_price"),
        money("freight_value").alias("freight_total"), money("price").alias("price_total"), F.avg(score).alias("reviews_mean"), F.count(score).alias("reviews_count"),
    )
    return found.where("avg_price IS NOT NULL").withColumns({
        "freight_ratio": F.try_divide("freight_total", F.nullif("price_total", F.lit(0.0))), "review_rate": F.col("reviews_count") / F.col("n_items"),
    })


def sided(found: DataFrame, period: str, prev_period: str) -> DataFrame:
    """The panel of two periods among the quarters of cells()."""
    return found.where(F.col("period").isin(period, prev_period)).withColumn("treatment", (F.col("period") == period).cast("int"))


def gram_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, total): sums of products of each pair of columns over rows in which none is null or infinite, ``const`` being 1: X'X of any number of rows in one pass."""
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    names = [*columns, "const"]
    rows = df.where(good).withColumn("const", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.agg(*(F.coalesce(F.sum(F.col(a).cast("double") * F.col(b).cast("double")), F.lit(0.0)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{k}").alias("total")) for k, (a, b) in enumerate(pairs)))).alias("s")).select("s.*")


def collected(cells: DataFrame | dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The columns of a panel on the driver; what came there before stays as it is."""
    if isinstance(cells, dict):
        return cells
    found = cells.orderBy("treatment", "state", "category").limit(PANEL_ROWS + 1).toPandas()
    if len(found) > PANEL_ROWS:
        raise ValueError(f"a panel has at most {PANEL_ROWS} rows")
    return {c: found[c].to_numpy() for c in found.columns}


def _complete(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    data = np.column_stack([np.asarray(c, dtype="float64") for c in columns])
    data[~np.isfinite(data)] = np.nan
    good = ~np.isnan(data).any(axis=1)
    return data[good], good


def test_change(cells: DataFrame | dict[str, np.ndarray], settings: Settings = Settings()) -> Verdict:
    """Revenue on treatment and controls: supported if p < alpha and the bootstrap interval excludes 0, confounded if p is weak, else spurious."""
    data = collected(cells)
    if len(data["revenue"]) < settings.panel_rows:
        return Verdict("insufficient_data", "panel too sparse", details=[f"fewer than {settings.panel_rows} panel rows"])
    controls = [c for c in CONTROLS if not np.isnan(data[c].astype("float64")).all()]
    rows, _ = _complete([data["revenue"], data["treatment"], *(data[c] for c in controls)])
    if len(rows) < settings.regression_rows:
        return Verdict("insufficient_data", "too few complete rows", details=["controls mostly missing"])
    y, x = rows[:, 0], np.hstack([rows[:, 1:], np.ones((len(rows), 1))])
    coef, p, _ = kernels.least_squares(x, y)
    low, high = kernels.coefficient_interval(x, y, settings.regression_draws, settings.seed)
    effect, p_value, clear = float(coef[0]), float(p[0]), not low <= 0 <= high
    method = "OLS with controls"
    if p_value < settings.alpha and clear:
        return Verdict("supported", method, effect, p_value, (low, high), ["the effect survives the controls and its interval excludes 0", "the periods follow each other, which is taken as precedence"])
    if p_value < settings.weak_p:
        return Verdict("confounded", method, effect, p_value, (low, high), ["the effect weakens with the controls; confounding cannot be ruled out"])
    return Verdict("spurious", method, effect, p_value, (low, high), ["no effect of its own once the controls are in"])


def test_segment(cells: DataFrame | dict[str, np.ndarray], dim: str, entity: str, settings: Settings = Settings()) -> Verdict | None:
    """Revenue on membership in a segment (dim: state or category), controls and the values of the dimension; None if there are too few rows.

    Membership is also among the dummies of its dimension, so the two share the effect (minimum norm).
    """
    data = collected(cells)
    if len(data["revenue"]) < settings.panel_rows:
        return None
    values = np.array([str(v) for v in data[dim]])
    dummies = [(values == v).astype(float) for v in sorted(set(values))[1:]]
    rows, _ = _complete([data["revenue"], (values == entity).astype(float), *(data[c] for c in CONTROLS), *dummies])
    if len(rows) < settings.regression_rows:
        return None
    coef, p, _ = kernels.least_squares(np.hstack([rows[:, 1:], np.ones((len(rows), 1))]), rows[:, 0])
    good = bool(p[0] < settings.alpha)
    return Verdict("supported" if good else "spurious", "OLS with segment and controls", float(coef[0]), float(p[0]), None, ["the segment goes with revenue beyond the controls" if good else "no association of its own"])


def linked(cells: DataFrame, settings: Settings = Settings()) -> list[tuple[str, str]]:
    """Pairs of panel variables that no others make independent (partial correlations); [] with too few rows."""
    names = ("revenue", "avg_price", "freight_ratio", "n_items")
    data = collected(cells)
    rows, _ = _complete([data[c] for c in names])
    if len(rows) < settings.panel_rows:
        return []
    return sorted((names[i], names[j]) for i, j in kernels.skeleton(rows, settings.alpha))
