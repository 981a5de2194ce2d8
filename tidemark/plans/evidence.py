"""SQL that recomputes a finding's number from the base tables, by another path than the fact table.

Values are bound, never spliced in. The texts run on Spark as they are; where no value is bound they are ANSI but for <=>.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_REVENUE = "price + coalesce(freight_value, 0.0)"
_KEPT = "NOT (order_status <=> 'canceled')"
_PERIOD = "year(order_purchase_timestamp) = :{0}_year AND quarter(order_purchase_timestamp) = :{0}_quarter"
_NAMED = "order_items JOIN orders USING (order_id) JOIN products USING (product_id) JOIN categories USING (product_category_name)"

HEADLINE = f"""WITH base AS (SELECT SUM({_REVENUE}) AS revenue, COUNT(DISTINCT order_id) AS orders FROM order_items JOIN orders USING (order_id) WHERE {_KEPT} AND {_PERIOD.format("base")}),
comp AS (SELECT SUM({_REVENUE}) AS revenue, COUNT(DISTINCT order_id) AS orders FROM order_items JOIN orders USING (order_id) WHERE {_KEPT} AND {_PERIOD.format("comp")})
SELECT CAST(base.{{metric}} AS DOUBLE) AS base_value, CAST(comp.{{metric}} AS DOUBLE) AS comp_value,
  CASE WHEN base.{{metric}} <> 0 THEN CAST(comp.{{metric}} - base.{{metric}} AS DOUBLE) / base.{{metric}} END AS delta_pct FROM base CROSS JOIN comp"""
MONTHLY = f"""SELECT SUM({_REVENUE}) AS revenue, COUNT(DISTINCT order_id) AS orders FROM order_items JOIN orders USING (order_id)
WHERE {_KEPT} AND year(order_purchase_timestamp) = :year AND month(order_purchase_timestamp) = :month"""
SEGMENT = f"""SELECT SUM(CASE WHEN {_PERIOD.format("base")} THEN {_REVENUE} END) AS base_value, SUM(CASE WHEN {_PERIOD.format("comp")} THEN {_REVENUE} END) AS comp_value
FROM {{tables}} WHERE {_KEPT} AND {{dimension}} = :entity"""
GEO = f"""SELECT product_category_name_english AS category, SUM({_REVENUE}) AS revenue FROM {_NAMED} JOIN customers USING (customer_id)
WHERE {_KEPT} AND customer_state = :state AND product_category_name_english = :category GROUP BY 1 ORDER BY 2 DESC"""
AFFINITY = f"""SELECT count(*) AS n FROM (
  SELECT order_id FROM {_NAMED} WHERE product_category_name_english = :a AND {_KEPT}
  INTERSECT SELECT order_id FROM {_NAMED} WHERE product_category_name_english = :b AND {_KEPT}) AS both_items"""
CORRELATION = f"SELECT corr({{a}}, {{b}}) AS r FROM order_items JOIN orders USING (order_id) WHERE {_KEPT} AND ({{a}}) IS NOT NULL AND ({{b}}) IS NOT NULL"
# what a column of the fact is in the base tables
BASE_COLUMN = {"price": "price", "freight_value": "freight_value", "revenue": f"({_REVENUE})"}
# the tables that a dimension needs
BASE_TABLES = {
    "customer_state": "order_items JOIN orders USING (order_id) JOIN customers USING (customer_id)",
    "customer_city": "order_items JOIN orders USING (order_id) JOIN customers USING (customer_id)",
    "product_category_name_english": _NAMED,
}


@dataclass(frozen=True)
class Evidence:
    kind: str
    code: str
    preview: str = ""
    verified: bool = False


def period_args(name: str, period: str) -> dict[str, int]:
    """The bound values for a quarter such as 2018Q3."""
    year, quarter = period.split("Q")
    return {f"{name}_year": int(year), f"{name}_quarter": int(quarter)}


#: Rows that are shown of an answer.
SHOWN = 5


@dataclass(frozen=True)
class Asked:
    """A statement with its bound values, and what ``column`` of its first row should be within ``tolerance``."""

    sql: str
    args: dict
    expected: float | None
    column: str
    tolerance: float
    snippet: str = ""


def preview(columns: Sequence[str], seen: Sequence[Sequence], rows: int = SHOWN) -> str:
    """The first rows as text, and whether there are more."""
    lines = [" | ".join(columns), *(" | ".join(str(v) for v in r) for r in seen[:rows])]
    return "\n".join([*lines, "..."] if len(seen) > rows else lines)


def _ran(spark: SparkSession, a: Asked) -> list[Evidence]:
    shown = "\n".join([a.sql, *(f"-- :{k} = {v!r}" for k, v in a.args.items())])
    try:
        found = spark.sql(a.sql, args=a.args)
        seen = found.limit(SHOWN + 1).collect()
        text, actual = preview(found.columns, seen), seen[0][a.column] if seen else None
        good = bool(a.expected) and actual is not None and abs(float(actual) - a.expected) <= a.tolerance * abs(a.expected)
    except Exception as e:  # noqa: BLE001
        text, good = f"# failed: {str(e).splitlines()[0]}", False
    made = [Evidence("sql", shown, text, good)]
    return [*made, Evidence("python", a.snippet)] if a.snippet else made


def sold(spark: SparkSession) -> DataFrame:
    """The join that the texts begin with, as a plan that Spark finds in theirs."""
    return spark.table("order_items").join(spark.table("orders"), "order_id")


def check(spark: SparkSession, asked: Sequence[Asked]) -> list[list[Evidence]]:
    """For each statement its text with the bound values, what it gives, and whether that is what was found.

    Each runs once. The join of items and orders, which all texts begin with, is kept meanwhile: Spark puts it in wherever a plan has it. A statement that
    fails is shown with its failure and is not verified; the run goes on.
    """
    if not asked:
        return []
    joined = sold(spark).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return [_ran(spark, a) for a in asked]
    finally:
        joined.unpersist()
