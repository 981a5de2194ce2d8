"""What a folder of tables looks like: a profile per table and the joins between tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CANONICAL

# How a name must end to be taken for a key, and words in a name that hint at time.
KEY_ENDS = ("_id", "_code", "_prefix", "id")
TIME_HINTS = ("date", "time", "timestamp", "_at", "day", "month", "year", "created", "updated")
#: Below this share of distinct values text counts as categorical.
CATEGORICAL = 0.5


@dataclass(frozen=True)
class TableProfile:
    name: str
    n_rows: int
    dtypes: dict[str, str]
    missing: dict[str, float]
    cardinality: dict[str, int]
    numeric_range: dict[str, tuple[float, float]]
    time_coverage: dict[str, tuple[Any, Any]] = field(default_factory=dict)


@dataclass(frozen=True)
class Join:
    left: str
    right: str
    column: str
    overlap: float


def is_key(name: str) -> bool:
    return name.lower().endswith(KEY_ENDS)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column_name, n_rows, missing, cardinality, low, high) of each column; low and high are text, null for columns that are neither numbers nor times.

    One pass. Cardinality is exact, or from a sketch; NaN is a value. An empty table has missing 0 and cardinality 0.
    """
    count = F.count_distinct if exact else F.approx_count_distinct
    sums, shown = [F.count("*").alias("n")], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        edged = is_number(f.dataType) or is_time(f.dataType)
        sums += [F.count(c).alias(f"c{i}"), count(c).alias(f"d{i}"), *(g(c if edged else F.lit(None)).cast("string").alias(f"{k}{i}") for g, k in ((F.min, "l"), (F.max, "h")))]
        shown.append(F.struct(F.lit(f.name).alias("column_name"), F.col("n").alias("n_rows"), F.coalesce(F.try_divide(F.col("n") - F.col(f"c{i}"), F.col("n")), F.lit(0.0)).alias("missing"), F.col(f"d{i}").alias("cardinality"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")))
    return df.agg(*sums).select(F.explode(F.array(*shown)).alias("s")).select("s.*")


def profile_table(name: str, df: DataFrame, exact: bool = True) -> TableProfile:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = {r["column_name"]: r for r in summary(df, exact).collect()}  # one row per column
    ranges = {c: (float(rows[c]["low"]), float(rows[c]["high"])) for c in kinds if is_number(kinds[c]) and rows[c]["low"] is not None}
    times = {c: (rows[c]["low"], rows[c]["high"]) for c in kinds if is_time(kinds[c])}
    n = next(iter(rows.values()))["n_rows"] if rows else 0
    return TableProfile(name, n, {c: k.simpleString() for c, k in kinds.items()}, {c: r["missing"] for c, r in rows.items()}, {c: r["cardinality"] for c, r in rows.items()}, ranges, times)


def logical_type(df: DataFrame, column: str) -> str:
    """bool, numeric, datetime, categorical or text. Text is datetime if its name hints at time and every value is one; a column of nulls is text."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return "bool"
    if is_number(kind):
        return "numeric"
    if is_time(kind):
        return "datetime"
    c = F.col(f"`{column}`").cast("string")
    seen = df.agg(F.count(c).alias("n"), F.count_distinct(c).alias("d"), F.count(c.try_cast("timestamp_ntz")).alias("t"), F.count("*").alias("all")).first()
    if seen["n"] and seen["t"] == seen["n"] and any(h in column.lower() for h in TIME_HINTS):
        return "datetime"
    return "categorical" if seen["n"] and seen["d"] / seen["all"] < CATEGORICAL else "text"


def overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(n_left, n_both): distinct non-null values of a column on the left and how many of them the right has. Counting by value, each side reduced first."""
    a = left.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    values = a.unionByName(b).groupBy("v").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return values.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("n_left"), F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("n_both"))


def discover_joins(tables: dict[str, DataFrame], least: float = 0.05) -> list[Join]:
    """Key columns that two tables share, with the share of the earlier table's values that the later one has (3 places), from ``least`` on.

    Columns of different families of types do not match. Products and translations are always joined.
    """
    names, found = list(tables), []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for c in sorted(set(tables[a].columns) & set(tables[b].columns)):
                left, right = tables[a].schema[c].dataType, tables[b].schema[c].dataType
                if not is_key(c) or is_number(left) != is_number(right):
                    continue
                n = overlap(tables[a], tables[b], c).first()
                share = round(n["n_both"] / n["n_left"], 3) if n["n_left"] else 0.0
                if share >= least:
                    found.append(Join(a, b, c, share))
    if CANONICAL["products"] in tables and CANONICAL["translations"] in tables:
        found.append(Join(CANONICAL["products"], CANONICAL["translations"], "product_category_name", 1.0))
    return found


def joins_text(joins: list[Join]) -> str:
    return "\n".join(f"{j.left}.{j.column} -> {j.right}.{j.column} ({j.overlap:.1%} of values)" for j in joins) or "no joins found"
