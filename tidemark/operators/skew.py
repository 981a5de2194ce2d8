"""Aggregation and joins that stay balanced when a few keys hold most rows.

The heavy keys come from Spark's mergeable frequent-items sketch: one pass, no shuffle of rows, and no key above the
asked share can be missing from its answer. They decide only how work is spread, never which rows count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small

#: A key is heavy from this share of the rows on, or from half a core's share where that is less; never below LEAST_SHARE: at most 1 / LEAST_SHARE keys can be heavy.
HEAVY_SHARE, LEAST_SHARE = 0.01, 1e-4
#: Parts that a heavy key is split into, per core of the cluster.
SALTS_PER_CORE = 2
#: Instead of a list of heavy keys: every key is split. For aggregates whose partials are few rows per key, this spares the pass that looks for the heavy ones.
EVERY = ("every key",)
#: Heavy keys found in this application, by what they were found in: they only decide how work is spread.
_found: dict[tuple, list] = {}


def salt_count(df: DataFrame) -> int:
    """Parts for a heavy key: follows the cluster, not the data, so that one key can fill all cores."""
    return max(8, SALTS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def heavy_share(df: DataFrame) -> float:
    """The share of rows from which a key would keep one core busy for longer than the others."""
    return max(LEAST_SHARE, min(HEAVY_SHARE, 0.5 / df.sparkSession.sparkContext.defaultParallelism))


def heavy_keys(df: DataFrame, key: str, share: float | None = None) -> list:
    """All non-null values of ``key`` that hold at least ``share`` of the rows (by default heavy_share()), perhaps with some lighter ones.

    An empty table has none. The list has at most about 1 / share entries, whatever the size of df.
    """
    share = share or heavy_share(df)
    rows = df.select(F.col(key).alias("k")).where("k IS NOT NULL")
    plan = (df.sparkSession.sparkContext.applicationId, rows.semanticHash(), share)
    if plan not in _found:
        found = rows.stat.freqItems(["k"], share).first()
        if len(_found) >= 1000:
            _found.clear()
        _found[plan] = sorted(found[0] or []) if found else []
    return _found[plan]


def salt(key: str | Column, spread: Sequence[str | Column], heavy: list | tuple, salts: int) -> Column:
    """0 for light keys, else a number below ``salts`` that depends on the columns ``spread`` alone: a repeated task gives the same."""
    if not heavy:
        return F.lit(0)
    part = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    if heavy is EVERY:
        return part
    return F.when((F.col(key) if isinstance(key, str) else key).isin(heavy), part).otherwise(F.lit(0))


#: name of the merge for each partial
_MERGES = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "distinct": F.sum}


def salted_aggregate(
    df: DataFrame,
    key: str,
    measures: dict[str, tuple[str, str]],
    entity: Sequence[str],
    share: float | None = None,
    heavy: list | tuple | None = None,
) -> DataFrame:
    """Per-key results in two stages: partials per key and salt, then a merge by key.

    measures: result name -> (count | sum | min | max | distinct, column). The salt of a row is a hash of ``entity``, so
    all rows of one entity meet in one part and ``distinct`` (the number of distinct entities; its column is not looked
    at) adds up exactly. Rows with a null key are left out; null values are ignored by sum, min and max, and an all-null
    sum is 0.0. An empty table gives no rows. Further columns of df are not read.
    """
    return merged(partials(df, key, measures, entity, share, heavy), key, measures)


def partials(df: DataFrame, key: str, measures: dict[str, tuple[str, str]], entity: Sequence[str], share: float | None = None, heavy: list | tuple | None = None) -> DataFrame:
    """The first stage of salted_aggregate(): (key, _salt, _p_NAME...), one row per key and salt."""
    rows = df.where(F.col(key).isNotNull())
    heavy = heavy_keys(rows, key, share) if heavy is None else heavy
    rows = rows.withColumn("_salt", salt(key, entity, heavy, salt_count(df)))
    if all(kind != "distinct" for kind, _ in measures.values()):
        return rows.groupBy(key, "_salt").agg(*_partials(measures))
    # distinct entities first: a shuffle on key, salt and entity, already reduced on the map side
    first = {n: (k, c) for n, (k, c) in measures.items() if k != "distinct"}
    rows = rows.groupBy(key, "_salt", *entity).agg(*_partials(first), F.lit(1).alias("_one"))
    made = [_MERGES[k](f"_p_{n}").alias(f"_p_{n}") for n, (k, _) in first.items()]
    made += [F.sum("_one").alias(f"_p_{n}") for n, (k, _) in measures.items() if k == "distinct"]
    return rows.groupBy(key, "_salt").agg(*made)


def merged(parts: DataFrame, key: str | Sequence[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """The second stage: partials added up by key (or keys)."""
    keys = [key] if isinstance(key, str) else list(key)
    return parts.groupBy(*keys).agg(*(_finish(kind, _MERGES[kind](f"_p_{name}")).alias(name) for name, (kind, _) in measures.items()))


def _partials(measures: dict[str, tuple[str, str]]) -> list[Column]:
    made = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    return [made[kind](column).alias(f"_p_{name}") for name, (kind, column) in measures.items()]


def _finish(kind: str, merged: Column) -> Column:
    return F.coalesce(merged, F.lit(0.0)) if kind == "sum" else merged


def salted_left(left: DataFrame, key: str, spread: Sequence[str], heavy: list, salts: int) -> DataFrame:
    """left with ``_salt``: the rows of heavy keys, and those without a key, are spread by a hash of the columns ``spread``."""
    part = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    return left.withColumn("_salt", F.when(F.col(key).isNull(), part).otherwise(salt(key, spread, heavy, salts)))


def salted_right(right: DataFrame, key: str, heavy: list, salts: int) -> DataFrame:
    """right with ``_salt``: the rows of heavy keys once per salt."""
    if not heavy:
        return right.withColumn("_salt", F.lit(0))
    every = F.when(F.col(key).isin(heavy), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return right.withColumn("_salt", F.explode(every))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str], how: str = "left", heavy: list | None = None) -> DataFrame:
    """left joined with a right side that has few rows per key, heavy keys of the left side split over many tasks.

    ``heavy`` may name the heavy keys where they were found more cheaply. The right rows of heavy keys are repeated once per salt. Null keys match nothing and, in
    a left join, stay in the result; they are spread by ``spread`` too. Columns besides the key must differ in name.
    """
    salts, heavy = salt_count(left), heavy_keys(left, key) if heavy is None else heavy
    return salted_left(left, key, spread, heavy, salts).join(salted_right(right, key, heavy, salts), [key, "_salt"], how).drop("_salt")


def lookup(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str], how: str = "left", found_in: DataFrame | None = None) -> DataFrame:
    """left joined with a right side that has few rows per key: sent to the rows if its size is within the bounds of a broadcast, else by salted_join().

    ``found_in``: a table with the same key in which the heavy keys are found more cheaply than in left.
    """
    if small(right):
        return left.join(F.broadcast(right), key, how)
    return salted_join(left, right, key, spread, how, heavy_keys(left if found_in is None else found_in, key))
