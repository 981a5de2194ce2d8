"""Where a change between two periods comes from: drill-down, movers and tests over days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FactSchema
from ..session import cut
from .periods import daily, money
from .significance import two_samples, volume_share

#: The columns of drill_down().
STEP = ("depth", "dimension", "entity", "base_value", "comp_value", "delta_pct", "contribution_pct", "n")
_STEP = "depth int, dimension string, entity string, base_value double, comp_value double, delta_pct double, contribution_pct double, n bigint"


def side(period: str, prev_period: str, column: str = "quarter") -> Column:
    """0 for rows of the earlier period, 1 for those of the later, else null."""
    return F.when(F.col(column) == prev_period, 0).when(F.col(column) == period, 1)


def _revenues(schema: FactSchema) -> list[Column]:
    """base and comp of the revenue, over rows that have their side in ``_side``."""
    return [money(F.when(F.col("_side") == s, F.col(schema.revenue_col))).alias(n) for s, n in ((0, "base"), (1, "comp"))]


def drill_down(fact: DataFrame, period: str, prev_period: str, metric: str = "revenue", max_depth: int = 3, schema: FactSchema = FactSchema()) -> DataFrame:
    """(depth, dimension, entity, base_value, comp_value, delta_pct, contribution_pct, n): the chain of values that moved most, dimension by dimension in the schema's order.

    At each depth the value with the largest absolute change is taken (the first in order on a tie) and only its rows go on. contribution_pct is its change over the change of the
    whole (0 if that is 0), n the different orders of the later period. Null values of a dimension are no values. Ends early when the earlier period has nothing left.
    """
    return fact.sparkSession.createDataFrame(drill_downs(fact, [(period, prev_period, metric)], max_depth, schema)[0], _STEP)


def drill_downs(fact: DataFrame, changes: Sequence[tuple[str, str, str]], max_depth: int = 3, schema: FactSchema = FactSchema()) -> list[list[tuple]]:
    """The rows of drill_down() for each of several (period, prev_period, metric), which are as many as periods.

    Each depth is one aggregate for all of them: a row meets those whose values so far are its own, and one row for each comes to the driver.
    """
    dims, steps = list(schema.dimensions[:max_depth]), [[] for _ in changes]
    if not changes:
        return steps
    rows = fact.where(F.col("quarter").isin(sorted({q for period, prev, _ in changes for q in (period, prev)})))
    sums = [money(schema.revenue_col).alias("revenue"), F.count_distinct(schema.order_col).alias("orders")]
    whole = {r["quarter"]: r for r in rows.groupBy("quarter").agg(*sums).collect()}  # one row per quarter
    total = lambda q, metric: float(whole[q][metric]) if q in whole else 0.0
    paths: dict[int, tuple] = {k: () for k in range(len(changes))}
    for depth, dim in enumerate(dims, start=1):
        passed = dims[: depth - 1]
        kind = T.StructType([T.StructField("_change", T.IntegerType()), T.StructField("_metric", T.StringType()), T.StructField("_side", T.IntegerType()), T.StructField("_q", T.StringType()), *(T.StructField(f"_d{i}", fact.schema[d].dataType) for i, d in enumerate(passed))])
        sides = fact.sparkSession.createDataFrame([(k, changes[k][2], s, changes[k][1 - s], *path) for k, path in paths.items() for s in (0, 1)], kind)
        same = F.col("quarter") == F.col("_q")
        for i, d in enumerate(passed):
            same = same & (F.col(d) == F.col(f"_d{i}"))
        met = rows.where(F.col(dim).isNotNull()).join(F.broadcast(sides), same)  # two rows per change
        each = met.groupBy("_change", "_metric", "_side", F.col(dim).alias("entity")).agg(*sums)
        each = each.withColumn("value", F.when(F.col("_metric") == "orders", F.col("orders").cast("double")).otherwise(F.col("revenue")))
        at = lambda s, c: F.coalesce(F.max(F.when(F.col("_side") == s, F.col(c))), F.lit(0))
        groups = each.groupBy("_change", "entity").agg(at(0, "value").alias("base"), at(1, "value").alias("comp"), at(1, "orders").alias("n"))
        moved = F.struct((-F.abs(F.col("comp") - F.col("base"))).alias("less"), "entity", "base", "comp", "n")
        found = groups.groupBy("_change").agg(F.sum("base").alias("total"), F.min(moved).alias("best")).where("total <> 0").collect()
        paths = {r["_change"]: (*paths[r["_change"]], r["best"]["entity"]) for r in sorted(found, key=lambda r: r["_change"])}
        for r in found:
            period, prev, metric = changes[r["_change"]]
            best, base, comp, change = r["best"], r["best"]["base"], r["best"]["comp"], total(period, metric) - total(prev, metric)
            steps[r["_change"]].append((depth, dim, str(best["entity"]), base, comp, (comp - base) / base if base else 0.0, (comp - base) / change if change else 0.0, best["n"]))
        if not paths:
            break
    return steps


def movers(fact: DataFrame, dim: str, base: str, comp: str, min_orders: int = 30, alpha: float = 0.05, schema: FactSchema = FactSchema()) -> DataFrame:
    """(entity, base_revenue, comp_revenue, delta_pct, base_orders, comp_orders, min_p, significant): change of each value of a dimension between two periods.

    Values with fewer than ``min_orders`` different orders on a side are left out. min_p is the smaller p of the two tests over the
    rows' revenues (1 where they do not apply); delta_pct is null for a base of 0.
    """
    rows = fact.withColumn("_side", side(comp, base)).where(F.col("_side").isNotNull() & F.col(dim).isNotNull()).withColumn("entity", F.col(dim))
    sums = rows.groupBy("entity").agg(
        *_revenues(schema), *(F.count_distinct(F.when(F.col("_side") == s, F.col(schema.order_col))).alias(f"{n}_orders") for s, n in ((0, "base"), (1, "comp"))),
    ).where((F.col("base_orders") >= min_orders) & (F.col("comp_orders") >= min_orders))
    tests = two_samples(rows, ["entity"], F.col("_side"), schema.revenue_col).select("entity", F.least("p_t", "p_u").alias("_p"))
    found = sums.join(tests, "entity", "left").withColumn("min_p", F.coalesce("_p", F.lit(1.0)))
    return found.select("entity", F.col("base").alias("base_revenue"), F.col("comp").alias("comp_revenue"), F.try_divide(F.col("comp") - F.col("base"), F.col("base")).alias("delta_pct"), "base_orders", "comp_orders", "min_p", (F.col("min_p") < alpha).alias("significant"))


def top_movers(found: DataFrame, k: int = 8) -> DataFrame:
    """The k largest changes, those without a change left out; ties by name."""
    return found.where("delta_pct IS NOT NULL").orderBy(F.desc("delta_pct"), "entity").limit(k)


def daily_tests(fact: DataFrame, period: str, prev_period: str, min_days: int = 10, min_rows: int = 8, schema: FactSchema = FactSchema()) -> DataFrame:
    """(name, statistic, p_value, effect_size, effect_name): orders and revenue per day of two periods held against each other.

    Welch and Mann-Whitney for each of the two if both periods have ``min_days`` days, and the exact test that the daily orders split evenly.
    """
    return daily_tests_of(fact, [(period, prev_period)], min_days, min_rows, schema).drop("pair")


def daily_tests_of(fact: DataFrame, pairs: Sequence[tuple[str, str]], min_days: int = 10, min_rows: int = 8, schema: FactSchema = FactSchema()) -> DataFrame:
    """(pair, ...) of daily_tests() for each of several (period, prev_period), numbered from 0: the days are added up once and tested together."""
    sides = fact.sparkSession.createDataFrame([(i, s, pair[1 - s]) for i, pair in enumerate(pairs) for s in (0, 1)], "pair int, _side int, quarter string")
    days = cut(daily(fact.where(F.col("quarter").isin(sorted({q for pair in pairs for q in pair}))), schema).join(F.broadcast(sides), "quarter"))  # two rows per pair
    long = days.select("pair", "_side", F.explode(F.array(F.struct(F.lit("orders").alias("m"), F.col("orders").cast("double").alias("x")), F.struct(F.lit("revenue").alias("m"), F.col("revenue").alias("x")))).alias("c")).select("pair", "_side", "c.*")
    t = two_samples(long, ["pair", "m"], F.col("_side"), "x", max(min_rows, min_days))
    each = F.array(
        F.struct(F.concat("m", F.lit(" | Welch t-test")).alias("name"), F.col("t").alias("statistic"), F.col("p_t").alias("p_value"), F.col("d").alias("effect_size"), F.lit("Cohen's d").alias("effect_name")),
        F.struct(F.concat("m", F.lit(" | Mann-Whitney U")).alias("name"), F.col("u").alias("statistic"), F.col("p_u").alias("p_value"), F.col("r").alias("effect_size"), F.lit("rank-biserial r").alias("effect_name")),
    )
    tests = t.select("pair", F.explode(each).alias("e")).select("pair", "e.*")
    sums = days.groupBy("pair").agg(*(F.coalesce(F.sum(F.when(F.col("_side") == s, F.col("orders"))), F.lit(0)).alias(n) for s, n in ((0, "b"), (1, "c"))))
    share, p, change = volume_share(F.col("b"), F.col("c"))
    volume = sums.where("b + c > 0").select("pair", F.lit("volume share test (binomial)").alias("name"), share.alias("statistic"), p.alias("p_value"), change.alias("effect_size"), F.lit("relative volume change").alias("effect_name"))
    return tests.unionByName(volume)
