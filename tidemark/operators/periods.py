"""Series over time, changes between periods and outlying periods. Only per-period aggregates are ever ordered as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FactSchema


def money(column: str | Column) -> Column:
    """A sum that does not depend on the order of its rows: in units of 0.0001, null counting as 0, 0 for no rows."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(c.cast("decimal(20,4)")), F.lit(0).cast("decimal(30,4)")).cast("double")


def series(fact: DataFrame, period: str = "quarter", schema: FactSchema = FactSchema()) -> DataFrame:
    """(period, revenue, orders, items, avg_order_value, items_per_order) of each period present; rows without a time are left out."""
    found = fact.where(F.col(period).isNotNull()).groupBy(F.col(period).alias("period"))
    found = found.agg(money(schema.revenue_col).alias("revenue"), F.count_distinct(schema.order_col).alias("orders"), F.count("*").alias("items"))
    return found.withColumns({"avg_order_value": F.try_divide("revenue", "orders"), "items_per_order": F.try_divide("items", "orders")})


def monthly_filled(fact: DataFrame, schema: FactSchema = FactSchema()) -> DataFrame:
    """(period, revenue, orders) of every month from the first to the last, months without rows being 0; no rows for an empty table."""
    seen = fact.where(F.col("month").isNotNull()).groupBy(F.trunc("day", "month").alias("start")).agg(money(schema.revenue_col).alias("revenue"), F.count_distinct(schema.order_col).alias("orders"))
    calendar = seen.agg(F.sequence(F.min("start"), F.max("start"), F.expr("interval 1 month")).alias("m")).select(F.explode("m").alias("start"))
    both = calendar.join(seen, "start", "left")
    return both.select(F.date_format("start", "yyyy-MM").alias("period"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"), F.coalesce("orders", F.lit(0)).alias("orders"))


def daily(fact: DataFrame, schema: FactSchema = FactSchema()) -> DataFrame:
    """(quarter, day, orders, revenue) of each day with rows."""
    return fact.where(F.col("day").isNotNull()).groupBy("quarter", "day").agg(F.count_distinct(schema.order_col).alias("orders"), money(schema.revenue_col).alias("revenue"))


def period_days(fact: DataFrame, period: str = "quarter") -> DataFrame:
    """(period, days): on how many different days each period has rows."""
    return fact.where(F.col(period).isNotNull()).groupBy(F.col(period).alias("period")).agg(F.count_distinct("day").alias("days"))


def changes(fact: DataFrame, period: str = "quarter", min_change: float = 0.12, min_rows: int = 50, schema: FactSchema = FactSchema()) -> DataFrame:
    """(metric, period, prev_period, base_value, comp_value, delta_pct, n_base, n_comp): changes of revenue and orders between periods that follow each other among those present.

    Pairs in which either period has fewer than ``min_rows`` rows or whose base is 0 are left out, and so are changes below ``min_change``.
    """
    s = series(fact, period, schema)
    each = s.select("period", "items", F.explode(F.array(F.struct(F.lit("revenue").alias("metric"), F.col("revenue").alias("value")), F.struct(F.lit("orders").alias("metric"), F.col("orders").cast("double").alias("value")))).alias("m")).select("period", "items", "m.*")
    w = Window.partitionBy("metric").orderBy("period")
    pairs = each.withColumns({"prev_period": F.lag("period").over(w), "base_value": F.lag("value").over(w), "n_base": F.lag("items").over(w)})
    delta = F.try_divide(F.col("value") - F.col("base_value"), F.col("base_value"))
    pairs = pairs.where("prev_period IS NOT NULL AND base_value <> 0").withColumn("delta_pct", delta)
    pairs = pairs.where((F.col("n_base") >= min_rows) & (F.col("items") >= min_rows) & (F.abs("delta_pct") >= min_change))
    return pairs.select("metric", "period", "prev_period", "base_value", F.col("value").alias("comp_value"), "delta_pct", "n_base", F.col("items").alias("n_comp"))


def rolling_z(s: DataFrame, value: str = "revenue", order: str = "period", window: int = 6, min_periods: int = 3) -> DataFrame:
    """s with ``median``, ``mad`` and ``z_score``: how far a value lies from the median around it, in medians of such distances.

    The frame of a row holds ``window`` rows around it (one more before than after if even). Fewer than ``min_periods`` values that are not null give null, and
    so does a distance median of 0. Each distance is from its own row's median. s must be a series of periods: it is ordered as a whole.
    """
    before = window // 2
    frame = Window.orderBy(order).rowsBetween(-before, window - 1 - before)
    middle = lambda c: F.when(F.count(c).over(frame) >= min_periods, F.percentile(c, 0.5).over(frame))
    found = s.withColumn("median", middle(value)).withColumn("_off", F.abs(F.col(value) - F.col("median")))
    found = found.withColumn("mad", middle("_off")).drop("_off")
    return found.withColumn("z_score", F.when(F.col("mad") != 0, (F.col(value) - F.col("median")) / F.col("mad")))


def outlying_months(fact: DataFrame, z: float = 2.0, min_orders: int = 200, window: int = 6, min_periods: int = 3, schema: FactSchema = FactSchema()) -> DataFrame:
    """(period, revenue, orders, median, z_score, excess): months at least ``z`` away from their surroundings, the last (partial) month and months of few orders left out."""
    s = rolling_z(monthly_filled(fact, schema), "revenue", "period", window, min_periods)
    last = F.max("period").over(Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("_last", last).where((F.abs("z_score") >= z) & (F.col("period") != F.col("_last")) & (F.col("orders") >= min_orders) & (F.col("median") != 0))
    return s.select("period", "revenue", "orders", "median", "z_score", (F.col("revenue") / F.col("median") - 1).alias("excess"))
