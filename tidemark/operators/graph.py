"""Regions in which a category sells more than elsewhere, pairs bought together, and communities of such pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..schema import FactSchema
from .cooccurrence import co_occurrence
from .periods import money

#: Edges that are partitioned by default, the strongest: a report over the top pairs, as in the reference. None takes all.
TOP_EDGES = 800


def geo_lift(fact: DataFrame, min_orders: int = 30, schema: FactSchema = FactSchema()) -> DataFrame:
    """(state, category, lift, share_state, revenue, n_orders): a category's share of a state's revenue over its share of all revenue.

    Rows without revenue, state or category are left out, and so are cells with fewer than ``min_orders`` different orders or
    whose state or category has no revenue in sum. The cells are few: totals are windows over them, not over the rows.
    """
    rows = fact.where(F.col(schema.revenue_col).isNotNull() & F.col(schema.state_col).isNotNull() & F.col(schema.category_col).isNotNull())
    cells = rows.groupBy(F.col(schema.state_col).alias("state"), F.col(schema.category_col).alias("category")).agg(money(schema.revenue_col).alias("revenue"), F.count_distinct(schema.order_col).alias("n_orders"))
    whole = cells.agg(F.sum("revenue").alias("_all"))
    cells = cells.withColumns({"_state": F.sum("revenue").over(Window.partitionBy("state")), "_category": F.sum("revenue").over(Window.partitionBy("category"))})
    cells = cells.join(F.broadcast(whole))  # one row
    share, base = F.try_divide("revenue", "_state"), F.try_divide("_category", "_all")
    found = cells.where(F.col("n_orders") >= min_orders).withColumns({"share_state": share, "_base": base}).where("_state <> 0 AND _base <> 0")
    return found.select("state", "category", (F.col("share_state") / F.col("_base")).alias("lift"), "share_state", "revenue", "n_orders")


def pair_lift(fact: DataFrame, min_support: float = 0.001, min_count: int = 20, schema: FactSchema = FactSchema()) -> DataFrame:
    """(item_a, item_b, lift, support, n_orders): category pairs in at least ``min_count`` orders and ``min_support`` of those with a category.

    An empty category is no item, but its order counts. Pairs come from the Gram matrix of the orders' category sets.
    """
    rows = fact.where(F.col(schema.category_col).isNotNull()).select(schema.order_col, schema.category_col)
    pairs = co_occurrence(rows, schema.order_col, schema.category_col).where("item_a <> '' AND item_b <> ''")
    pairs = pairs.withColumn("support", F.col("n_ab") / F.col("n"))
    return pairs.where((F.col("n_ab") >= min_count) & (F.col("support") >= min_support)).select("item_a", "item_b", "lift", "support", F.col("n_ab").alias("n_orders"))


def order_categories(fact: DataFrame, schema: FactSchema = FactSchema()) -> DataFrame:
    """(order_id, categories): each order's different categories, in order."""
    rows = fact.where(F.col(schema.category_col).isNotNull() & F.col(schema.order_col).isNotNull())
    return rows.groupBy(schema.order_col).agg(F.sort_array(F.collect_set(schema.category_col)).alias("categories"))


def communities(pairs: DataFrame, top_edges: int | None = TOP_EDGES) -> DataFrame:
    """(community, item): a partition of the graph of the strongest pairs, weighted by lift - 1 where that is above 0.

    The report is on the ``top_edges`` pairs of highest lift (then by name); None takes all pairs, which the driver must hold. Communities are numbered by size, then name.
    """
    best = pairs.orderBy(F.desc("lift"), "item_a", "item_b")
    best = (best if top_edges is None else best.limit(top_edges)).select("item_a", "item_b", (F.col("lift") - 1).alias("w")).collect()
    found = kernels.communities([(r["item_a"], r["item_b"], r["w"]) for r in best])
    return pairs.sparkSession.createDataFrame([(i, x) for i, c in enumerate(found) for x in c], "community int, item string")
