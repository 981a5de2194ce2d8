"""A plain star schema (customer, orders, lineitem, part, supplier, nation) under the canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CANONICAL


def star_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Lines are items (freight is price times tax), nations are states, market segments are cities and part types are categories."""
    t = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("lineitem", "orders", "customer", "part", "supplier", "nation")}
    nation = t["nation"].select("n_nationkey", "n_name")
    made = {
        "items": t["lineitem"].select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"), F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value")),
        "orders": t["orders"].select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"), F.col("o_orderdate").alias("order_purchase_timestamp")),
        "customers": t["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("customer_state"), F.col("c_mktsegment").alias("customer_city")),
        "products": t["part"].select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name")),
        "sellers": t["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state")),
    }
    return {CANONICAL[role]: df for role, df in made.items()}
