"""The fact table: one row per order item with everything the detectors group by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CANONICAL, FactSchema
from ..session import hinted
from .skew import heavy_keys, lookup, salt_count, salted_left, salted_right


def quarter(ts: Column) -> Column:
    """2018Q3"""
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def month(ts: Column) -> Column:
    """2018-07"""
    return F.date_format(ts, "yyyy-MM")


def no_nan(df: DataFrame, *columns: str) -> DataFrame:
    """The columns with null for NaN, as far as they are floating."""
    wanted = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in wanted})


def first_review(reviews: DataFrame) -> DataFrame:
    """(order_id, review_score): each order's first score that is not null, by date and then by score (dates may tie)."""
    order = F.struct("review_creation_date", "review_score") if "review_creation_date" in reviews.columns else F.struct("review_score")
    scored = reviews.where(F.col("review_score").isNotNull() & F.col("order_id").isNotNull())
    return scored.groupBy("order_id").agg(F.min_by("review_score", order).alias("review_score"))


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row for each non-null key: the one loaded last (by loaded_at and ingest_id as far as df has them, then by content)."""
    order = [c for c in ("loaded_at", "ingest_id") if c in df.columns]
    rest = [c for c in df.columns if c != key]
    latest = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_row"))
    return latest.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def build_fact(tables: dict[str, DataFrame], schema: FactSchema = FactSchema(), unique: bool = False) -> DataFrame:
    """Order items with their order, customer, product, category, seller and first review, plus revenue and period columns.

    revenue = price + freight, a null or missing freight being 0 and NaN being null; ``quarter``, ``month`` and ``day`` are null without a time. All joins
    keep every item; null keys match nothing; a dimension with several rows for a key repeats the item, unless ``unique`` keeps the last row of each order, customer, product, category and seller. Cancelled orders are
    removed after the joins, orders without a status are not. Categories without a table of translations keep the native name; without sellers or reviews those columns are null. A missing
    orders, items, customers or products table is an error. Small dimensions (counted) are sent to the rows, large ones shuffled.
    """
    missing = [CANONICAL[r] for r in ("orders", "items", "customers", "products") if CANONICAL[r] not in tables]
    if missing:
        raise KeyError(f"missing tables: {', '.join(missing)}")
    if unique:
        keys = {"orders": "order_id", "customers": "customer_id", "products": "product_id", "translations": "product_category_name", "sellers": "seller_id"}
        tables = {**tables, **{CANONICAL[r]: one_per_key(tables[CANONICAL[r]], k) for r, k in keys.items() if CANONICAL[r] in tables}}
    items, orders = tables[CANONICAL["items"]], tables[CANONICAL["orders"]]
    items = no_nan(items, "price", "freight_value")
    if "freight_value" not in items.columns:
        items = items.withColumn("freight_value", F.lit(0.0))
    own = ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value", "review_score")
    extra = [c for c in items.columns if c in own]
    # orders and reviews meet the items where these lie by order; what has no key, or a heavy one, is spread
    heavy, salts = heavy_keys(items, "order_id"), salt_count(items)
    order_rows = orders.select("order_id", "customer_id", schema.status_col, schema.time_col)
    fact = salted_left(items.select(*extra), "order_id", ["order_item_id", "product_id"], heavy, salts).join(salted_right(order_rows, "order_id", heavy, salts), ["order_id", "_salt"], "left")
    if "review_score" not in extra:
        if CANONICAL["reviews"] in tables:
            fact = fact.join(salted_right(first_review(tables[CANONICAL["reviews"]]), "order_id", heavy, salts), ["order_id", "_salt"], "left")
        else:
            fact = fact.withColumn("review_score", F.lit(None).cast("double"))
    customers = tables[CANONICAL["customers"]]
    fact = fact.drop("_salt")
    own = customers.select(*[c for c in ("customer_id", "customer_state", "customer_city") if c in customers.columns])
    fact = lookup(fact, own, "customer_id", ["order_id", "order_item_id"], found_in=orders)
    products = tables[CANONICAL["products"]].select("product_id", "product_category_name")
    if CANONICAL["translations"] in tables:
        names = tables[CANONICAL["translations"]].select("product_category_name", "product_category_name_english")
        products = products.join(hinted(names), "product_category_name", "left")
    else:
        products = products.withColumn("product_category_name_english", F.col("product_category_name"))
    fact = lookup(fact, products, "product_id", ["order_id", "order_item_id"], found_in=items)
    if CANONICAL["sellers"] in tables:
        fact = lookup(fact, tables[CANONICAL["sellers"]].select("seller_id", "seller_state"), "seller_id", ["order_id", "order_item_id"], found_in=items)
    else:
        fact = fact.withColumn("seller_state", F.lit(None).cast("string"))
    kept = F.lit(True)
    for word in schema.cancelled:
        kept = kept & ~F.col(schema.status_col).eqNullSafe(word)
    ts = F.col(schema.time_col)
    return (
        fact.where(kept)
        .withColumn(schema.revenue_col, F.col("price") + F.coalesce("freight_value", F.lit(0.0)))
        .withColumns({"quarter": quarter(ts), "month": month(ts), "day": F.to_date(ts)})
    )
