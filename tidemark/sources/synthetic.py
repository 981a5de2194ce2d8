"""Sales tables with known anomalies, made on Spark from hashes: the same rows whatever the partitioning."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CANONICAL


@dataclass(frozen=True)
class Shape:
    """What a generated data set looks like and where its anomalies are."""

    states: tuple[tuple[str, float], ...] = (("SP", 0.30), ("RJ", 0.18), ("MG", 0.12), ("BA", 0.08), ("RS", 0.08), ("PR", 0.08), ("SC", 0.05), ("TS", 0.05), ("PE", 0.06))
    prices: tuple[tuple[str, float], ...] = (
        ("electronics", 900.0), ("computers", 1200.0), ("furniture", 420.0), ("sports", 200.0), ("fashion", 120.0),
        ("home", 150.0), ("books", 60.0), ("toys", 90.0), ("health", 80.0), ("food", 45.0),
    )
    first_year: int = 2019
    quarters: int = 8
    orders_per_quarter: int = 700
    customers: int = 3500
    cancelled_share: float = 0.025
    drop: tuple[str, float] = ("2020Q3", 0.45)
    spike: tuple[str, float] = ("2020-06", 4.0)
    region: tuple[str, str, float] = ("TS", "furniture", 5.0)


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on its arguments alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(p) if isinstance(p, str) else p for p in parts]), F.lit(1 << 40)) / float(1 << 40)


def normal(seed: int, *parts: Column | str) -> Column:
    """A standard normal number that depends on its arguments alone."""
    u, v = uniform(seed, *parts), uniform(seed + 1, *parts)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * F.lit(3.141592653589793) * v)


def _pick(u: Column, weighted: tuple[tuple[str, float], ...]) -> Column:
    total, upto, chosen = sum(w for _, w in weighted), 0.0, None
    for name, w in weighted:
        upto += w / total
        chosen = F.when(u < upto, name) if chosen is None else chosen.when(u < upto, name)
    return chosen.otherwise(weighted[-1][0])


def sales(spark: SparkSession, shape: Shape = Shape(), anomalies: bool = True, seed: int = 42) -> dict[str, DataFrame]:
    """Orders, items, customers, products, translations and sellers under canonical names; with ``anomalies`` prices drop in a quarter, leap in a month and are high for one category in one state."""
    customers = spark.range(shape.customers).select(F.concat(F.lit("c"), "id").alias("customer_id"), _pick(uniform(seed, "id"), shape.states).alias("customer_state"), F.concat(F.lit("city_"), F.col("id") % 40).alias("customer_city"))
    n = shape.quarters * shape.orders_per_quarter
    q, k = F.floor(F.col("id") / shape.orders_per_quarter).cast("int"), F.col("id") % shape.orders_per_quarter
    start = F.make_date(F.lit(shape.first_year) + F.floor(q / 4).cast("int"), (q % 4) * 3 + 1, F.lit(1))
    seconds = F.floor(uniform(seed + 10, "id") * 86_400).cast("int")
    when = F.date_add(start, (k % 88).cast("int")).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    orders = spark.range(n).select(
        "id", F.concat(F.lit("o"), "id").alias("order_id"), F.concat(F.lit("c"), F.col("id") % shape.customers).alias("customer_id"),
        F.when(uniform(seed + 20, "id") < shape.cancelled_share, "canceled").otherwise("delivered").alias("order_status"), when.alias("order_purchase_timestamp"),
    )
    sizes = F.element_at(F.array(*map(F.lit, (1, 1, 2, 2, 3))), (F.floor(uniform(seed + 30, "id") * 5) + 1).cast("int"))
    items = orders.join(customers.select("customer_id", "customer_state"), "customer_id").withColumn("n", sizes).withColumn("order_item_id", F.explode(F.sequence(F.lit(1), F.col("n"))))
    items = items.withColumn("category", _pick(uniform(seed + 40, "id", "order_item_id"), tuple((c, 1.0) for c, _ in shape.prices)))
    base = F.element_at(F.create_map(*[x for c, p in shape.prices for x in (F.lit(c), F.lit(p))]), F.col("category"))
    price = base * F.exp(0.22 * normal(seed + 50, "id", "order_item_id"))
    if anomalies:
        ts = F.col("order_purchase_timestamp")
        price = price * F.when(F.concat(F.year(ts), F.lit("Q"), F.quarter(ts)) == shape.drop[0], shape.drop[1]).otherwise(1.0)
        price = price * F.when(F.date_format(ts, "yyyy-MM") == shape.spike[0], shape.spike[1]).otherwise(1.0)
        price = price * F.when((F.col("customer_state") == shape.region[0]) & (F.col("category") == shape.region[1]), shape.region[2]).otherwise(1.0)
    freight = 5.0 + 8.0 * F.col("n") + F.abs(2 * normal(seed + 60, "id", "order_item_id"))
    number = F.element_at(F.create_map(*[x for i, (c, _) in enumerate(shape.prices) for x in (F.lit(c), F.lit(f"p{i}"))]), F.col("category"))
    seller = F.concat(F.lit("s"), "id", F.lit("_"), "order_item_id")
    rows = items.select("order_id", "order_item_id", number.alias("product_id"), seller.alias("seller_id"), F.round(price, 2).alias("price"), F.round(freight, 2).alias("freight_value"))
    products = spark.createDataFrame([(f"p{i}", c) for i, (c, _) in enumerate(shape.prices)], "product_id string, product_category_name string")
    names = products.select("product_category_name", F.col("product_category_name").alias("product_category_name_english"))
    made = {"orders": orders.drop("id"), "items": rows, "customers": customers, "products": products, "translations": names, "sellers": items.select(seller.alias("seller_id"), F.col("customer_state").alias("seller_state"))}
    return {CANONICAL[role]: df for role, df in made.items()}


# The same data set under another shop's names.
SPANISH = {
    "orders": ("transacciones", {"order_id": "txn_id", "customer_id": "account_id", "order_status": "fulfillment_status", "order_purchase_timestamp": "sales_datetime"}),
    "items": ("lineas_pedido", {"order_id": "txn_id", "order_item_id": "line_number", "product_id": "product_sku", "seller_id": "outlet_id", "price": "amount", "freight_value": "shipping"}),
    "customers": ("clientes", {"customer_id": "account_id", "customer_state": "province", "customer_city": "city"}),
    "products": ("catalogo", {"product_id": "product_sku", "product_category_name": "department"}),
    "translations": ("categorias", {"product_category_name": "department", "product_category_name_english": "category_en"}),
    "sellers": ("tiendas", {"seller_id": "outlet_id", "seller_state": "province"}),
}


def renamed(made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of sales() as a Spanish shop would name them; its word for cancelled orders is ``cancelado``."""
    found = {}
    for role, (table, columns) in SPANISH.items():
        df = made[CANONICAL[role]]
        if role == "orders":
            df = df.withColumn("order_status", F.when(F.col("order_status") == "canceled", "cancelado").otherwise("entregado"))
        found[table] = df.withColumnsRenamed(columns)
    return found


def spanish_sales(spark: SparkSession, shape: Shape = Shape(), anomalies: bool = True, seed: int = 42) -> dict[str, DataFrame]:
    """A Spanish shop's tables with two anomalies of their own: prices halve in the quarter and leap in the month of the shape, and no region stands out."""
    own = replace(shape, drop=(shape.drop[0], 0.5), region=(*shape.region[:2], 1.0))
    return renamed(sales(spark, own, anomalies, seed))
