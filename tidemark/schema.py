"""Roles of tables and columns, the names they are known by, and the settings of a run."""

from __future__ import annotations

from dataclasses import dataclass

# The canonical table of each role.
CANONICAL = {
    "orders": "olist_orders_dataset",
    "items": "olist_order_items_dataset",
    "customers": "olist_customers_dataset",
    "products": "olist_products_dataset",
    "translations": "product_category_name_translation",
    "sellers": "olist_sellers_dataset",
    "payments": "olist_order_payments_dataset",
    "reviews": "olist_order_reviews_dataset",
}

# Other table names that stand for a role, compared in lower case by letters and digits alone.
TABLE_NAMES = {
    "orders": ("orders", "orderheaders", "transactions", "salesheaders", "purchases", "saleheaders", "transacciones", "pedidos", "ventas"),
    "items": ("orderitems", "lineitems", "orderlines", "transactionlines", "salesitems", "purchaselines", "lineaspedido", "lineaspedidos", "detallepedido", "articulos"),
    "customers": ("customers", "accounts", "buyers", "clients", "customerdata", "clientes"),
    "products": ("products", "catalog", "productcatalog", "stock", "catalogo", "productos"),
    "translations": ("productcategorynametranslation", "categorytranslation", "categorytranslations", "categories", "categorias", "traducciones"),
    "sellers": ("sellers", "outlets", "stores", "vendors", "suppliers", "tiendas", "vendedores", "comercios"),
    "payments": ("payments", "orderpayments", "pagos"),
    "reviews": ("reviews", "orderreviews", "resenas"),
}

# The canonical columns of each role and the names they may have, the first present one winning.
COLUMN_NAMES = {
    "orders": {
        "order_id": ("order_id", "id", "txn_id", "transaction_id", "sale_id", "purchase_id", "invoice_id"),
        "customer_id": ("customer_id", "account_id", "client_id", "buyer_id", "cust_id", "user_id", "shopper_id"),
        "order_status": ("order_status", "status", "fulfillment_status", "order_state", "shipment_status"),
        "order_purchase_timestamp": ("order_purchase_timestamp", "order_date", "purchase_date", "created_at", "created_on", "order_datetime", "sale_datetime", "sale_date", "invoice_date", "ordered_on", "sales_datetime", "fechapedido", "fecha", "date", "timestamp"),
    },
    "items": {
        "order_id": ("order_id", "id", "txn_id", "transaction_id", "sale_id", "purchase_id", "invoice_id"),
        "order_item_id": ("order_item_id", "line_number", "line_no", "line", "item_number", "item_no", "lineno"),
        "product_id": ("product_id", "product_ref", "product_sku", "sku", "item_id", "upc", "product_code", "part_number"),
        "seller_id": ("seller_id", "store_id", "outlet_id", "vendor_id", "supplier_id", "shop_id", "warehouse_id"),
        "price": ("price", "unit_price", "amount", "total", "line_total", "item_total", "revenue", "sales_amount", "value"),
        "freight_value": ("freight_value", "shipping", "shipping_cost", "freight", "delivery_fee", "shipping_fee", "postage"),
    },
    "customers": {
        "customer_id": ("customer_id", "account_id", "client_id", "buyer_id", "cust_id", "user_id"),
        "customer_state": ("customer_state", "state", "region", "province", "state_code", "geo_region"),
        "customer_city": ("customer_city", "city", "town", "municipality"),
    },
    "products": {
        "product_id": ("product_id", "product_ref", "product_sku", "sku", "item_id", "upc", "product_code"),
        "product_category_name": ("product_category_name", "category", "product_category", "category_name", "product_type", "department", "product_group", "type"),
    },
    "translations": {
        "product_category_name": ("product_category_name", "category", "native_category", "native_label", "category_name", "department"),
        "product_category_name_english": ("product_category_name_english", "category_en", "category_english", "english_category", "product_category_english", "en_label"),
    },
    "sellers": {
        "seller_id": ("seller_id", "store_id", "outlet_id", "vendor_id", "supplier_id", "shop_id"),
        "seller_state": ("seller_state", "state", "region", "province", "state_code"),
    },
    "payments": {
        "order_id": ("order_id", "id", "txn_id", "transaction_id"),
        "payment_type": ("payment_type", "type", "payment_method", "method"),
        "payment_value": ("payment_value", "value", "amount", "total"),
    },
    "reviews": {
        "order_id": ("order_id", "id", "txn_id"),
        "review_score": ("review_score", "score", "rating", "stars", "review_rating"),
        "review_creation_date": ("review_creation_date", "created_at", "review_date", "date"),
    },
}

# Columns read as timestamps wherever they occur.
TIME_COLUMNS = (
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date",
    "order_estimated_delivery_date", "shipping_limit_date", "review_creation_date", "review_answer_timestamp",
)

# Texts that a delimited file may hold for "no value".
NO_VALUE = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class FactSchema:
    """The columns of the fact table that the operators work on."""

    time_col: str = "order_purchase_timestamp"
    revenue_col: str = "revenue"
    order_col: str = "order_id"
    status_col: str = "order_status"
    dimensions: tuple[str, ...] = ("customer_state", "customer_city", "product_category_name_english", "seller_state")
    numeric_cols: tuple[str, ...] = ("price", "freight_value", "revenue")
    state_col: str = "customer_state"
    category_col: str = "product_category_name_english"
    cancelled: tuple[str, ...] = ("canceled",)


@dataclass(frozen=True)
class Settings:
    """Every threshold of a run in one place."""

    row_limit: int = 0
    seed: int = 42
    alpha: float = 0.05
    top_findings: int = 10
    min_change: float = 0.15
    min_rows: int = 150
    min_quarters: int = 3
    skipped_quarters: int = 2
    min_days: int = 55
    drill_depth: int = 3
    caveat_share: float = 0.15
    window: int = 6
    min_periods: int = 3
    z: float = 2.0
    month_orders: int = 200
    segment_orders: int = 30
    segment_top: int = 8
    segment_change: float = 0.25
    test_rows: int = 8
    test_days: int = 10
    draws: int = 500
    regression_draws: int = 200
    min_r: float = 0.4
    correlation_rows: int = 100
    geo_orders: int = 30
    geo_top: int = 6
    geo_lift: float = 1.4
    pair_support: float = 0.001
    pair_count: int = 10
    pair_top: int = 5
    pair_lift: float = 3.0
    tolerance: float = 0.02
    correlation_tolerance: float = 0.15
    panel_rows: int = 50
    regression_rows: int = 30
    weak_p: float = 0.20
    join_overlap: float = 0.05
