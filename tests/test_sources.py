import pytest
from pyspark.sql import functions as F

from tidemark.schema import CANONICAL, FactSchema
from tidemark.operators import fact
from tidemark.sources import synthetic, tables


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_norm_and_roles():
    assert tables.norm("Order_Items-2!") == "orderitems2"
    assert [tables.role_of(s) for s in ("Line_Items", "lineitem", "clientes", "olist_orders_dataset", "x")] == ["items", None, "customers", None, None]


def test_renames_prefer_the_first_name_and_use_no_column_twice():
    assert tables.renames(["status", "id", "account_id", "fecha"], "orders") == {"id": "order_id", "account_id": "customer_id", "status": "order_status", "fecha": "order_purchase_timestamp"}
    assert tables.renames(["order_id", "id", "category"], "translations") == {"category": "product_category_name"}


def test_read_csv_types_markers_and_quotes(spark, tmp_path):
    write(tmp_path, "t.csv", 'a,b,c,d,order_approved_at\n1,1.5,"x, ""y""\nz",TRUE,2022-01-02 03:04:05\nNA,nan,,false,never\n')
    df = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "order_approved_at": "timestamp_ntz"}
    first, second = df.collect()
    assert first.c == 'x, "y"\nz' and str(first.order_approved_at) == "2022-01-02 03:04:05"
    assert second == (None, None, None, False, None)


def test_load_raw_errors_and_order(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_raw(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        tables.load_raw(spark, str(tmp_path))
    write(tmp_path, "b.csv", "x\n1\n")
    write(tmp_path, "a.csv", "x\n2\n")
    spark.range(3).write.parquet(str(tmp_path / "c.parquet"))
    assert list(tables.load_raw(spark, str(tmp_path))) == ["a", "b", "c"]


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(500).repartition(7)
    first = sorted(r.id for r in tables.sample_rows(df, 50, 42).collect())
    assert len(first) == 50 and first == sorted(r.id for r in tables.sample_rows(df.repartition(3), 50, 42).collect())
    assert tables.sample_rows(df, 0, 1).count() == 500 and tables.sample_rows(df, 900, 1).count() == 500


def test_sampled_orders_keep_their_references(spark):
    made = tables.sample_orders(synthetic.sales(spark, synthetic.Shape(orders_per_quarter=20, customers=50)), 30, 1)
    orders, items = made[CANONICAL["orders"]], made[CANONICAL["items"]]
    assert orders.count() == 30 and items.join(orders, "order_id", "left_anti").count() == 0 and items.count() >= 30


def test_date_fallback(spark):
    df = spark.createDataFrame([("a", "x", "2022-01-01"), ("b", "y", "2022-02-01")], "id string, note string, happened string")
    assert tables.canonical({"pedidos": df})[CANONICAL["orders"]].columns == ["order_id", "note", "order_purchase_timestamp"]


def test_register_makes_up_for_what_is_missing(spark):
    items = spark.createDataFrame([("o", 1.0)], "order_id string, price double")
    products = spark.createDataFrame([("p", "c"), ("q", None)], "product_id string, product_category_name string")
    assert set(tables.register({CANONICAL["items"]: items, CANONICAL["products"]: products}, "t_")) == {"t_order_items", "t_products", "t_categories"}
    assert spark.sql("SELECT freight_value FROM t_order_items").first()[0] == 0.0
    assert spark.sql("SELECT * FROM t_categories").collect() == [("c", "c")]


@pytest.fixture
def small(spark):
    orders = spark.createDataFrame([("a", "c1", "delivered", "2024-01-05 10:00:00"), ("b", "c2", "canceled", "2024-02-05 10:00:00"), ("c", "c3", None, "2024-05-05 10:00:00")], "order_id string, customer_id string, order_status string, order_purchase_timestamp string")
    items = spark.createDataFrame([("a", 1, "p1", "s1", 10.0, 2.0), ("a", 2, "p2", "s1", 5.0, None), ("b", 1, "p1", "s1", 9.0, 1.0), ("c", 1, "p9", None, float("nan"), 1.0), (None, 1, "p1", "s1", 1.0, 1.0)], "order_id string, order_item_id int, product_id string, seller_id string, price double, freight_value double")
    customers = spark.createDataFrame([("c1", "SP", "x"), ("c2", "RJ", "y"), ("c3", "RJ", "z")], "customer_id string, customer_state string, customer_city string")
    products = spark.createDataFrame([("p1", "livros"), ("p2", "jogos"), (None, "nada")], "product_id string, product_category_name string")
    return {CANONICAL["orders"]: tables.as_time(orders), CANONICAL["items"]: items, CANONICAL["customers"]: customers, CANONICAL["products"]: products}


def test_fact_rules(spark, small):
    rows = {(r.order_id, r.order_item_id): r for r in fact.build_fact(small).collect()}
    assert set(rows) == {("a", 1), ("a", 2), ("c", 1), (None, 1)}  # the cancelled order is out, the one without status and the item without order stay
    assert rows["a", 1].revenue == 12.0 and rows["a", 2].revenue == 5.0 and rows["c", 1].revenue is None
    assert rows["a", 1].product_category_name_english == "livros" and rows["c", 1].product_category_name_english is None
    assert rows["a", 1].quarter == "2024Q1" and rows["c", 1].month == "2024-05" and rows[None, 1].quarter is None
    assert rows["a", 1].seller_state is None and rows["a", 1].review_score is None


def test_fact_other_tables_and_words(spark, small):
    small[CANONICAL["reviews"]] = spark.createDataFrame([("a", None, "2024-01-01"), ("a", 2, "2024-01-03"), ("a", 5, "2024-01-02")], "order_id string, review_score int, review_creation_date string")
    small[CANONICAL["translations"]] = spark.createDataFrame([("livros", "books")], "product_category_name string, product_category_name_english string")
    small[CANONICAL["sellers"]] = spark.createDataFrame([("s1", "MG")], "seller_id string, seller_state string")
    small[CANONICAL["items"]] = small[CANONICAL["items"]].drop("freight_value")
    rows = {(r.order_id, r.order_item_id): r for r in fact.build_fact(small, FactSchema(cancelled=("delivered",))).collect()}
    assert set(rows) == {("b", 1), ("c", 1), (None, 1)} and rows["b", 1].revenue == 9.0 and rows["b", 1].seller_state == "MG"
    rows = {(r.order_id, r.order_item_id): r for r in fact.build_fact(small).collect()}
    assert rows["a", 1].review_score == 5 and rows["a", 2].product_category_name_english is None


def test_repeated_dimension_rows(spark, small):
    small[CANONICAL["customers"]] = small[CANONICAL["customers"]].unionByName(spark.createDataFrame([("c1", "SP", "zz")], "customer_id string, customer_state string, customer_city string"))
    assert fact.build_fact(small).where("order_id = 'a'").count() == 4
    once = fact.build_fact(small, unique=True).where("order_id = 'a'")
    assert once.count() == 2 and {r.customer_city for r in once.collect()} == {"zz"}


def test_missing_table_is_an_error(spark, small):
    del small[CANONICAL["products"]]
    with pytest.raises(KeyError):
        fact.build_fact(small)


def test_empty_fact(spark, small):
    empty = {k: v.limit(0) for k, v in small.items()}
    assert fact.build_fact(empty).count() == 0


def test_other_names_reach_the_same_fact(spark):
    shape = synthetic.Shape(orders_per_quarter=10, customers=20)
    made = synthetic.sales(spark, shape)
    a = fact.build_fact(made)
    b = fact.build_fact(tables.canonical(synthetic.renamed(made)), FactSchema(cancelled=("cancelado",)))
    figures = lambda f: f.agg(F.count("*"), F.round(F.sum("revenue"), 2), F.count_distinct("order_id"), F.count("seller_state"), F.count("product_category_name_english")).first()
    assert tuple(figures(a)) == tuple(figures(b))


def test_spanish_shop_has_anomalies_of_its_own(spark):
    shape = synthetic.Shape(orders_per_quarter=90, customers=200)
    clean, odd = (synthetic.spanish_sales(spark, shape, anomalies) for anomalies in (False, True))
    assert set(odd) == {"transacciones", "lineas_pedido", "clientes", "catalogo", "categorias", "tiendas"}
    both = clean["lineas_pedido"].join(odd["lineas_pedido"].withColumnRenamed("amount", "other").drop("outlet_id", "product_sku", "shipping"), ["txn_id", "line_number"]).join(odd["transacciones"], "txn_id")
    month = F.date_format("sales_datetime", "yyyy-MM")
    factor = both.select(month.alias("m"), F.round(F.col("other") / F.col("amount"), 1).alias("x")).distinct().collect()
    assert {r.x for r in factor if r.m in ("2020-07", "2020-08", "2020-09")} == {0.5} and {r.x for r in factor if r.m == "2020-06"} == {4.0} and {r.x for r in factor if r.m < "2020-06"} == {1.0}
