"""Queries over the sales tables for the data-processing problems 1 to 5, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cooccurrence, parsing, profile, references, skew
from ..session import cut, hinted

ITEMS, ORDERS, CUSTOMERS = "olist_order_items_dataset", "olist_orders_dataset", "olist_customers_dataset"
PRODUCTS, CATEGORIES, REVIEWS = "olist_products_dataset", "product_category_name_translation", "olist_order_reviews_dataset"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def product_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, category): the distinct English names each product reaches; both tables stay as they were loaded."""
    products = table(spark, sf_dir, PRODUCTS).select("product_id", "product_category_name").distinct()
    names = table(spark, sf_dir, CATEGORIES).select("product_category_name", F.col("product_category_name_english").alias("category")).where("category IS NOT NULL").distinct()
    return products.join(hinted(names), "product_category_name").select("product_id", "category").distinct()


# 1. items that appear together


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, ITEMS).select("order_id", "product_id")
    named = skew.lookup(items, product_categories(spark, sf_dir), "product_id", ["order_id"], "inner")
    return cooccurrence.co_occurrence(named, "order_id", "category")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cooccurrence.clearly_together(_pairs(spark, sf_dir))
    return found.select(F.col("item_a").alias("category_a"), F.col("item_b").alias("category_b"))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumnsRenamed({"item_a": "category_a", "item_b": "category_b"})
    return rows.withColumn("lift", F.round("lift", 6))


_P1 = """
WITH named AS (SELECT DISTINCT i.order_id, c.product_category_name_english AS category FROM olist_order_items_dataset i
  JOIN olist_products_dataset p ON i.product_id = p.product_id JOIN product_category_name_translation c ON p.product_category_name = c.product_category_name
  WHERE c.product_category_name_english IS NOT NULL AND i.order_id IS NOT NULL),
single AS (SELECT category, count(*) AS n_one FROM named GROUP BY category),
whole AS (SELECT count(DISTINCT order_id) AS n FROM named),
pairs AS (SELECT a.category AS category_a, b.category AS category_b, count(*) AS n_ab FROM named a JOIN named b ON a.order_id = b.order_id AND a.category < b.category GROUP BY ALL),
figures AS (SELECT category_a, category_b, n_ab, x.n_one AS n_a, y.n_one AS n_b, n FROM pairs JOIN single x ON x.category = category_a JOIN single y ON y.category = category_b CROSS JOIN whole)
"""

# 2. references to records that do not exist

PRODUCT_REF = references.Reference("order_items.product_id", "ingest_id", "product_id")
CUSTOMER_REF = references.Reference("orders.customer_id", "ingest_id", "customer_id")
CATEGORY_REF = references.Reference("products.product_category_name", "ingest_id", "product_category_name")
REFERENCES = ((PRODUCT_REF, ITEMS, PRODUCTS), (CUSTOMER_REF, ORDERS, CUSTOMERS), (CATEGORY_REF, PRODUCTS, CATEGORIES))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [references.orphans(ref, table(spark, sf_dir, child), table(spark, sf_dir, parent)) for ref, child, parent in REFERENCES]
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_field", F.col("ref_id").alias("ingest_id"), "kind").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.per_period(_orphans(spark, sf_dir))


def p2_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [references.snapshots(ref, table(spark, sf_dir, child), table(spark, sf_dir, parent)) for ref, child, parent in REFERENCES]
    return reduce(DataFrame.unionByName, parts)


def _p2_part(field: str, child: str, key: str, parent: str) -> str:
    return f"""
SELECT '{field}' AS ref_field, r.ingest_id, r.loaded_at,
  CASE WHEN count(t.ingest) = 0 THEN 'missing' WHEN min(t.loaded_at) > r.loaded_at THEN 'late' ELSE 'deleted' END AS kind
FROM {child} r LEFT JOIN (SELECT {key}, loaded_at, deleted_at, 1 AS ingest FROM {parent}) t ON r.{key} = t.{key}
WHERE r.{key} IS NOT NULL AND trim(r.{key}, ' \t\n\r') <> ''
GROUP BY r.ingest_id, r.loaded_at
HAVING NOT coalesce(bool_or(t.loaded_at <= r.loaded_at AND (t.deleted_at IS NULL OR t.deleted_at > r.loaded_at)), false)"""


_P2 = "WITH orphans AS (" + "\nUNION ALL".join(_p2_part(ref.field, child, ref.key, parent) for ref, child, parent in REFERENCES) + ")\n"


def _p2_open(field: str, child: str, key: str, parent: str) -> str:
    return f"""
SELECT '{field}' AS ref_field, strftime(m.month, '%Y-%m') AS period, count(*) AS n_open
FROM (SELECT unnest(generate_series(date_trunc('month', min(loaded_at)), date_trunc('month', max(loaded_at)), INTERVAL 1 MONTH)) AS month
      FROM {child} WHERE {key} IS NOT NULL AND trim({key}, ' \t\n\r') <> '') m
JOIN {child} r ON r.loaded_at < m.month + INTERVAL 1 MONTH
WHERE r.{key} IS NOT NULL AND trim(r.{key}, ' \t\n\r') <> ''
  AND r.{key} NOT IN (SELECT {key} FROM {parent} t WHERE {key} IS NOT NULL AND t.loaded_at < m.month + INTERVAL 1 MONTH AND (t.deleted_at IS NULL OR t.deleted_at >= m.month + INTERVAL 1 MONTH))
GROUP BY ALL"""


# 3. column-level data quality profile

PROFILED = (ORDERS, ITEMS, CUSTOMERS, REVIEWS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = profile.agreed(table(spark, sf_dir, "table_profiles"))
    parts = [profile.departures(table(spark, sf_dir, name), name, expected, "load_id") for name in PROFILED]
    return reduce(DataFrame.unionByName, parts)


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the four tables but the load itself, load by load, with the violations of the agreed patterns."""
    parts, expected = [], profile.agreed(table(spark, sf_dir, "table_profiles"))
    for name in PROFILED:
        df = table(spark, sf_dir, name)
        columns = [c for c in df.columns if c != "load_id"]
        patterns = {e.column: e.pattern for e in expected if e.table == name and e.pattern is not None and not profile.is_number(df.schema[e.column].dataType)}
        parts.append(profile.profile_columns(df, columns, "load_id", patterns).withColumn("table_name", F.lit(name)))
    rows = reduce(DataFrame.unionByName, parts).withColumnRenamed("group", "load_id")
    return rows.select("table_name", "load_id", "column_name", "n_rows", "n_missing", F.round("missing", 9).alias("missing"), "cardinality", "num_min", "num_max", F.round("median", 6).alias("median"), "nan", "off_pattern")


def p3_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the four tables but the row's own number and its load. Dates are compared by their distance to loaded_at; loaded_at itself, and
    those of a table without it, by that to the first loaded_at among the orders of the same load."""
    started = hinted(cut(table(spark, sf_dir, ORDERS).groupBy("load_id").agg(F.min("loaded_at").alias("_started"))))  # one row per load
    parts = []
    for name in PROFILED:
        df = table(spark, sf_dir, name)
        columns = [c for c in df.columns if c not in ("ingest_id", "load_id")]
        dates = [c for c in columns if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
        since = {c: "loaded_at" if "loaded_at" in columns and c != "loaded_at" else "_started" for c in dates}
        parts.append(profile.drift(df.join(started, "load_id", "left"), columns, "load_id", since).withColumn("table_name", F.lit(name)))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("table_name", "column_name", F.col("load").alias("load_id"), F.col("previous").alias("previous_load"), F.round("psi", 6).alias("psi"), F.round("chi_square", 3).alias("chi_square"), "bins")


_WATCHED = (
    (ORDERS, "customer_id", ""), (ORDERS, "order_status", ""), (ORDERS, "order_delivered_customer_date", ""),
    (ITEMS, "product_id", ""), (ITEMS, "seller_id", ""), (ITEMS, "price", "n"), (ITEMS, "freight_value", "n"),
    (CUSTOMERS, "customer_state", ""), (CUSTOMERS, "customer_city", ""), (REVIEWS, "review_score", "n"),
)
_P3_CELLS = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, load_id, '{c}' AS column_name, {c}::VARCHAR AS v, {f'{c}::DOUBLE' if kind else 'NULL::DOUBLE'} AS x FROM {t}" for t, c, kind in _WATCHED
)
_P3 = f"""
WITH cells AS ({_P3_CELLS}),
figures AS (SELECT c.table_name, load_id, c.column_name, any_value(p.missing) AS a_missing, any_value(p.cardinality) AS a_cardinality, any_value(p.median) AS a_median,
  avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS missing, count(DISTINCT v) AS cardinality, median(x) FILTER (WHERE NOT isnan(x)) AS med,
  coalesce(bool_or(x < p.num_min OR x > p.num_max OR (isnan(x) AND (p.num_min IS NOT NULL OR p.num_max IS NOT NULL))), false) AS out_of_range,
  coalesce(bool_or(NOT regexp_full_match(v, p.pattern)), false) AS off_pattern
  FROM cells c JOIN table_profiles p ON p.table_name = c.table_name AND p.column_name = c.column_name GROUP BY c.table_name, load_id, c.column_name)
SELECT table_name, load_id, column_name, unnest(list_filter([CASE WHEN missing > a_missing + 0.05 THEN 'missing' END, CASE WHEN cardinality > a_cardinality THEN 'cardinality' END,
  CASE WHEN out_of_range THEN 'numeric_range' END, CASE WHEN med < 0.5 * a_median OR med > 2 * a_median THEN 'median' END, CASE WHEN off_pattern THEN 'pattern' END], lambda z: z IS NOT NULL)) AS check_name
FROM figures
"""
_NUMBERS = {"ingest_id", "order_item_id", "price", "freight_value", "review_score"}
_ALL_COLUMNS = {
    ORDERS: ["ingest_id", "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date", "loaded_at"],
    ITEMS: ["ingest_id", "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value", "loaded_at"],
    CUSTOMERS: ["ingest_id", "customer_id", "customer_state", "customer_city", "loaded_at", "deleted_at"],
    REVIEWS: ["ingest_id", "order_id", "review_score", "review_creation_date"],
}
_P3_ALL = "\nUNION ALL ".join(
    f"""SELECT '{t}' AS table_name, load_id, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*), 9) AS missing,
 count(DISTINCT {c}) AS cardinality, """
    + (f"min({c}::DOUBLE) FILTER (WHERE NOT isnan({c}::DOUBLE)) AS num_min, max({c}::DOUBLE) FILTER (WHERE NOT isnan({c}::DOUBLE)) AS num_max, round(median({c}::DOUBLE) FILTER (WHERE NOT isnan({c}::DOUBLE)), 6) AS median, count(*) FILTER (WHERE isnan({c}::DOUBLE)) AS nan" if c in _NUMBERS
       else "NULL::DOUBLE AS num_min, NULL::DOUBLE AS num_max, NULL::DOUBLE AS median, 0::BIGINT AS nan")
    + (", NULL::BIGINT AS off_pattern" if c in _NUMBERS else f", CASE WHEN (SELECT any_value(pattern) FROM table_profiles WHERE table_name = '{t}' AND column_name = '{c}') IS NOT NULL THEN count(*) FILTER (WHERE NOT regexp_full_match({c}::VARCHAR, (SELECT any_value(pattern) FROM table_profiles WHERE table_name = '{t}' AND column_name = '{c}'))) END AS off_pattern")
    + f" FROM {t} GROUP BY load_id"
    for t, columns in _ALL_COLUMNS.items() for c in columns
)


_DATES = {"order_purchase_timestamp", "order_delivered_customer_date", "shipping_limit_date", "review_creation_date", "loaded_at", "deleted_at"}
_SIZE = "floor(sign({0}) * floor(ln(1 + abs({0})) * 350) / 70)"


def _drift_cell(t: str, c: str) -> str:
    """A column's cell as text: amounts by size, dates by whole days since they could be known, all else as it stands."""
    if c in ("price", "freight_value"):
        x, guard = c, ""
    elif c in _DATES:
        since = "started" if t == REVIEWS or c == "loaded_at" else "loaded_at"
        x, guard = f"floor((epoch_us({c}) - epoch_us({since})) / 86400000000.0)", f"WHEN {c} IS NULL THEN NULL WHEN {since} IS NULL THEN 'undated' "
    else:
        return f"{c}::VARCHAR"
    return f"CASE {guard}WHEN isnan({x}) THEN 'nan' WHEN abs({x}) <= 1000 AND {x} = floor({x}) THEN '=' || ({x})::BIGINT ELSE 'n' || ({_SIZE.format(x)})::BIGINT END"


_P3_DRIFT = (
    f"WITH begun AS (SELECT load_id, min(loaded_at) AS started FROM {ORDERS} GROUP BY 1), cells AS ("
    + "\nUNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, load_id AS l, {_drift_cell(t, c)} AS v FROM {t} LEFT JOIN begun USING (load_id) WHERE load_id IS NOT NULL" for t, columns in _ALL_COLUMNS.items() for c in columns if c != "ingest_id")
    + """),
counts AS (SELECT t, c, l, v, count(*) AS n FROM cells GROUP BY ALL),
loads AS (SELECT t, l, lag(l) OVER (PARTITION BY t ORDER BY l) AS before FROM (SELECT DISTINCT t, l FROM cells)),
each AS (SELECT t, c, l, v, n AS a, 0 AS b FROM counts UNION ALL SELECT k.t, c, o.l, v, 0, n FROM counts k JOIN loads o ON o.t = k.t AND o.before = k.l),
pairs AS (SELECT t, c, l, sum(a) AS a, sum(b) AS b FROM each GROUP BY t, c, l, v),
whole AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb, count(*) OVER w AS k FROM pairs WINDOW w AS (PARTITION BY t, c, l)),
shares AS (SELECT *, (a + 0.5) / (na + 0.5 * k) AS p, (b + 0.5) / (nb + 0.5 * k) AS q FROM whole)
SELECT s.t AS table_name, c AS column_name, s.l AS load_id, before AS previous_load, round(sum((p - q) * ln(p / q)), 6) AS psi, round(sum(pow(sqrt(nb / na) * a - b / sqrt(nb / na), 2) / (a + b)), 3) AS chi_square, count(*) AS bins
FROM shares s JOIN loads o ON o.t = s.t AND o.l = s.l WHERE before IS NOT NULL GROUP BY ALL"""
)


# 4. rows that fail to parse


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_records(table(spark, sf_dir, "order_items_raw"), "raw_line")


_FIELD = '"(?:[^"]|"")*"|[^",]*'
_P4 = f"""
WITH a AS (SELECT *, coalesce(regexp_full_match(raw_line, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*'), true) AS whole FROM order_items_raw),
b AS (SELECT *, CASE WHEN whole THEN list_transform(regexp_extract_all(',' || raw_line, '(?s),({_FIELD})', 1), lambda z: CASE WHEN starts_with(z, '"') THEN replace(substr(z, 2, length(z) - 2), '""', '"') ELSE z END) END AS f FROM a),
c AS (SELECT *, list_transform(f, lambda z: trim(z, ' ')) AS t FROM b),
d AS (SELECT *, CASE WHEN NOT whole THEN 'quoting' WHEN coalesce(len(f), 0) <> 8 THEN 'column_count'
  WHEN NOT (regexp_full_match(t[1], '[0-9a-f]{{16}}') AND regexp_full_match(t[2], '[0-9]+') AND regexp_full_match(t[3], '[0-9a-f]{{16}}') AND regexp_full_match(t[4], '[0-9a-f]{{16}}')
    AND regexp_full_match(t[5], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AND try_cast(t[5] AS TIMESTAMP) IS NOT NULL AND NOT starts_with(t[5], '0000') AND t[5] NOT LIKE '% 24:%'
    AND regexp_full_match(t[6], '|[0-9]+(\\.[0-9]{{1,2}})?') AND regexp_full_match(t[7], '|[0-9]+(\\.[0-9]{{1,2}})?')) THEN 'invalid_value' END AS reason FROM c)
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.rejected(_parsed(spark, sf_dir), ["line_id"])


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.typed_rows(_parsed(spark, sf_dir), ["line_id", "batch_id"])


def p4_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that are set aside, with their text and the reason."""
    return parsing.rejected(_parsed(spark, sf_dir), ["line_id", "batch_id"], "raw_line")


# 5. a few keys holding most records


_MEASURES = {"n_items": ("count", "order_item_id"), "cents": ("sum", "cents")}


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key_field, key_value, n_items, revenue, n_field): items are distinct (order_id, order_item_id); n_field counts those with any key of the field.

    The revenue of an item is price plus freight of its first row (smallest ingest_id) that has a price, in cents; NaN and null amounts count as 0.
    The item rows move once, by order (large orders split by item): there they become distinct and meet the states of their order. Stage one counts per
    set of keys and salt, on the map side first, so few rows are left, whatever a key holds; stage two merges these by each key.
    """
    rows = table(spark, sf_dir, ITEMS).select("ingest_id", "order_id", "order_item_id", "product_id", "price", "freight_value")
    zero = F.lit(0.0)
    amount = F.when(F.col("price").isNotNull(), F.round((F.nanvl("price", zero) + F.coalesce(F.nanvl("freight_value", zero), zero)) * 100).cast("bigint"))
    first = F.min(F.when(F.col("cents").isNotNull(), F.struct("ingest_id", "cents")))["cents"].alias("cents")
    named = skew.lookup(rows.withColumn("cents", amount).drop("price", "freight_value"), product_categories(spark, sf_dir), "product_id", ["order_id", "order_item_id"]).drop("product_id")
    heavy, salts = skew.heavy_keys(rows, "order_id"), skew.salt_count(rows)
    placed = skew.salted_left(named, "order_id", ["order_item_id"], heavy, salts).repartition("order_id", "_salt")
    items = placed.groupBy("order_id", "_salt", "order_item_id").agg(first, F.sort_array(F.collect_set("category")).alias("categories"))

    orders = table(spark, sf_dir, ORDERS).where("customer_id IS NOT NULL").select("order_id", "customer_id")
    customers = table(spark, sf_dir, CUSTOMERS).where("customer_state IS NOT NULL").select("customer_id", "customer_state")
    states = customers.groupBy("customer_id").agg(F.collect_set("customer_state").alias("states"))
    reached = skew.salted_join(orders.distinct(), states, "customer_id", ["order_id"], "inner", skew.heavy_keys(orders, "customer_id"))
    order_states = reached.groupBy("order_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("states")))).alias("states"))
    whole = items.join(skew.salted_right(order_states, "order_id", heavy, salts), ["order_id", "_salt"], "left").drop("_salt")

    keys = F.struct(F.coalesce("states", F.array().cast("array<string>")).alias("states"), "categories").alias("_keys")
    parts = skew.partials(whole.select(keys, "order_id", "order_item_id", "cents"), "_keys", _MEASURES, ["order_id", "order_item_id"], heavy=skew.EVERY)

    def of(field: str, column: str):  # the first key of an item stands for the item in the count of its field
        return F.transform(F.col(column), lambda k, i: F.struct(F.lit(field).alias("key_field"), k.alias("key_value"), (i == 0).alias("first")))

    each = parts.withColumn("key", F.explode(F.concat(of("customer_state", "_keys.states"), of("product_category_name_english", "_keys.categories"))))
    each = each.select("key.*", "_p_n_items", "_p_cents", F.when(F.col("key.first"), F.col("_p_n_items")).otherwise(0).alias("_p_n_first"))
    totals = skew.merged(each, ["key_field", "key_value"], {**_MEASURES, "n_first": ("count", "")})
    totals = cut(totals.select("key_field", "key_value", "n_items", (F.col("cents") / 100).alias("revenue"), "n_first"))
    return totals.drop("n_first").join(F.broadcast(totals.groupBy("key_field").agg(F.sum("n_first").alias("n_field"))), "key_field")  # two rows


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).where(20 * F.col("n_items") >= F.col("n_field")).select("key_field", "key_value")


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("key_field", "key_value", "n_items", F.round("revenue", 2).alias("revenue"))


_P5 = """
WITH items AS (SELECT order_id, order_item_id, arg_min(CAST(round((CASE WHEN isnan(price) THEN 0 ELSE price END + CASE WHEN freight_value IS NULL OR isnan(freight_value) THEN 0 ELSE freight_value END) * 100) AS BIGINT), ingest_id)
    FILTER (WHERE price IS NOT NULL) AS cents FROM olist_order_items_dataset GROUP BY ALL),
reached AS (SELECT DISTINCT 'customer_state' AS key_field, c.customer_state AS key_value, i.order_id, i.order_item_id FROM olist_order_items_dataset i
  JOIN olist_orders_dataset o ON o.order_id = i.order_id JOIN olist_customers_dataset c ON c.customer_id = o.customer_id WHERE c.customer_state IS NOT NULL
  UNION ALL SELECT DISTINCT 'product_category_name_english', t.product_category_name_english, i.order_id, i.order_item_id FROM olist_order_items_dataset i
  JOIN olist_products_dataset p ON p.product_id = i.product_id JOIN product_category_name_translation t ON t.product_category_name = p.product_category_name WHERE t.product_category_name_english IS NOT NULL),
whole AS (SELECT key_field, count(DISTINCT (order_id, order_item_id)) AS n_field FROM reached GROUP BY key_field),
keys AS (SELECT key_field, key_value, count(*) AS n_items, round(sum(coalesce(cents, 0)) / 100.0, 2)::DOUBLE AS revenue FROM reached JOIN items USING (order_id, order_item_id) GROUP BY ALL)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_report, p2_snapshots, p3_found, p3_profile, p3_drift, p4_found, p4_rows, p4_rejected, p5_found, p5_totals)
}

SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT category_a, category_b FROM figures WHERE n_ab >= 3 AND 1000 * n_ab >= n AND n_ab * n >= 3 * n_a * n_b",
    "p1_pairs": _P1 + "SELECT category_a, category_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a::DOUBLE * n_b), 6) AS lift FROM figures",
    "p2_found": _P2 + "SELECT DISTINCT ref_field, ingest_id, kind FROM orphans",
    "p2_report": _P2 + "SELECT ref_field, strftime(loaded_at, '%Y-%m') AS period, kind, count(*) AS n_refs FROM orphans GROUP BY ALL",
    "p2_snapshots": "\nUNION ALL".join(_p2_open(ref.field, child, ref.key, parent) for ref, child, parent in REFERENCES),
    "p3_found": _P3,
    "p3_profile": _P3_ALL,
    "p3_drift": _P3_DRIFT,
    "p4_found": _P4 + "SELECT line_id, reason FROM d WHERE reason IS NOT NULL",
    "p4_rejected": _P4 + "SELECT line_id, batch_id, reason, raw_line FROM d WHERE reason IS NOT NULL",
    "p4_rows": _P4 + "SELECT line_id, batch_id, t[1] AS order_id, try_cast(t[2] AS BIGINT) AS order_item_id, t[3] AS product_id, t[4] AS seller_id, try_cast(t[5] AS TIMESTAMP) AS shipping_limit_date, "
    "try_cast(t[6] AS DOUBLE) AS price, try_cast(t[7] AS DOUBLE) AS freight_value, f[8] AS item_note FROM d WHERE reason IS NULL",
    "p5_found": _P5 + "SELECT key_field, key_value FROM keys JOIN whole USING (key_field) WHERE 20 * n_items >= n_field",
    "p5_totals": _P5 + "SELECT key_field, key_value, n_items, revenue FROM keys",
}
