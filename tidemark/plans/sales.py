"""Queries over the fact table of order items, with their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import causal, discovery, fact, graph, periods, segments, significance
from ..schema import CANONICAL, NO_VALUE, FactSchema, Settings
from ..session import checkpoint_dir, cut, held
from ..sources import synthetic
from ..sources.star import star_tables
from ..sources.tables import as_time, canonical, load_raw, register, sample_orders, sample_rows, write_csv
from . import evidence, ranking, sqlmath
from .findings import Finder, read_columns, test_causes

SETTINGS = Settings()
STAR = FactSchema(cancelled=("P",))  # one status is taken for cancelled, so that the filter is at work


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = [n for role, n in CANONICAL.items() if role != "payments"]  # the test data has none
    return canonical({n: as_time(spark.read.parquet(f"{sf_dir}/{n}.parquet")) for n in names})


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact.build_fact(tables(spark, sf_dir))


def star_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact.build_fact(star_tables(spark, sf_dir), STAR)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"})


def two_quarters(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, str, str]:
    """The fact table with the columns asked for, and the two quarters that the two-period queries look at: the largest change of revenue.

    The columns are written out once: the quarters and the query itself are read from there.
    """
    f = cut(facts(spark, sf_dir).select(*dict.fromkeys(("quarter", "order_id", "revenue", *columns))))
    found = periods.changes(f, "quarter", 0.0, SETTINGS.min_rows).where("metric = 'revenue'")
    best = found.orderBy(F.abs("delta_pct").desc(), "period").first()
    if best is None:
        raise ValueError("no two quarters with enough rows follow each other")
    return f, best["period"], best["prev_period"]


_FACT = """
WITH review AS (SELECT order_id, review_score FROM olist_order_reviews_dataset WHERE review_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY review_creation_date, review_score) = 1),
item AS (SELECT order_id, order_item_id, product_id, seller_id, CASE WHEN NOT isnan(price) THEN price END AS price, CASE WHEN NOT isnan(freight_value) THEN freight_value END AS freight_value FROM olist_order_items_dataset),
fact AS (SELECT i.*, o.customer_id, o.order_status, o.order_purchase_timestamp, c.customer_state, c.customer_city, p.product_category_name, t.product_category_name_english, s.seller_state, r.review_score,
  price + coalesce(freight_value, 0.0) AS revenue, year(o.order_purchase_timestamp) || 'Q' || quarter(o.order_purchase_timestamp) AS quarter, strftime(o.order_purchase_timestamp, '%Y-%m') AS month, o.order_purchase_timestamp::DATE AS day
  FROM item i LEFT JOIN olist_orders_dataset o USING (order_id) LEFT JOIN olist_customers_dataset c ON c.customer_id = o.customer_id
  LEFT JOIN olist_products_dataset p ON p.product_id = i.product_id LEFT JOIN product_category_name_translation t ON t.product_category_name = p.product_category_name
  LEFT JOIN olist_sellers_dataset s ON s.seller_id = i.seller_id LEFT JOIN review r ON r.order_id = i.order_id
  WHERE o.order_status IS DISTINCT FROM 'canceled')"""
_STAR_FACT = """
WITH fact AS (SELECT l_orderkey AS order_id, l_extendedprice AS price, l_extendedprice * l_tax AS freight_value, l_extendedprice + l_extendedprice * l_tax AS revenue, n.n_name AS customer_state, c.c_mktsegment AS customer_city,
  p_type AS product_category_name_english, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, strftime(o_orderdate, '%Y-%m') AS month, o_orderdate::DATE AS day
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN part ON p_partkey = l_partkey
  WHERE o_orderstatus IS DISTINCT FROM 'P')"""
_MONEY = "coalesce(sum({0}::DECIMAL(20,4)), 0)::DOUBLE"
_SERIES = f", series AS (SELECT quarter AS period, {_MONEY.format('revenue')} AS revenue, count(DISTINCT order_id) AS orders, count(*) AS items FROM fact WHERE quarter IS NOT NULL GROUP BY 1)"
_CHANGES = f"""{_SERIES}, each AS (SELECT 'revenue' AS metric, period, revenue AS value, items FROM series UNION ALL SELECT 'orders', period, orders::DOUBLE, items FROM series),
changes AS (SELECT metric, period, prev_period, base_value, comp_value, (comp_value - base_value) / base_value AS delta_pct, n_base, n_comp FROM
  (SELECT metric, period, value AS comp_value, items AS n_comp, lag(period) OVER w AS prev_period, lag(value) OVER w AS base_value, lag(items) OVER w AS n_base FROM each WINDOW w AS (PARTITION BY metric ORDER BY period)) z
  WHERE prev_period IS NOT NULL AND base_value <> 0 AND n_base >= 150 AND n_comp >= 150),
pair AS (SELECT period, prev_period FROM changes WHERE metric = 'revenue' ORDER BY abs(delta_pct) DESC, period LIMIT 1)"""
_SIDES = _CHANGES + ", two AS (SELECT f.*, CASE WHEN quarter = pair.prev_period THEN 0 ELSE 1 END AS side FROM fact f, pair WHERE quarter IN (pair.period, pair.prev_period))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


@query(_FACT + """ SELECT order_id, order_item_id, product_id, seller_id, price, freight_value, customer_id, order_status, customer_state, customer_city, product_category_name, product_category_name_english, seller_state,
  review_score, round(revenue, 6) AS revenue, quarter, month, day::VARCHAR AS day FROM fact""")
def fact_table(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("day", F.col("day").cast("string")).drop("order_purchase_timestamp")
    return f.withColumn("revenue", F.round("revenue", 6))


_TEXT = ("order_id", "product_id", "seller_id", "customer_id", "order_status", "customer_state", "customer_city", "product_category_name", "product_category_name_english", "seller_state")
_BLANK = ", ".join("'" + x + "'" for x in NO_VALUE)


def _blanked(sql: str) -> str:
    """The fact table's SQL over tables whose texts for "no value" are null, as they come out of delimited files."""
    used = {"olist_order_items_dataset": _TEXT[:3], "olist_orders_dataset": (_TEXT[0], *_TEXT[3:5]), "olist_customers_dataset": (_TEXT[3], *_TEXT[5:7]), "olist_products_dataset": (_TEXT[1], _TEXT[7]), "product_category_name_translation": _TEXT[7:9],
            "olist_sellers_dataset": (_TEXT[2], _TEXT[9]), "olist_order_reviews_dataset": _TEXT[:1]}
    views = ", ".join(f"file_{t} AS (SELECT * REPLACE ({', '.join(f'CASE WHEN {c} NOT IN ({_BLANK}) THEN {c} END AS {c}' for c in cs)}) FROM {t})" for t, cs in used.items())
    for t in used:
        sql = sql.replace(t, f"file_{t}")
    return "WITH " + views + ", " + sql.strip().removeprefix("WITH ")


@query(_blanked(_FACT) + " SELECT order_id, order_item_id, product_id, seller_id, price, freight_value, customer_state, product_category_name_english, seller_state, review_score, round(revenue, 6) AS revenue, quarter, month, day::VARCHAR AS day FROM fact")
def fact_table_from_csv(spark, sf_dir):
    """The fact table from delimited files under another shop's table and column names, written to the shared folder first."""
    folder = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    names = {role: synthetic.SPANISH.get(role, (CANONICAL[role], {})) for role in CANONICAL if role != "payments"}
    own = tables(spark, sf_dir)
    write_csv({name: own[CANONICAL[role]].withColumnsRenamed(columns) for role, (name, columns) in names.items()}, folder)
    f = fact.build_fact(canonical(load_raw(spark, folder)))
    return f.select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value", "customer_state", "product_category_name_english", "seller_state", "review_score", F.round("revenue", 6).alias("revenue"), "quarter", "month", F.col("day").cast("string").alias("day"))


@query("SELECT order_id, review_score FROM olist_order_reviews_dataset WHERE review_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY review_creation_date, review_score) = 1")
def first_reviews(spark, sf_dir):
    return fact.first_review(spark.read.parquet(f"{sf_dir}/olist_order_reviews_dataset.parquet"))


_SHOW_SERIES = " SELECT period, revenue, orders, items, round(revenue / orders, 6) AS avg_order_value, round(items / orders, 6) AS items_per_order FROM series"


@query(_FACT + _SERIES + _SHOW_SERIES)
def quarterly_series(spark, sf_dir):
    return rounded(periods.series(facts(spark, sf_dir)))


@query(_STAR_FACT + _SERIES + _SHOW_SERIES.replace("SELECT period, revenue,", "SELECT period, round(revenue, 2) AS revenue,").replace("round(revenue / orders, 6)", "round(revenue / orders, 4)"))
def star_quarterly_series(spark, sf_dir):
    s = periods.series(star_facts(spark, sf_dir), "quarter", STAR)
    return s.select("period", F.round("revenue", 2).alias("revenue"), "orders", "items", F.round("avg_order_value", 4).alias("avg_order_value"), F.round("items_per_order", 6).alias("items_per_order"))


_MONTHS = f""", seen AS (SELECT date_trunc('month', day) AS m, {_MONEY.format('revenue')} AS revenue, count(DISTINCT order_id) AS orders FROM fact WHERE day IS NOT NULL GROUP BY 1),
months AS (SELECT strftime(c.m, '%Y-%m') AS period, coalesce(revenue, 0) AS revenue, coalesce(orders, 0) AS orders FROM (SELECT unnest(generate_series((SELECT min(m) FROM seen), (SELECT max(m) FROM seen), INTERVAL 1 MONTH)) AS m) c LEFT JOIN seen ON seen.m = c.m)"""
_ROLLING = (
    _MONTHS
    + """, med AS (SELECT *, CASE WHEN count(revenue) OVER f >= 3 THEN quantile_cont(revenue, 0.5) OVER f END AS median FROM months WINDOW f AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)),
off AS (SELECT *, abs(revenue - median) AS d FROM med), mad AS (SELECT *, CASE WHEN count(d) OVER f >= 3 THEN quantile_cont(d, 0.5) OVER f END AS mad FROM off WINDOW f AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)),
rolling AS (SELECT period, revenue, orders, median, mad, CASE WHEN mad <> 0 THEN (revenue - median) / mad END AS z_score FROM mad)"""
)


@query(_FACT + _MONTHS + " SELECT * FROM months")
def monthly_series_filled(spark, sf_dir):
    return periods.monthly_filled(facts(spark, sf_dir))


@query(_FACT + _ROLLING + " SELECT period, revenue, orders, round(median, 6) AS median, round(mad, 6) AS mad, round(z_score, 6) AS z_score FROM rolling")
def monthly_rolling_z(spark, sf_dir):
    return rounded(periods.rolling_z(periods.monthly_filled(facts(spark, sf_dir))))


@query(_FACT + _ROLLING + """ SELECT period, revenue, orders, round(median, 6) AS median, round(z_score, 6) AS z_score, round(revenue / median - 1, 6) AS excess FROM rolling
  WHERE abs(z_score) >= 2 AND period <> (SELECT max(period) FROM rolling) AND orders >= 200 AND median <> 0""")
def monthly_outliers(spark, sf_dir):
    return rounded(periods.outlying_months(facts(spark, sf_dir), SETTINGS.z, SETTINGS.month_orders))


_DAILY = f"SELECT quarter, day::VARCHAR AS day, count(DISTINCT order_id) AS orders, {_MONEY.format('revenue')} AS revenue FROM fact WHERE day IS NOT NULL GROUP BY quarter, day"


@query(f"{_FACT} {_DAILY}")
def daily_series(spark, sf_dir):
    return periods.daily(facts(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(_FACT + " SELECT quarter AS period, count(DISTINCT day) AS days FROM fact WHERE quarter IS NOT NULL GROUP BY 1")
def period_distinct_days(spark, sf_dir):
    return periods.period_days(facts(spark, sf_dir))


_SHOW_CHANGES = " SELECT metric, period, prev_period, base_value, comp_value, round(delta_pct, 9) AS delta_pct, n_base, n_comp FROM changes WHERE abs(delta_pct) >= 0.15"


@query(_FACT + _CHANGES + _SHOW_CHANGES)
def period_changes(spark, sf_dir):
    return rounded(periods.changes(facts(spark, sf_dir), "quarter", SETTINGS.min_change, SETTINGS.min_rows), 9)


@query(_STAR_FACT + _CHANGES + _SHOW_CHANGES.replace("base_value, comp_value,", "round(base_value, 2) AS base_value, round(comp_value, 2) AS comp_value,").replace("0.15", "0.02"))
def star_period_changes(spark, sf_dir):
    c = periods.changes(star_facts(spark, sf_dir), "quarter", 0.02, SETTINGS.min_rows, STAR)
    return c.withColumns({"base_value": F.round("base_value", 2), "comp_value": F.round("comp_value", 2), "delta_pct": F.round("delta_pct", 9)})


def _drill_sql(metric: str) -> str:
    value = {"revenue": f"{_MONEY.format('CASE WHEN side = {0} THEN revenue END')}", "orders": "count(DISTINCT CASE WHEN side = {0} THEN order_id END)::DOUBLE"}[metric]
    base, comp, sql, kept = value.format(0), value.format(1), _FACT + _SIDES, "true"
    sql += f", whole AS (SELECT {comp} - {base} AS change FROM two)"
    for k, dim in enumerate(FactSchema().dimensions[:3], start=1):
        sql += f""", g{k} AS (SELECT {dim} AS entity, {base} AS base_value, {comp} AS comp_value, count(DISTINCT CASE WHEN side = 1 THEN order_id END) AS n FROM two WHERE {dim} IS NOT NULL AND {kept} GROUP BY 1),
s{k} AS (SELECT {k} AS depth, '{dim}' AS dimension, * FROM g{k} ORDER BY abs(comp_value - base_value) DESC, entity LIMIT 1)"""
        kept += f" AND {dim} = (SELECT entity FROM s{k})"
    each = " UNION ALL ".join(f"SELECT * FROM s{k} WHERE (SELECT sum(base_value) FROM g{k}) <> 0" for k in (1, 2, 3))
    return sql + f""" SELECT depth, dimension, entity, base_value, comp_value, CASE WHEN base_value <> 0 THEN round((comp_value - base_value) / base_value, 9) ELSE 0 END AS delta_pct,
  round((comp_value - base_value) / (SELECT change FROM whole), 9) AS contribution_pct, n FROM ({each}) x"""


def _drill(spark, sf_dir, metric):
    f, *pair = two_quarters(spark, sf_dir, *FactSchema().dimensions[:3])
    return rounded(segments.drill_down(f, *pair, metric), 9)


@query(_drill_sql("revenue"))
def drill_down_revenue(spark, sf_dir):
    return _drill(spark, sf_dir, "revenue")


@query(_drill_sql("orders"))
def drill_down_orders(spark, sf_dir):
    return _drill(spark, sf_dir, "orders")


def _movers_sql(dim: str) -> str:
    return _FACT + _SIDES + f""" SELECT {dim} AS entity, {_MONEY.format('CASE WHEN side = 0 THEN revenue END')} AS base_revenue, {_MONEY.format('CASE WHEN side = 1 THEN revenue END')} AS comp_revenue,
  CASE WHEN base_revenue <> 0 THEN round((comp_revenue - base_revenue) / base_revenue, 9) END AS delta_pct, count(DISTINCT CASE WHEN side = 0 THEN order_id END) AS base_orders, count(DISTINCT CASE WHEN side = 1 THEN order_id END) AS comp_orders
  FROM two WHERE {dim} IS NOT NULL GROUP BY 1 HAVING base_orders >= 30 AND comp_orders >= 30"""


def _movers(spark, sf_dir, dim):
    f, period, prev = two_quarters(spark, sf_dir, dim)
    return segments.movers(f, dim, prev, period)


@query(_movers_sql("customer_state"))
def segment_movers_state(spark, sf_dir):
    return rounded(_movers(spark, sf_dir, "customer_state").drop("min_p", "significant"), 9)


@query(_movers_sql("product_category_name_english"))
def segment_movers_category(spark, sf_dir):
    return rounded(_movers(spark, sf_dir, "product_category_name_english").drop("min_p", "significant"), 9)


@query(_movers_sql("product_category_name_english") + " ORDER BY delta_pct DESC NULLS LAST, entity LIMIT 8")
def segment_movers_top(spark, sf_dir):
    return rounded(segments.top_movers(_movers(spark, sf_dir, "product_category_name_english").drop("min_p", "significant")), 9)


@query(None)
def segment_significance(spark, sf_dir):
    """min_p and significance of every state's move."""
    return rounded(_movers(spark, sf_dir, "customer_state").select("entity", "min_p", "significant"), 9)


def _samples_sql(source: str, keys: str, value: str) -> str:
    return f""", v AS (SELECT {keys}, side, {value}::DOUBLE AS x FROM {source} WHERE {value} IS NOT NULL AND {keys} IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {keys}, x) AS same FROM v),
sums AS (SELECT {keys}, count(*) FILTER (WHERE side = 0) AS n_a, count(*) FILTER (WHERE side = 1) AS n_b, avg(x) FILTER (WHERE side = 0) AS mean_a, avg(x) FILTER (WHERE side = 1) AS mean_b,
  var_samp(x) FILTER (WHERE side = 0) AS va, var_samp(x) FILTER (WHERE side = 1) AS vb, sum(rk) FILTER (WHERE side = 0) AS ra, sum(same * same - 1)::DOUBLE AS ties FROM ranked GROUP BY 1),
tests AS (SELECT {keys}, n_a, n_b, mean_a, mean_b, (mean_a - mean_b) / sqrt(va / n_a + vb / n_b) AS t, pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)) AS df,
  (mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS d, ra - n_a * (n_a + 1) / 2 AS u, 1 - 2 * (ra - n_a * (n_a + 1) / 2) / (n_a * n_b) AS r,
  (greatest(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5) / sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1) - ties / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1)))) AS z FROM sums WHERE n_a >= 8 AND n_b >= 8),
proofs AS (SELECT *, {sqlmath.t_two_sided('t', 'df')} AS p_t, {sqlmath.normal_two_sided('z')} AS p_u FROM tests)"""


@query(_FACT + _SIDES + _samples_sql("two", "customer_state", "revenue") + """ SELECT customer_state, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(t, 6) AS t, round(df, 2) AS df, round(d, 6) AS d, u::DOUBLE AS u, round(r, 6) AS r FROM tests""")
def two_sample_tests_by_state(spark, sf_dir):
    f, *pair = two_quarters(spark, sf_dir, "customer_state")
    t = significance.two_samples(f.where("customer_state IS NOT NULL"), ["customer_state"], segments.side(*pair), "revenue").drop("p_t", "p_u")
    return rounded(t).withColumn("df", F.round("df", 2))


_enough = "SELECT customer_state FROM two WHERE customer_state IS NOT NULL GROUP BY 1 HAVING count(DISTINCT CASE WHEN side = 0 THEN order_id END) >= 30 AND count(DISTINCT CASE WHEN side = 1 THEN order_id END) >= 30"
SQL["segment_significance"] = _FACT + _SIDES + _samples_sql("two", "customer_state", "revenue") + f""" SELECT e.customer_state AS entity, round(coalesce(least(p_t, p_u), 1.0), 9) AS min_p, coalesce(least(p_t, p_u), 1.0) < 0.05 AS significant
  FROM ({_enough}) e LEFT JOIN proofs p ON p.customer_state = e.customer_state"""
_DAYS = _FACT + _SIDES + f""", days AS (SELECT side, day, count(DISTINCT order_id) AS orders, {_MONEY.format('revenue')} AS revenue FROM two GROUP BY side, day),
long AS (SELECT side, 'orders' AS m, orders::DOUBLE AS x FROM days UNION ALL SELECT side, 'revenue', revenue FROM days)""" + _samples_sql("long", "m", "x")


@query(_DAYS + """ SELECT m || ' | Welch t-test' AS name, round(t, 6) AS statistic, round(d, 6) AS effect_size FROM tests UNION ALL SELECT m || ' | Mann-Whitney U', u::DOUBLE, round(r, 6) FROM tests
UNION ALL SELECT 'volume share test (binomial)', round(c / (b + c), 6), round((c - b) / b, 6) FROM (SELECT sum(orders) FILTER (WHERE side = 0)::DOUBLE AS b, sum(orders) FILTER (WHERE side = 1)::DOUBLE AS c FROM days) z""")
def daily_period_statistics(spark, sf_dir):
    f, *pair = two_quarters(spark, sf_dir, "day")
    return rounded(segments.daily_tests(f, *pair).select("name", "statistic", "effect_size"))


@query(_DAYS + f""" SELECT m || ' | Welch t-test' AS name, round(t, 9) AS statistic, round(p_t, 9) AS p_value, round(d, 9) AS effect_size, 'Cohen''s d' AS effect_name FROM proofs
UNION ALL SELECT m || ' | Mann-Whitney U', u::DOUBLE, round(p_u, 9), round(r, 9), 'rank-biserial r' FROM proofs
UNION ALL SELECT 'volume share test (binomial)', round(c / (b + c), 9), round({sqlmath.binomial_half('c', '(b + c)')}, 9), round((c - b) / b, 9), 'relative volume change'
FROM (SELECT sum(orders) FILTER (WHERE side = 0)::DOUBLE AS b, sum(orders) FILTER (WHERE side = 1)::DOUBLE AS c FROM days) z""")
def daily_period_tests(spark, sf_dir):
    """The same with p-values."""
    f, *pair = two_quarters(spark, sf_dir, "day")
    return rounded(segments.daily_tests(f, *pair), 9)


_PAIRS = (("price", "freight_value"), ("price", "revenue"), ("freight_value", "revenue"))
_CORRELATION = "\nUNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM
 (SELECT {a}, {b}, rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM fact WHERE {a} IS NOT NULL AND {b} IS NOT NULL) x HAVING count(*) >= 100""" for a, b in _PAIRS)  # fmt: skip


@query(f"{_FACT} {_CORRELATION}")
def correlation_pairs(spark, sf_dir):
    return rounded(significance.correlations(facts(spark, sf_dir), ["price", "freight_value", "revenue"]).drop("r", "p"))


@query(f"{_STAR_FACT} {_CORRELATION}")
def star_correlation_pairs(spark, sf_dir):
    return rounded(significance.correlations(star_facts(spark, sf_dir), ["price", "freight_value", "revenue"]).drop("r", "p"))


_STRONGER = "CASE WHEN abs(spearman) > abs(pearson) THEN spearman ELSE pearson END"


@query(f"SELECT a, b, r, round(CASE WHEN abs(r) >= 1 THEN 0 ELSE {sqlmath.t_two_sided('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)::DOUBLE')} END, 9) AS p FROM (SELECT a, b, n, {_STRONGER} AS r FROM ({_FACT} {_CORRELATION}) c) s")
def correlation_significance(spark, sf_dir):
    """The stronger of two correlations of each pair of columns and its p-value."""
    found = significance.correlations(facts(spark, sf_dir), ["price", "freight_value", "revenue"])
    return found.select("a", "b", F.round("r", 6).alias("r"), F.round("p", 9).alias("p"))


_GEO = f""", cells AS (SELECT customer_state AS state, product_category_name_english AS category, {_MONEY.format('revenue')} AS revenue, count(DISTINCT order_id) AS n_orders FROM fact
  WHERE revenue IS NOT NULL AND customer_state IS NOT NULL AND product_category_name_english IS NOT NULL GROUP BY ALL),
lifts AS (SELECT state, category, revenue, n_orders, sum(revenue) OVER (PARTITION BY state) AS s, sum(revenue) OVER (PARTITION BY category) AS c, sum(revenue) OVER () AS w FROM cells)
SELECT state, category, round((revenue / s) / (c / w), 6) AS lift, round(revenue / s, 6) AS share_state, round(revenue, 2) AS revenue, n_orders FROM lifts WHERE n_orders >= 30 AND s <> 0 AND c <> 0"""


def _geo(f: DataFrame, schema: FactSchema = FactSchema()) -> DataFrame:
    return rounded(graph.geo_lift(f, 30, schema)).withColumn("revenue", F.round("revenue", 2))


@query(_FACT + _GEO)
def geo_category_lift(spark, sf_dir):
    return _geo(facts(spark, sf_dir))


@query(_STAR_FACT + _GEO)
def star_geo_category_lift(spark, sf_dir):
    return _geo(star_facts(spark, sf_dir), STAR)


_PAIR_LIFT = """, sets AS (SELECT DISTINCT order_id, product_category_name_english AS cat FROM fact WHERE product_category_name_english IS NOT NULL), one AS (SELECT cat, count(*) AS k FROM sets GROUP BY cat),
n AS (SELECT count(DISTINCT order_id) AS n FROM sets), both_items AS (SELECT a.cat AS item_a, b.cat AS item_b, count(*) AS n_orders FROM sets a JOIN sets b ON a.order_id = b.order_id AND a.cat < b.cat WHERE a.cat <> '' GROUP BY ALL)
SELECT item_a, item_b, round(n_orders * n / (x.k::DOUBLE * y.k), 6) AS lift, round(n_orders / n, 9) AS support, n_orders FROM both_items, n, one x, one y WHERE x.cat = item_a AND y.cat = item_b AND n_orders >= 10 AND n_orders / n >= 0.001"""


@query(_FACT + _PAIR_LIFT)
def co_purchase_lift(spark, sf_dir):
    p = graph.pair_lift(facts(spark, sf_dir), SETTINGS.pair_support, SETTINGS.pair_count)
    return p.withColumns({"lift": F.round("lift", 6), "support": F.round("support", 9)})


@query(_STAR_FACT + _PAIR_LIFT)
def star_co_purchase_lift(spark, sf_dir):
    p = graph.pair_lift(star_facts(spark, sf_dir), SETTINGS.pair_support, SETTINGS.pair_count, STAR)
    return p.withColumns({"lift": F.round("lift", 6), "support": F.round("support", 9)})


@query(_FACT + " SELECT order_id, string_agg(DISTINCT product_category_name_english, '; ' ORDER BY product_category_name_english) AS categories FROM fact WHERE product_category_name_english IS NOT NULL GROUP BY 1")
def order_category_sets(spark, sf_dir):
    return graph.order_categories(facts(spark, sf_dir)).select("order_id", F.array_join("categories", "; ").alias("categories"))


@query()
def community_overview(spark, sf_dir):
    return graph.communities(graph.pair_lift(facts(spark, sf_dir), SETTINGS.pair_support, SETTINGS.pair_count))


_PANEL = _FACT + _CHANGES + f""", panel AS (SELECT customer_state AS state, product_category_name_english AS category, quarter AS period, {_MONEY.format('revenue')} AS revenue, count(DISTINCT order_id) AS orders, count(*) AS n_items,
  {_MONEY.format('price')} / nullif(count(price), 0) AS avg_price, {_MONEY.format('freight_value')} AS freight_total, {_MONEY.format('price')} AS price_total, avg(review_score) AS reviews_mean, count(review_score) AS reviews_count,
  any_value(CASE WHEN quarter = pair.period THEN 1 ELSE 0 END) AS treatment FROM fact, pair WHERE quarter IN (pair.period, pair.prev_period) AND customer_state IS NOT NULL AND product_category_name_english IS NOT NULL GROUP BY ALL HAVING count(price) > 0)"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, *pair = two_quarters(spark, sf_dir, "customer_state", "product_category_name_english", "price", "freight_value", "review_score")
    return causal.panel(f, *pair)


@query(_PANEL + """ SELECT state, category, period, revenue, orders, n_items, round(avg_price, 6) AS avg_price, freight_total, price_total, round(reviews_mean, 6) AS reviews_mean, reviews_count,
  round(freight_total / nullif(price_total, 0), 6) AS freight_ratio, round(reviews_count / n_items, 6) AS review_rate, treatment FROM panel""")
def causal_panel(spark, sf_dir):
    return rounded(_panel(spark, sf_dir))


_OLS = ("revenue", "treatment", "n_items", "avg_price")


@query(_PANEL + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(sum(({a})::DOUBLE * ({b})::DOUBLE), 0), 0) AS total FROM (SELECT *, 1.0 AS const FROM panel) p" for i, a in enumerate((*_OLS, "const")) for b in (*_OLS, "const")[i:]))
def ols_sums(spark, sf_dir):
    return causal.gram_sums(_panel(spark, sf_dir), list(_OLS)).withColumn("total", F.round("total", 0))


@query()
def causal_verdict(spark, sf_dir):
    """Least squares with a bootstrap interval: numeric work on the collected panel."""
    v = causal.test_change(_panel(spark, sf_dir), SETTINGS)
    low, high = v.interval or (None, None)
    return spark.createDataFrame([(v.verdict, v.effect, v.p_value, low, high)], "verdict string, effect double, p_value double, low double, high double")


@query()
def panel_links(spark, sf_dir):
    return spark.createDataFrame(causal.linked(_panel(spark, sf_dir), SETTINGS), "a string, b string")


@query()
def bootstrap_interval(spark, sf_dir):
    """Interval of the difference of mean daily revenue between two quarters: at most 92 days each come to the driver."""
    f, period, prev = two_quarters(spark, sf_dir, "day")
    rows = periods.daily(f.where(F.col("quarter").isin(period, prev))).collect()
    import numpy as np

    sides = [np.array([r["revenue"] for r in rows if r["quarter"] == q]) for q in (prev, period)]
    return spark.createDataFrame([kernels.mean_difference_interval(*sides, SETTINGS.draws, SETTINGS.seed)], "low double, high double")


_PROFILED = {"olist_orders_dataset": ("order_id", "customer_id", "order_status"), "olist_order_items_dataset": ("order_id", "order_item_id", "product_id", "price", "freight_value"), "olist_customers_dataset": ("customer_id", "customer_state", "customer_city"), "olist_products_dataset": ("product_id", "product_category_name")}
_EDGED = {"order_item_id", "price", "freight_value"}


@query("\nUNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, round(1 - count({c}) / count(*), 9) AS missing, count(DISTINCT {c}) AS cardinality, {f'min({c})::DOUBLE' if c in _EDGED else 'NULL::DOUBLE'} AS low, {f'max({c})::DOUBLE' if c in _EDGED else 'NULL::DOUBLE'} AS high FROM {t}" for t, cs in _PROFILED.items() for c in cs))
def table_profile(spark, sf_dir):
    parts = [discovery.summary(spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*cs)).withColumn("table_name", F.lit(t)) for t, cs in _PROFILED.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("table_name", "column_name", "n_rows", F.round("missing", 9).alias("missing"), "cardinality", F.col("low").try_cast("double").alias("low"), F.col("high").try_cast("double").alias("high"))


_OVERLAPS = (("olist_orders_dataset", "olist_order_items_dataset", "order_id"), ("olist_customers_dataset", "olist_orders_dataset", "customer_id"), ("olist_order_items_dataset", "olist_products_dataset", "product_id"), ("olist_order_items_dataset", "olist_sellers_dataset", "seller_id"))


@query("\nUNION ALL ".join(f"SELECT '{a}' AS left_table, '{b}' AS right_table, '{c}' AS column_name, count(DISTINCT l.{c}) AS n_left, count(DISTINCT r.{c}) AS n_both FROM {a} l LEFT JOIN (SELECT DISTINCT {c} FROM {b}) r USING ({c})".replace(f"count(DISTINCT r.{c})", f"count(DISTINCT CASE WHEN r.{c} IS NOT NULL THEN l.{c} END)").replace(f"USING ({c})", f"ON l.{c} = r.{c}") for a, b, c in _OVERLAPS))
def join_overlap(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    parts = [discovery.overlap(read(a), read(b), c).select(F.lit(a).alias("left_table"), F.lit(b).alias("right_table"), F.lit(c).alias("column_name"), "n_left", "n_both") for a, b, c in _OVERLAPS]
    return reduce(DataFrame.unionByName, parts)


_VIEWS = """WITH orders AS (SELECT * FROM olist_orders_dataset), customers AS (SELECT * FROM olist_customers_dataset), products AS (SELECT * FROM olist_products_dataset), categories AS (SELECT * FROM product_category_name_translation),
order_items AS (SELECT order_id, order_item_id, product_id, seller_id, CASE WHEN NOT isnan(price) THEN price END AS price, CASE WHEN NOT isnan(freight_value) THEN freight_value END AS freight_value FROM olist_order_items_dataset)"""


def _bound(sql: str, **args) -> str:
    """An evidence text with its values put in, for the other engine."""
    for k in sorted(args, key=len, reverse=True):
        sql = sql.replace(f":{k}", repr(args[k]) if not isinstance(args[k], str) else "'" + args[k].replace("'", "''") + "'")
    return sql.replace("NOT (order_status <=> 'canceled')", "order_status IS DISTINCT FROM 'canceled'")


def _evidence(spark, sf_dir, sql: str, **args) -> DataFrame:
    register(tables(spark, sf_dir))
    return rounded(spark.sql(sql, args=args), 2)


_TWO = {**evidence.period_args("base", "2022Q3"), **evidence.period_args("comp", "2022Q4")}


@query(_VIEWS + ", e AS (" + _bound(evidence.HEADLINE.format(metric="revenue"), **_TWO) + ") SELECT round(base_value, 2) AS base_value, round(comp_value, 2) AS comp_value, round(delta_pct, 2) AS delta_pct FROM e")
def headline_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir, evidence.HEADLINE.format(metric="revenue"), **_TWO)


@query(_VIEWS + ", e AS (" + _bound(evidence.MONTHLY, year=2022, month=10) + ") SELECT round(revenue, 2) AS revenue, orders FROM e")
def monthly_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir, evidence.MONTHLY, year=2022, month=10)


@query(_VIEWS + ", e AS (" + _bound(evidence.SEGMENT.format(tables=evidence.BASE_TABLES["customer_state"], dimension="customer_state"), **_TWO, entity="SP") + ") SELECT round(base_value, 2) AS base_value, round(comp_value, 2) AS comp_value FROM e")
def segment_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir, evidence.SEGMENT.format(tables=evidence.BASE_TABLES["customer_state"], dimension="customer_state"), **_TWO, entity="SP")


@query(_VIEWS + ", e AS (" + _bound(evidence.GEO, state="SP", category="kitchenware") + ") SELECT category, round(revenue, 2) AS revenue FROM e")
def geo_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir, evidence.GEO, state="SP", category="kitchenware")


@query(_VIEWS + ", e AS (" + _bound(evidence.AFFINITY, a="balloons", b="skin_care") + ") SELECT n FROM e")
def affinity_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir, evidence.AFFINITY, a="balloons", b="skin_care")


@query(_VIEWS + ", e AS (" + _bound(evidence.CORRELATION.format(a="price", b="freight_value")) + ") SELECT round(r, 2) AS r FROM e")
def correlation_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir, evidence.CORRELATION.format(a="price", b="freight_value"))


@query()
def sampled_rows(spark, sf_dir):
    """A sampling operator: 1,000 orders by a hash of their content."""
    return sample_rows(spark.read.parquet(f"{sf_dir}/olist_orders_dataset.parquet"), 1000, SETTINGS.seed)


@query()
def sampled_references(spark, sf_dir):
    """How many rows of each table a sample of 1,000 orders keeps."""
    kept = sample_orders(tables(spark, sf_dir), 1000, SETTINGS.seed)
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(n)) for n, df in kept.items()])


@query()
def findings_ranked(spark, sf_dir):
    """The whole chain of detectors, tests, evidence and ranking: one row per finding."""
    base = tables(spark, sf_dir)
    with held(read_columns(fact.build_fact(base))) as f:
        found = ranking.rank(test_causes(Finder(f, base, SETTINGS).run(), f, SETTINGS), SETTINGS.top_findings)
    rows = [(x.rank, x.id, x.kind, x.title, round(x.score, 3), x.causal.verdict if x.causal else None, any(e.verified for e in x.evidence)) for x in found[: SETTINGS.top_findings]]
    return spark.createDataFrame(rows, "rank int, id string, kind string, title string, score double, verdict string, verified boolean")
