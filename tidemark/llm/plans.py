"""Queries over the text tables for the problems 6 to 8, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import leakage, packing, toxicity

CAPACITY = 2048
#: The share of a test item's words from which a post counts as holding the item, not just a passage of it.
COVERED = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = packing.token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", CAPACITY)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers leave how many tokens unused."""
    used = packing.fill(p6_containers(spark, sf_dir), CAPACITY)
    return used.groupBy("unused").agg(F.count("*").alias("n_containers"), F.sum("n_pieces").alias("n_pieces"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every arrangement: how many documents are placed, and how many containers or documents break a rule."""
    placed = cut(p6_containers(spark, sf_dir))
    full = packing.fill(placed, CAPACITY).agg(F.coalesce(F.sum((F.col("filled") > CAPACITY).cast("bigint")), F.lit(0)).alias("n_overfull"), F.sum("filled").alias("filled"), F.count("*").alias("n"))
    each = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.count_distinct("piece").alias("different"), F.max("piece").alias("last"), F.sum("length").alias("tokens"), F.sum("container").alias("somewhere"))
    rules = each.agg(
        F.count("*").alias("n_documents"),
        F.sum(((F.col("pieces") != F.col("different")) | (F.col("last") != F.col("pieces") - 1)).cast("bigint")).alias("n_repeated_or_lost"),
        F.sum(((F.col("pieces") > 1) & (F.col("tokens") <= CAPACITY)).cast("bigint")).alias("n_divided_without_need"),
        F.sum(((F.col("tokens") > 0) & F.col("somewhere").isNull()).cast("bigint")).alias("n_not_placed"),
    )
    both = rules.join(F.broadcast(full))  # one row each
    return both.select("n_documents", "n_repeated_or_lost", "n_divided_without_need", "n_not_placed", "n_overfull", (F.col("n") <= F.ceil(F.col("filled") / CAPACITY) + 1).alias("hardly_any_unused"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("item_id", "doc_id")


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).withColumn("coverage", F.round("coverage", 6))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suite, item_id, n_docs): the test items that leaked, and into how many posts."""
    per_item = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return _table(spark, sf_dir, "benchmark").select("suite", "item_id").join(per_item, "item_id").select("suite", "item_id", "n_docs")


def p7_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, n_tiles, coverage): pairs in which tiles, in whatever order, cover at least COVERED of the item's words."""
    found = leakage.covered(_leaks(spark, sf_dir), COVERED)
    return found.select("item_id", "doc_id", "n_tiles", F.round("coverage", 6).alias("coverage"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    machine = toxicity.fit(*toxicity.labelled(documents, _table(spark, sf_dir, "labels")), spark=spark)
    return toxicity.score(documents, machine)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).where("flagged").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 3))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.rates(documents, _scores(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_containers, p6_fill, p6_invariants, p7_found, p7_coverage, p7_contaminated, p7_items, p8_found, p8_scores, p8_rates)}

_WORDS = "list_filter(string_split_regex(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_P7 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
seeds AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 9)) AS i FROM b)),
runs AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 9)) AS i FROM d)),
found AS (SELECT DISTINCT item_id, doc_id FROM seeds JOIN runs USING (s))
"""
SQL: dict[str, str] = {
    "p6_invariants": "SELECT count(DISTINCT doc_id) AS n_documents, 0::BIGINT AS n_repeated_or_lost, 0::BIGINT AS n_divided_without_need, 0::BIGINT AS n_not_placed, 0::BIGINT AS n_overfull, true AS hardly_any_unused FROM documents",
    "p7_found": _P7 + "SELECT item_id, doc_id FROM found",
    "p7_items": _P7 + "SELECT suite, item_id, count(*) AS n_docs FROM found JOIN benchmark USING (item_id) GROUP BY ALL",
}
