"""All core queries in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality, sales


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**sales.QUERIES, **quality.QUERIES}


def sql() -> dict[str, str]:
    return {**sales.SQL, **quality.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.period_changes(spark, sf_dir)
