"""The library's queries over the driver's tables, and the SQL each has to agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadloom.plans import driver_queries, event_queries, file_queries, network_queries, walk_queries  # noqa: F401 (they add their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(driver_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(driver_queries.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_queries.flagship(spark, sf_dir)
