"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobweave.plans import core_queries, cv_queries, offer_queries, people_queries, provider_queries, reference_queries

MODULES = (core_queries, reference_queries, cv_queries, offer_queries, provider_queries, people_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return reference_queries.u03_market_search(spark, d)
