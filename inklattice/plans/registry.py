"""All named queries of the engine and the DuckDB statements that give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inklattice.plans import class_queries, drawing_queries, planted_queries, spatial_queries, store_queries, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**text_queries.QUERIES, **store_queries.QUERIES, **spatial_queries.QUERIES, **class_queries.QUERIES, **drawing_queries.QUERIES, **planted_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**text_queries.ORACLE_SQL, **store_queries.ORACLE_SQL, **spatial_queries.ORACLE_SQL, **class_queries.ORACLE_SQL, **drawing_queries.ORACLE_SQL, **planted_queries.ORACLE_SQL}
