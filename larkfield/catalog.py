"""All registered queries of the engine, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkfield.plans import graph_queries, session_queries, source_queries, table_queries, text_queries

_MODULES = (text_queries, graph_queries, session_queries, table_queries, source_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fielded BM25 for every benchmark item over the documents."""
    return text_queries.fielded_bm25(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
