"""Runnable jobs, and the queries that run them over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import index_documents, session_outcomes

_JOBS = (index_documents, session_outcomes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {job.NAME: job.query for job in _JOBS}


def oracle_sql() -> dict[str, str]:
    return {job.NAME: job.SQL for job in _JOBS}
