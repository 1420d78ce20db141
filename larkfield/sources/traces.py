"""JSON sources: evaluation cases (one a line) and ordered event traces (an array)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CASES = "query string, expect array<string>, expect_prefix string, expect_contains string, expect_not_suffix string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases with an expectation of some kind."""
    rows = spark.read.schema(CASES).json(path)
    return rows.where("expect is not null or expect_prefix is not null or expect_contains is not null or expect_not_suffix is not null")


def read_trace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of trace files (an array each) in order: session_id is the file, seq counts from 1.

    Rows of a file come from one task and are numbered by their place in it.
    """
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    placed = rows.withColumns({"session_id": F.input_file_name(), "__at": F.monotonically_increasing_id()})
    return placed.withColumn("seq", F.row_number().over(W.partitionBy("session_id").orderBy("__at"))).drop("__at")
