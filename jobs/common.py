"""What the jobs share: settings from a JSON file, tables that may not be there yet, the command line's session, logs."""

from __future__ import annotations

import dataclasses
import logging
import sys
import uuid
from typing import TypeVar

from pyspark.sql import SparkSession

from larkfield.operators.postings import shared_folder

S = TypeVar("S")


def settings(spark: SparkSession, kind: type[S], path: str | None) -> S:
    """``kind`` with the values of a JSON file; unknown names and values of another type are errors."""
    if path is None:
        return kind()
    row = spark.read.option("multiLine", True).json(path).first().asDict()
    known = {f.name: f.default for f in dataclasses.fields(kind)}
    for name, value in row.items():
        if name not in known:
            raise ValueError(f"{path}: unknown setting {name}")
        if type(value) is not type(known[name]):
            raise ValueError(f"{path}: {name} must be of type {type(known[name]).__name__}")
    return kind(**row)


def ensure(spark: SparkSession, path: str, schema: str, partition: str) -> None:
    """Makes an empty table without files at ``path`` if nothing is there."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(partition).parquet(path)


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"larkfield.jobs.{name}")


def command_line_session(name: str) -> SparkSession:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def own_folder(spark: SparkSession, job: str) -> str:
    """A new folder of the shared storage for one call of a registered query."""
    return f"{shared_folder(spark)}/larkfield-jobs/{job}-{uuid.uuid4().hex}"
