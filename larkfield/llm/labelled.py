"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label) of at most ``limit`` labelled documents of the learning folds: those whose id hashes least.

    The ids are drawn from the labels alone and broadcast (``limit`` rows), so only their texts are read on.
    """
    drawn = labels.where(learn & F.col(label).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("__id"), F.col(label).cast("int").alias("__label"))
    drawn = drawn.orderBy(F.xxhash64("__id"), "__id", "__label").limit(limit)
    return docs.join(F.broadcast(drawn), F.col(id_column) == F.col("__id")).select(F.col("__id").alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.col("__label").alias("label"))
