"""A cleaning pipeline over ``documents``: quality rules, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns they came with; the last
adds the place of each document. Between stages the documents are written and read again, so that a lost executor
costs no more than the stage at hand; a stage's table is deleted once the next one is written.

Defined results: all input columns travel, whatever their names, and the place is called ``shard`` and ``slot``, with an
underscore behind where the input has these names; null and empty texts fail the quality rules; texts are read whole; of
rows with one id in a group of near copies one stays, of equal rows any; rows that tie in id, text and all other columns
share their places in any order; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.llm import line_quality
from larkfield.llm import mixing as mixing_operator
from larkfield.llm.common import Stored, table
from larkfield.llm.decontaminate import clean
from larkfield.llm.sharding import shard
from larkfield.llm.simhash import keep_one, keep_one_similar

SHARDS, FRACTION = 16, 0.7


def _filtered(docs: DataFrame, written: Iterable[str], judge: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows that ``judge`` marks by ``keep``, with their own columns even where the operator writes the same names."""
    if {w.lower() for w in written} & {c.lower() for c in docs.columns}:
        return judge(docs.select("*", F.struct("*").alias("__row"))).where(keep).select("__row.*")
    return judge(docs).where(keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base counts or whose lines are mostly boilerplate."""
    return _filtered(docs, [f.name for f in line_quality.FIELDS], line_quality.line_quality, "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: fingerprints within 2 bits, then similarity of 0.8 or more."""
    return keep_one_similar(keep_one(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens follow the damped source, language and topic shares."""
    return _filtered(docs, mixing_operator.WRITTEN, lambda df: mixing_operator.mix(df, FRACTION), "sampled")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document its shard and slot; rows of one id and text are told apart by their other columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select("doc_id", "text", F.xxhash64(*columns).alias("__tie"), F.struct(*columns).alias("__row"))
    placed = shard(packed, SHARDS, ties=("text", "__tie"))
    taken = {c.lower() for c in docs.columns}
    named = [F.col(n).alias(next(m for m in (n + "_" * k for k in range(9)) if m not in taken)) for n in ("shard", "slot")]
    return placed.select("__row.*", *named)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The stages fit and decode models, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        after = Stored(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
