"""Cases for review: locates with their outcome, the fallback that followed, and a verdict on the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.operators.sessions import windows
from larkfield.sources.files import is_secret


def priority(outcome: Column, justified: Column, confidence: Column) -> Column:
    miss = outcome == "miss-fallback"
    return (
        F.when(miss & ~justified, 0).when(outcome == "cluster-assist", 1).when(miss, 2).when(outcome == "abandoned", 3)
        .when(confidence == "low", 4).otherwise(5)
    )


def string_set(json: Column) -> Column:
    """The distinct strings of a JSON array; anything malformed gives an empty array."""
    parsed = F.coalesce(F.from_json(json, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(parsed))


def fallback_targets(outcomes: DataFrame, consumes: DataFrame) -> DataFrame:
    """(locate_id, target): after a miss, the first read or slice behind the first search; after an assist, its file."""
    w = windows(outcomes, consumes)
    used = F.col("kind").isin("read", "slice") & F.col("path").isNotNull()
    searched = w.groupBy("locate_id").agg(F.min(F.when(F.col("kind") == "search", F.col("seq"))).alias("__s"))
    misses = w.join(searched, "locate_id").where(used & (F.col("seq") > F.col("__s"))).groupBy("locate_id").agg(F.min_by("path", "seq").alias("miss"))
    shown = outcomes.select("locate_id", F.array_union("cochange", "referrers").alias("__c"))
    helped = w.join(shown, "locate_id").where(used & F.array_contains("__c", F.col("path"))).groupBy("locate_id").agg(F.min_by("path", "seq").alias("assist"))
    rows = outcomes.select("locate_id", "outcome").join(misses, "locate_id", "left").join(helped, "locate_id", "left")
    target = F.when(F.col("outcome") == "miss-fallback", F.col("miss")).when(F.col("outcome") == "cluster-assist", F.col("assist"))
    return rows.select("locate_id", target.alias("target"))


def verdicts(outcomes: DataFrame, consumes: DataFrame, files: DataFrame) -> DataFrame:
    """(locate_id, target, verdict): indexed if the locate's cluster had it, indexed_not_returned if only the index
    has it, else not_indexed; secret targets are nulled."""
    shown = outcomes.select("locate_id", "outcome", F.array_union("cochange", "referrers").alias("__c"))
    rows = fallback_targets(outcomes, consumes).join(shown, "locate_id").where(F.col("outcome").isin("miss-fallback", "cluster-assist"))
    rows = rows.withColumn("target", F.when(~is_secret(F.col("target")), F.col("target")))
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("__known"))
    rows = rows.join(known, "target", "left")
    verdict = (
        F.when(F.col("target").isNull(), "not_indexed").when(F.array_contains("__c", F.col("target")), "indexed")
        .when(F.col("__known"), "indexed_not_returned").otherwise("not_indexed")
    )
    return rows.select("locate_id", "target", verdict.alias("verdict"))


def export_cases(outcomes: DataFrame, consumes: DataFrame, files: DataFrame, limit: int = 50, outcome: str | None = None, query_type: str | None = None) -> DataFrame:
    """The cases by priority, then locate; secret paths are left out. The limit is that of a report."""
    rank = priority(F.col("outcome"), F.col("justified_fallback"), F.col("confidence"))
    rows = outcomes.withColumn("priority", rank).withColumn("results", F.filter("results", lambda p: ~is_secret(p)))
    if outcome:
        rows = rows.where(F.col("outcome") == outcome)
    if query_type:
        rows = rows.where(F.col("query_type") == query_type)
    top = rows.orderBy("priority", "locate_id").limit(limit)
    reads = windows(outcomes, consumes).where(F.col("path").isNull() | ~is_secret(F.col("path")))
    followed = reads.groupBy("locate_id").agg(F.sort_array(F.collect_list(F.struct("seq", "turn", "kind", "path", "locate_rank"))).alias("consumes"))
    return top.join(followed, "locate_id", "left").join(verdicts(outcomes, consumes, files), "locate_id", "left").orderBy("priority", "locate_id")
