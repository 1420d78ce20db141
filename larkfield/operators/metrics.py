"""Retrieval metrics over outcomes and their companions, overall or for each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("hit", "cluster-assist", "miss-fallback", "abandoned")


def rate(part: Column, whole: Column) -> Column:
    """0 on an empty denominator."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def outcome_metrics(outcomes: DataFrame, by: str | None = None) -> DataFrame:
    """Counts and rates of outcomes, MRR over hits, hit@k over all, precision by confidence, median turns, searches."""
    n = F.count("*")
    hit = F.col("outcome") == "hit"
    wrong = (F.col("outcome") == "miss-fallback") & ~F.col("justified_fallback")
    made = [n.alias("n_locates")]
    for o in OUTCOMES:
        made.append(F.count_if(F.col("outcome") == o).alias(f"n_{o.replace('-', '_')}"))
        made.append(rate(F.count_if(F.col("outcome") == o), n).alias(f"{o.replace('-', '_')}_rate"))
    made.append(F.coalesce(F.avg(F.when(hit, 1.0 / F.col("hit_rank"))), F.lit(0.0)).alias("mrr"))
    made += [rate(F.count_if(hit & (F.col("hit_rank") <= k)), n).alias(f"hit_at_{k}") for k in (1, 3, 5)]
    for c in ("high", "low"):
        made.append(rate(F.count_if(hit & (F.col("confidence") == c)), F.count_if(F.col("confidence") == c)).alias(f"precision_{c}"))
    made.append(F.coalesce(F.median("turns_to_useful"), F.lit(0.0)).alias("median_turns"))
    made.append(F.coalesce(F.sum(F.when(F.col("outcome") == "miss-fallback", F.col("searches"))), F.lit(0)).alias("fallback_searches"))
    made.append(F.count_if(wrong).alias("n_unjustified_fallback"))
    return (outcomes.groupBy(by) if by else outcomes.groupBy()).agg(*made)


def session_metrics(sessions: DataFrame) -> DataFrame:
    n, used = F.count("*"), F.count_if("used_locate")
    return sessions.agg(
        n.alias("sessions"), used.alias("with_locate"), F.when(n > 0, 1.0 - rate(used, n)).otherwise(0.0).alias("bypass_rate"),
        F.count_if("tools_selected").alias("with_tools"), F.count_if(~F.col("tools_selected")).alias("without_tools"),
    )


def slice_metrics(consumes: DataFrame) -> DataFrame:
    sliced = F.col("kind") == "slice"
    stale = sliced & F.coalesce("stale_index", F.lit(False))
    return consumes.agg(
        F.count_if(sliced).alias("slices"), rate(F.count_if(stale), F.count_if(sliced)).alias("stale_rate"),
        F.count_if(sliced & F.coalesce("unchanged", F.lit(False))).alias("unchanged_avoided"),
    )


def reasons(unavailable: DataFrame) -> DataFrame:
    """One row with the map of reasons to counts, sorted by reason."""
    counted = unavailable.groupBy("reason").agg(F.count("*").alias("n"))
    return counted.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("by_reason"))


def guard_counts(guards: DataFrame, actions: tuple[str, ...] = ("allow", "warn", "block")) -> DataFrame:
    return guards.agg(*[F.count_if(F.col("action") == a).alias(a) for a in actions])


def coverage(files: DataFrame) -> DataFrame:
    n, done = F.count("*"), F.count_if("symbols_done")
    return files.agg(n.alias("total"), done.alias("indexed"), rate(done, n).alias("ratio"))


def both_scopes(outcomes: DataFrame) -> DataFrame:
    """Metrics of each session and, under a null session, of the whole."""
    every = outcome_metrics(outcomes, "session_id")
    whole = outcome_metrics(outcomes).withColumn("session_id", F.lit(None).cast(outcomes.schema["session_id"].dataType))
    return every.unionByName(whole)
