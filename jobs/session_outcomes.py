"""Tells from a growing log of events how useful searches were, day by day.

    python -m jobs.session_outcomes --events PATH --output PATH --checkpoint PATH [--config jobs/session_outcomes.json]

A run takes the Parquet files of ``events`` (event_id, ts, user_id, event_type, value, props) that came since the last
one through the stateful correlator, which numbers the events of each session, finds for each use of a file the search that
showed it, and times calls. Then it judges the searches of those days, and no others, whose rows are new:

    OUTPUT/calls/day=D/batch=N/     searches, reads, slices and fallback searches, under the day of their search
    OUTPUT/outcomes/day=D/          hit, cluster-assist, miss-fallback or abandoned for each search
    OUTPUT/summary/day=D/           counts, rates, MRR and hit@k of the day; the last batch they hold

The stream's checkpoint tells new files apart and keeps the state of sessions. Batches that are played again replace their
own partitions. A day is judged anew while its calls hold a batch that its summary, which is written last, does not: so a
run that was interrupted anywhere is made good by the next one, and a run without new files changes nothing.

The configuration names the event types; ``larkfield.streaming.event_log`` tells how rows of the log are read.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line_session, ensure, logger, own_folder, settings
from larkfield.operators import metrics, sessions
from larkfield.plans.session_queries import PRELUDE
from larkfield.streaming.correlator import OUTPUT, correlate, late_rows, state_store
from larkfield.streaming.event_log import calls, file_stream

NAME = "job2_session_outcomes"
LOG = logger("session_outcomes")
CALLS = OUTPUT + ", day date, batch long"
OUTCOMES = (
    "locate_id long, session_id string, seq long, turn long, confidence string, result_count int, outcome string, hit_rank int, turns_to_useful long, "
    "searches long, justified_fallback boolean, day date"
)


@dataclass(frozen=True)
class Settings:
    locate: str = "view"
    read: str = "click"
    slice: str = "purchase"
    search: str = "error"
    low_value: int = 30
    #: A row later than this is an error: it would not be judged.
    delay: str = "1 day"
    files_per_batch: int = 1_000


def replace(df: DataFrame, path: str, *parts: str) -> None:
    """Replaces the partitions that ``df`` has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def judge(rows: DataFrame) -> DataFrame:
    """Outcomes of the searches of whole days; what was used lies under the day of its search."""
    locates = rows.where("kind = 'locate'").select("locate_id", "session_id", "seq", "turn", "confidence", "result_count", "day")
    used = rows.where("kind <> 'locate' and locate_id is not null").select("locate_id", "locate_turn", "kind", "seq", "turn", "locate_rank", "cluster_kind")
    return sessions.judged(locates, used)


def run(spark: SparkSession, events: str, output: str, checkpoint: str, options: Settings = Settings()) -> dict[str, int]:
    """Takes what is new and judges the days that it touches; gives the counts."""
    ensure(spark, f"{output}/calls", CALLS, "batch")
    ensure(spark, f"{output}/summary", "upto long, day date", "day")
    batches: list[int] = []

    def take(rows: DataFrame, number: int) -> None:
        day = F.coalesce("locate_ts", "ts").cast("date")
        replace(rows.withColumns({"day": day, "batch": F.lit(number)}), f"{output}/calls", "day", "batch")
        batches.append(number)

    LOG.info("reading %s, writing %s", events, output)
    with state_store(spark):
        kinds = {getattr(options, kind): kind for kind in ("locate", "read", "slice", "search")}
        source = calls(file_stream(spark, events, options.files_per_batch), kinds, options.low_value)
        out = correlate(source, options.delay, own_turns=True)
        query = out.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    LOG.info("%d batches, %d rows read", len(batches), read)
    if late_rows(query):
        raise ValueError(f"{late_rows(query)} rows came later than {options.delay} and were not taken; raise delay and start with a new checkpoint")

    held = spark.read.schema(CALLS).parquet(f"{output}/calls")
    judged = spark.read.schema("upto long, day date").parquet(f"{output}/summary").groupBy("day").agg(F.max("upto").alias("upto"))
    latest = held.groupBy("day").agg(F.max("batch").alias("upto"))  # partition columns alone: no rows are read
    stale = latest.join(judged.withColumnRenamed("upto", "seen"), "day", "left").where("seen is null or seen < upto")
    days = {r.day: r.upto for r in stale.collect()}  # one row a day
    if days:
        rows = held.where(F.col("day").isin(list(days)))
        replace(judge(rows), f"{output}/outcomes", "day")
        done = spark.read.schema(OUTCOMES).parquet(f"{output}/outcomes").where(F.col("day").isin(list(days)))
        counted = rows.groupBy("day").agg(F.max("batch").alias("upto"), F.count_if(F.col("kind") != "locate").alias("n_used"), F.round(F.avg("latency_ms"), 3).alias("mean_latency_ms"))
        replace(counted.join(metrics.outcome_metrics(done, "day"), "day", "left"), f"{output}/summary", "day")
    LOG.info("%d days judged: %s", len(days), ", ".join(sorted(map(str, days))) or "none")
    return {"rows": read, "batches": len(batches), "days": len(days)}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over ``events``, twice: the second run finds nothing new."""
    folder = own_folder(spark, NAME)
    for _ in range(2):
        run(spark, f"{sf_dir}/events.parquet", f"{folder}/output", f"{folder}/checkpoint")
    out = spark.read.schema(OUTCOMES).parquet(f"{folder}/output/outcomes")
    return out.select(F.col("day").cast("string").alias("day"), F.col("session_id").cast("long").alias("session_id"), "locate_id", "seq", "confidence", "result_count", "outcome", "hit_rank", "turns_to_useful", "searches", "justified_fallback")


SQL = PRELUDE + """SELECT strftime(e.ts, '%Y-%m-%d') AS day, oo.session_id, oo.locate_id, oo.seq, oo.confidence, oo.result_count, oo.outcome,
    CASE WHEN oo.outcome = 'hit' THEN oo.hit_rank END AS hit_rank, oo.turns_to_useful, oo.searches, oo.justified_fallback FROM oo JOIN ev e ON e.event_id = oo.locate_id"""


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("events", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    given = parser.parse_args()
    spark = command_line_session("session_outcomes")
    try:
        run(spark, given.events, given.output, given.checkpoint, settings(spark, Settings, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
