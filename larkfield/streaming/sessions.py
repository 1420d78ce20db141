"""Streams of events: pairing of starts and ends, windowed counts, session windows, incremental snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.operators.snapshot import SnapshotTable, upsert_newest


def with_event_time(events: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Watermarks need TIMESTAMP; times without a zone are read in the session's zone."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def pair_stream(starts: DataFrame, ends: DataFrame, delay: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """Ends with the latency of their start; state is bounded by the watermark and the longest call."""
    a = with_event_time(starts, "ts", delay).select(F.col("call_id").alias("start_id"), F.col("session_id").alias("start_session"), F.col("ts").alias("start_ts"))
    b = with_event_time(ends, "ts", delay)
    same = (F.col("call_id") == F.col("start_id")) & (F.col("session_id") == F.col("start_session"))
    near = (F.col("ts") >= F.col("start_ts")) & (F.col("ts") <= F.col("start_ts") + F.expr(f"interval {longest}"))
    joined = b.join(a, same & near, "left_outer")
    return joined.withColumn("latency_ms", F.unix_millis("ts") - F.unix_millis("start_ts")).drop("start_id", "start_session")


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return with_event_time(events, "ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, started, ended, n): sessions end after a pause of ``gap``."""
    rows = with_event_time(events, "ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def keep_current(stream: DataFrame, table: SnapshotTable, key: str, checkpoint: str, once: bool = True):
    """Merges each micro-batch into a snapshot table: the row of the highest ``version`` of a key stays, the newcomer of
    equal ones. The number of the last batch is committed with its rows, so a batch that is played again changes nothing.
    """
    mark = f"batch:{checkpoint}"

    def merge(batch: DataFrame, number: int) -> None:
        if number <= int(table.get_meta(mark) or -1):
            return
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "version").alias("__r")).select("__r.*")
        old = table.read()
        table.write(last if old is None else upsert_newest(old, last, key, "version"), meta={mark: str(number)})

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
