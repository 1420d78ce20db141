"""A log of events as calls of tools: what the correlator takes, read from files that keep arriving."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROPS = "k int, path string, call string, results array<string>, cochange array<string>, referrers array<string>"
#: What the event types of a log mean; all others are counted only.
KINDS = {"view": "locate", "click": "read", "purchase": "slice", "error": "search"}
FILES, LOW_VALUE = 20, 30


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """New Parquet files of a folder, of a pattern, or a single file, oldest first.

    A file source takes folders and patterns; the name of a file becomes a pattern that fits it alone.
    """
    schema = spark.read.parquet(path).schema
    pattern = path if any(c in path for c in "*?[{") else f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def numbered_file(k: Column) -> Column:
    return F.concat(F.lit("f"), (k % FILES).cast("string"))


def calls(events: DataFrame, kinds: Mapping[str, str] = KINDS, low_value: float = LOW_VALUE) -> DataFrame:
    """Rows of events(event_id, ts, user_id, event_type, value, props) as ``correlator.correlate`` takes them.

    What was shown and used stands in ``props`` as JSON: ``path``, ``results``, ``cochange``, ``referrers``, ``call``. A log
    that only has a number ``k`` numbers its files: a search shows up to five of them from k on in steps of seven, with one
    changed together and one that refers to them; a read uses file k and a slice file k + 5; k is also the call's name. A
    search of a ``value`` under ``low_value`` has low confidence. Props that are no JSON name nothing.
    """
    p, k = F.from_json("props", PROPS), F.col("p.k")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.coalesce("event_type", F.lit(""))], F.lit("other"))
    shown = F.slice(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: numbered_file(k + i * 7)), F.lit(1), k % 6)
    locate, used = F.col("kind") == "locate", F.col("kind").isin("read", "slice")
    call = F.coalesce("p.call", k.cast("string"))
    rows = events.select("event_id", "ts", "user_id", "value", p.alias("p"), kind.alias("kind"))
    results = F.when(locate, F.coalesce("p.results", shown))
    return rows.select(
        F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("turn"), "kind",
        F.when(used, F.coalesce("p.path", F.when(F.col("kind") == "read", numbered_file(k)).otherwise(numbered_file(k + 5)))).alias("path"),
        F.when(locate, call).alias("opens"), F.when(F.col("kind") == "slice", call).alias("closes"), results.alias("results"),
        F.when(locate, F.coalesce("p.cochange", F.array(numbered_file(k + 3)))).alias("cochange"),
        F.when(locate, F.coalesce("p.referrers", F.array(numbered_file(k + 11)))).alias("referrers"),
        F.when(locate, F.when(F.col("value") < low_value, "low").otherwise("high")).alias("confidence"), F.when(locate, F.size(results)).alias("result_count"),
    )
