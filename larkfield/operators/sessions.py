"""Sessions: pairing of starts and ends, attribution of what was read to what was found, outcomes.

Tables: locates(locate_id, session_id, seq, turn, results array<string>, cochange array<string>, referrers
array<string>, confidence, result_count, ...), consumes(session_id, seq, turn, kind, path, locate_rank, cluster_kind, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FULL_TURNS, FALLBACK_TURNS, RING = 10, 3, 8


def pair_calls(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Ends with their latency; an end without a start keeps a null latency."""
    begun = starts.select("session_id", "call_id", F.col("ts").alias("start_ts"), "args")
    return ends.join(begun, ["session_id", "call_id"], "left").withColumn("latency_ms", F.col("ts") - F.col("start_ts"))


def numbered(events: DataFrame, session: str = "session_id", *order: str) -> DataFrame:
    """``seq``: 1, 2, ... in each session."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy(session).orderBy(*(order or ("ts",)))))


def next_seq(locates: DataFrame) -> DataFrame:
    return locates.withColumn("next_seq", F.lead("seq").over(W.partitionBy("session_id").orderBy("seq", "locate_id")))


def windows(locates: DataFrame, consumes: DataFrame, turns: int = FULL_TURNS) -> DataFrame:
    """Each consume with the newest locate before it, if within its turns: (locate_id, locate_turn, consume columns).

    Both streams are merged in order of seq and the latest locate is carried forward, so no range join is needed.
    """
    tagged = consumes.withColumn("__row", F.struct(*consumes.columns)).select("session_id", "seq", F.lit(1).alias("__k"), "__row", F.lit(None).cast("struct<id:bigint,turn:bigint,seq:bigint>").alias("__l"))
    begun = locates.select(
        "session_id", "seq", F.lit(0).alias("__k"), F.lit(None).cast(tagged.schema["__row"].dataType).alias("__row"),
        F.struct(F.col("locate_id").cast("long").alias("id"), F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq")).alias("__l"),
    )
    # At the same seq a consume comes before the locate: only later ones belong to it.
    order = W.partitionBy("session_id").orderBy("seq", F.desc("__k")).rowsBetween(W.unboundedPreceding, 0)
    carried = tagged.unionByName(begun).withColumn("__l", F.last("__l", ignorenulls=True).over(order))
    inside = carried.where((F.col("__k") == 1) & F.col("__l").isNotNull())
    out = inside.select(F.col("__l.id").alias("locate_id"), F.col("__l.turn").alias("locate_turn"), F.col("__l.seq").alias("__at"), "__row.*")
    return out.where((F.col("turn") <= F.col("locate_turn") + turns) & (F.col("seq") > F.col("__at"))).drop("__at")


def attribute_ring(locates: DataFrame, consumes: DataFrame, ring: int = RING) -> DataFrame:
    """``consumes`` (session_id, seq, path, ...) with locate_rank and cluster_kind from the newest of the last ``ring``
    locates that shows the path; ranked results go before co-changed files, those before referrers."""
    no = locates.withColumn("__no", F.row_number().over(W.partitionBy("session_id").orderBy("seq", "locate_id")))

    def shown(column: str, kind: int) -> DataFrame:
        return no.select("session_id", "__no", F.lit(kind).alias("__kind"), F.posexplode(column).alias("__pos", "path"))

    # An entry counts for the next ``ring`` turns of the clock of locates, each a key of its own: no consume meets older ones.
    entries = shown("results", 0).unionByName(shown("cochange", 1)).unionByName(shown("referrers", 2))
    entries = entries.withColumn("__now", F.explode(F.sequence("__no", F.col("__no") + ring - 1)))
    marks = no.select("session_id", "seq", F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in consumes.schema) + ">").alias("__row"), F.col("__no"))
    rows = consumes.select("session_id", "seq", F.struct(*consumes.columns).alias("__row"), F.lit(None).cast("int").alias("__no"))
    order = W.partitionBy("session_id").orderBy("seq", F.col("__row").isNull()).rowsBetween(W.unboundedPreceding, 0)
    merged = marks.unionByName(rows).withColumn("__now", F.max("__no").over(order)).where("__row is not null").select("__row.*", "__now")
    hits = merged.join(entries, ["session_id", "path", "__now"])
    best = hits.groupBy("session_id", "seq", "path").agg(F.max_by(F.struct("__kind", "__pos"), F.struct("__no", -F.col("__kind"), -F.col("__pos"))).alias("__b"))
    out = consumes.join(best, ["session_id", "seq", "path"], "left")
    return out.select(
        *consumes.columns, F.when(F.col("__b.__kind") == 0, F.col("__b.__pos") + 1).alias("locate_rank"),
        F.when(F.col("__b.__kind") == 1, "cochange").when(F.col("__b.__kind") == 2, "referrer").alias("cluster_kind"),
    )


def outcomes(locates: DataFrame, consumes: DataFrame, turns: int = FULL_TURNS, fallback_turns: int = FALLBACK_TURNS) -> DataFrame:
    """locates with outcome, hit_rank, turns_to_useful and searches: a hit goes before an assist that no search
    precedes, that before a search within ``fallback_turns``, else the locate is abandoned."""
    return judged(locates, windows(locates, consumes, turns), fallback_turns)


def judged(locates: DataFrame, w: DataFrame, fallback_turns: int = FALLBACK_TURNS) -> DataFrame:
    """``outcomes`` for consumes that already know their locate (locate_id, locate_turn, ...), as ``windows`` gives them."""
    used = F.col("kind").isin("read", "slice")
    hit = used & F.col("locate_rank").isNotNull()
    assist = used & F.col("cluster_kind").isNotNull()
    search = F.col("kind") == "search"
    soon = search & (F.col("turn") <= F.col("locate_turn") + fallback_turns)
    first = lambda cond: F.min(F.when(cond, F.struct("seq", "turn", "locate_rank")))
    found = w.groupBy("locate_id").agg(
        first(hit).alias("hit"), first(assist).alias("assist"), first(soon).alias("soon"), F.count_if(search).alias("searches")
    )
    rows = locates.join(found, "locate_id", "left")
    assisted = F.col("assist").isNotNull() & (F.col("soon").isNull() | (F.col("assist.seq") < F.col("soon.seq")))
    outcome = F.when(F.col("hit").isNotNull(), "hit").when(assisted, "cluster-assist").when(F.col("soon").isNotNull(), "miss-fallback").otherwise("abandoned")
    rows = rows.withColumn("outcome", outcome)
    useful = F.when(F.col("outcome") == "hit", F.col("hit.turn")).when(F.col("outcome") == "cluster-assist", F.col("assist.turn"))
    return rows.select(
        *locates.columns, "outcome", F.when(F.col("outcome") == "hit", F.col("hit.locate_rank")).alias("hit_rank"),
        (useful - F.col("turn")).alias("turns_to_useful"), F.coalesce("searches", F.lit(0)).alias("searches"),
        ((F.col("confidence") == "low") | (F.col("result_count") == 0)).alias("justified_fallback"),
    )


def unchanged_reads(reads: DataFrame) -> DataFrame:
    """``unchanged``: the content hash equals that of the last read of the path in the session; null for the first."""
    last = F.lag("hash").over(W.partitionBy("session_id", "path").orderBy("seq"))
    return reads.withColumn("unchanged", last == F.col("hash"))


def retain(tables: dict[str, DataFrame], now_ms: int, days: int = 30) -> dict[str, DataFrame]:
    """Rows since the cut-off, then rows of surviving sessions only; tables: sessions and others with session_id and ts."""
    cutoff = now_ms - days * 86_400_000
    sessions = tables["sessions"].where(F.col("started_at") >= cutoff)
    keys = sessions.select("session_id")
    return {"sessions": sessions} | {n: t.where(F.col("ts") >= cutoff).join(keys, "session_id", "left_semi") for n, t in tables.items() if n != "sessions"}


def session_flags(events: DataFrame) -> DataFrame:
    """One row for each session: the first start, sticky flags, and the last state of the tool selection."""
    return events.groupBy("session_id").agg(
        F.min("ts").alias("started_at"), F.min_by("repo_root", "ts").alias("repo_root"), F.max("is_writer").alias("is_writer"),
        F.max("used_locate").alias("used_locate"), F.max_by("tools_selected", "ts").alias("tools_selected"),
    )


def checked(consumes: DataFrame) -> DataFrame:
    """Fails on a row that has both a rank and a cluster kind."""
    both = F.col("locate_rank").isNotNull() & F.col("cluster_kind").isNotNull()
    guard: Column = F.when(both, F.raise_error(F.lit("a consume has both a rank and a cluster kind")).cast("int")).otherwise(F.col("locate_rank"))
    return consumes.withColumn("locate_rank", guard)
