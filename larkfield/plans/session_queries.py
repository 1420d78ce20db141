"""Session queries over the driver's ``events``: a view is a locate, clicks and purchases use paths, errors search.

The number k of an event stands for paths f0 to f19; a view shows up to five ranked paths, one co-changed file and
one referrer, all derived from k.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.operators import export, metrics, sessions
from larkfield.operators.postings import shared_folder

NOW_MS = 1_706_659_200_000  # 2024-01-31 00:00:00 UTC, just after the last event


def _path(shift: int = 0):
    return F.concat(F.lit("f"), ((F.col("k") + shift) % 20).cast("string"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = raw.select("event_id", F.col("user_id").alias("session_id"), "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return sessions.numbered(rows, "session_id", "ts", "event_id").withColumn("turn", F.col("seq"))


def telemetry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, sf_dir)
    shown = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("f"), ((F.col("k") + i * 7) % 20).cast("string")))
    locates = ev.where("event_type = 'view'").select(
        F.col("event_id").alias("locate_id"), "session_id", "seq", "turn", F.slice(shown, F.lit(1), F.col("k") % 6).alias("results"),
        F.array(_path(3)).alias("cochange"), F.array(_path(11)).alias("referrers"), F.when(F.col("value") < 30, "low").otherwise("high").alias("confidence"),
        (F.col("k") % 6).alias("result_count"),
    )
    kind = F.when(F.col("event_type") == "click", "read").when(F.col("event_type") == "purchase", "slice").otherwise("search")
    path = F.when(F.col("event_type") == "click", _path()).when(F.col("event_type") == "purchase", _path(5))
    used = ev.where(F.col("event_type").isin("click", "purchase", "error")).select("session_id", "seq", "turn", kind.alias("kind"), path.alias("path"))
    return locates, sessions.attribute_ring(locates, used)


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.outcomes(*telemetry(spark, sf_dir))


PRELUDE = """
WITH ev AS (SELECT event_id, user_id AS session_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
l AS (SELECT event_id AS locate_id, session_id, seq, seq AS turn, k, k % 6 AS result_count,
    CASE WHEN value < 30 THEN 'low' ELSE 'high' END AS confidence,
    row_number() OVER (PARTITION BY session_id ORDER BY seq) AS no, lead(seq) OVER (PARTITION BY session_id ORDER BY seq) AS next_seq
    FROM ev WHERE event_type = 'view'),
c AS (SELECT session_id, seq, seq AS turn, CASE event_type WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'slice' ELSE 'search' END AS kind,
    CASE event_type WHEN 'click' THEN concat('f', k % 20) WHEN 'purchase' THEN concat('f', (k + 5) % 20) END AS path
    FROM ev WHERE event_type IN ('click', 'purchase', 'error')),
shown AS (SELECT locate_id, session_id, seq, no, concat('f', (k + i * 7) % 20) AS path, i AS pos, 0 AS src FROM l, range(5) AS t(i) WHERE i < result_count
    UNION ALL SELECT locate_id, session_id, seq, no, concat('f', (k + 3) % 20), 0, 1 FROM l
    UNION ALL SELECT locate_id, session_id, seq, no, concat('f', (k + 11) % 20), 0, 2 FROM l),
latest AS (SELECT c.session_id, c.seq, max(l.no) AS now_no FROM c JOIN l ON l.session_id = c.session_id AND l.seq < c.seq GROUP BY ALL),
m AS (SELECT c.session_id, c.seq, s.src, s.pos, row_number() OVER (PARTITION BY c.session_id, c.seq ORDER BY s.no DESC, s.src, s.pos) AS rn
    FROM c JOIN latest USING (session_id, seq) JOIN shown s ON s.session_id = c.session_id AND s.path = c.path AND s.seq < c.seq AND now_no - s.no < 8),
r AS (SELECT c.*, CASE WHEN m.src = 0 THEN m.pos + 1 END AS locate_rank, CASE m.src WHEN 1 THEN 'cochange' WHEN 2 THEN 'referrer' END AS cluster_kind
    FROM c LEFT JOIN m ON m.session_id = c.session_id AND m.seq = c.seq AND m.rn = 1),
w AS (SELECT l.locate_id, l.turn AS locate_turn, r.* FROM l JOIN r ON r.session_id = l.session_id AND r.seq > l.seq
    AND (l.next_seq IS NULL OR r.seq < l.next_seq) AND r.turn <= l.turn + 10),
g AS (SELECT locate_id, min(seq) FILTER (kind <> 'search' AND locate_rank IS NOT NULL) AS hit_seq,
    min(seq) FILTER (kind <> 'search' AND cluster_kind IS NOT NULL) AS assist_seq,
    min(seq) FILTER (kind = 'search' AND turn <= locate_turn + 3) AS soon_seq, count(*) FILTER (kind = 'search') AS searches FROM w GROUP BY 1),
o AS (SELECT l.*, CASE WHEN hit_seq IS NOT NULL THEN 'hit' WHEN assist_seq IS NOT NULL AND (soon_seq IS NULL OR assist_seq < soon_seq) THEN 'cluster-assist'
    WHEN soon_seq IS NOT NULL THEN 'miss-fallback' ELSE 'abandoned' END AS outcome, hit_seq, assist_seq, coalesce(searches, 0) AS searches,
    (confidence = 'low' OR result_count = 0) AS justified_fallback,
    (SELECT max(locate_rank) FROM r WHERE r.session_id = l.session_id AND r.seq = g.hit_seq) AS hit_rank
    FROM l LEFT JOIN g USING (locate_id)),
oo AS (SELECT *, CASE outcome WHEN 'hit' THEN hit_seq - turn WHEN 'cluster-assist' THEN assist_seq - turn END AS turns_to_useful FROM o)
"""


def next_event_window(spark, sf_dir):
    return sessions.next_seq(telemetry(spark, sf_dir)[0]).select("locate_id", "session_id", "seq", "next_seq")


def asof_latest_match(spark, sf_dir):
    return telemetry(spark, sf_dir)[1].select("session_id", "seq", "path", "locate_rank", "cluster_kind")


def interval_attribution(spark, sf_dir):
    return sessions.windows(*telemetry(spark, sf_dir)).select("locate_id", "session_id", "seq", "kind", "path")


def outcome_precedence(spark, sf_dir):
    return outcome_rows(spark, sf_dir).select("locate_id", "outcome", "hit_rank", "turns_to_useful", "searches", "justified_fallback")


def mrr_hit_at_k(spark, sf_dir):
    m = metrics.outcome_metrics(outcome_rows(spark, sf_dir))
    return m.select("n_locates", "n_hit", *[F.round(c, 6).alias(c) for c in ("mrr", "hit_at_1", "hit_at_3", "hit_at_5", "hit_rate", "cluster_assist_rate", "miss_fallback_rate", "abandoned_rate")])


def precision_by_class(spark, sf_dir):
    return metrics.outcome_metrics(outcome_rows(spark, sf_dir)).select(F.round("precision_high", 6).alias("precision_high"), F.round("precision_low", 6).alias("precision_low"), "n_unjustified_fallback")


def median_turns(spark, sf_dir):
    return metrics.outcome_metrics(outcome_rows(spark, sf_dir)).select("median_turns", "fallback_searches")


def session_vs_lifetime(spark, sf_dir):
    return metrics.both_scopes(outcome_rows(spark, sf_dir)).select("session_id", "n_locates", "n_hit", "n_abandoned", F.round("mrr", 6).alias("mrr"))


def count_by_reason_map(spark, sf_dir):
    rows = events(spark, sf_dir).where("event_type = 'error'").select(F.when(F.col("k") < 20, "non_git").when(F.col("k") < 50, "disabled").otherwise("booting").alias("reason"))
    return metrics.reasons(rows).select(F.array_join(F.transform(F.map_entries("by_reason"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("by_reason"))


def pivot_actions(spark, sf_dir):
    kinds = {"signup": "allow", "view": "warn", "error": "block"}
    action = F.lit(None).cast("string")
    for event, name in kinds.items():
        action = F.when(F.col("event_type") == event, name).otherwise(action)
    rows = events(spark, sf_dir).withColumn("action", action)
    return rows.groupBy("session_id").pivot("action", ["allow", "warn", "block"]).count().select("session_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("allow", "warn", "block")])


def guard_counts(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.when(F.col("event_type") == "signup", "allow").when(F.col("event_type") == "view", "warn").when(F.col("event_type") == "error", "block").alias("action"))
    return metrics.guard_counts(rows)


def session_bypass(spark, sf_dir):
    ev = events(spark, sf_dir)
    rows = ev.groupBy("session_id").agg(F.max((F.col("event_type") == "view") & (F.col("k") < 5)).alias("used_locate"), F.max_by(F.col("k") % 2 == 0, "seq").alias("tools_selected"))
    return metrics.session_metrics(rows).select("sessions", "with_locate", F.round("bypass_rate", 6).alias("bypass_rate"), "with_tools", "without_tools")


def slice_staleness(spark, sf_dir):
    used = telemetry(spark, sf_dir)[1].withColumns({"stale_index": F.when(F.col("seq") % 3 != 0, F.col("seq") % 2 == 0), "unchanged": F.col("seq") % 5 == 0})
    return metrics.slice_metrics(used).select("slices", F.round("stale_rate", 6).alias("stale_rate"), "unchanged_avoided")


def unchanged_lag(spark, sf_dir):
    reads = events(spark, sf_dir).where("event_type = 'click'").select("session_id", "seq", F.concat(F.lit("f"), (F.col("k") % 4).cast("string")).alias("path"), (F.col("k") % 3).alias("hash"))
    return sessions.unchanged_reads(reads)


def retention_prune(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("ts", F.unix_millis(F.col("ts").cast("timestamp")))
    started = ev.groupBy("session_id").agg((F.min("ts") + (F.col("session_id") % 40) * 86_400_000).alias("started_at"))
    kept = sessions.retain({"sessions": started, "consumes": ev.where("event_type = 'click'")}, NOW_MS, 20)
    return kept["consumes"].groupBy("session_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def orphan_antijoin(spark, sf_dir):
    ev = events(spark, sf_dir)
    live = ev.where("event_type = 'signup' and k >= 70").select("session_id").distinct()
    return ev.join(live, "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("n"))


def ensure_session(spark, sf_dir):
    ev = events(spark, sf_dir).select("session_id", "ts", F.concat(F.lit("r"), F.col("k").cast("string")).alias("repo_root"), (F.col("event_type") == "purchase").alias("is_writer"), (F.col("event_type") == "view").alias("used_locate"), (F.col("k") % 2 == 0).alias("tools_selected"))
    return sessions.session_flags(ev)


def tool_latency(spark, sf_dir):
    ev = events(spark, sf_dir).withColumns({"ts": F.unix_millis(F.col("ts").cast("timestamp")), "call_id": F.col("k"), "args": F.col("value")})
    first = ev.where("event_type = 'view'").groupBy("session_id", "call_id").agg(F.min("ts").alias("ts"), F.min_by("args", "ts").alias("args"))
    ends = ev.where("event_type = 'purchase'").select("event_id", "session_id", "call_id", "ts")
    return sessions.pair_calls(first, ends).select("event_id", "latency_ms")


def verdict_join(spark, sf_dir):
    locates, used = telemetry(spark, sf_dir)
    files = spark.range(15).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    return export.verdicts(sessions.outcomes(locates, used), used, files)


def priority_sort_limit(spark, sf_dir):
    locates, used = telemetry(spark, sf_dir)
    rows = sessions.outcomes(locates, used).withColumn("query_type", F.lit("keyword"))
    return export.export_cases(rows, used, spark.range(15).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))).select("locate_id", "priority", "outcome")


def case_consumes(spark, sf_dir):
    """What was used after the searches of the exported cases, and how many results they show, without a secret file."""
    locates, used = telemetry(spark, sf_dir)
    named = lambda p: F.when(p == "f3", "id_f3").otherwise(p)
    locates, used = locates.withColumn("results", F.transform("results", named)), used.withColumn("path", named(F.col("path")))
    cases = export.export_cases(sessions.outcomes(locates, used), used, spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path")))
    return cases.select("locate_id", F.size("results").alias("n_results"), F.explode_outer("consumes").alias("c")).select("locate_id", "n_results", "c.seq", "c.kind", "c.path", "c.locate_rank")


def stream_session_counts(spark, sf_dir):
    from larkfield.streaming.sessions import session_counts

    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return session_counts(raw.select("ts", "user_id"))


def stateful_attribution(spark, sf_dir):
    """Attribution and latencies by the stateful stream: all files of ``events``, until none is left."""
    from larkfield.streaming import correlator, event_log

    folder = f"{shared_folder(spark)}/larkfield-{spark.sparkContext.applicationId}/correlator-{uuid.uuid4().hex}"
    with correlator.state_store(spark):
        out = correlator.correlate(event_log.calls(event_log.file_stream(spark, f"{sf_dir}/events.parquet")), own_turns=True)
        writer = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(out.schema).parquet(f"{folder}/rows").where("kind <> 'locate'")
    return rows.select(F.col("session_id").cast("long").alias("session_id"), "seq", "path", "locate_rank", "cluster_kind", "latency_ms", "locate_id")


#: Deliveries of the log end at these times; what comes again or late is chosen by the id.
CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")


def deduplicated_events(spark, sf_dir):
    """The log in three deliveries with repeats within and across them and late rows: each event once, late ones apart."""
    from larkfield.streaming import dedup

    folder = f"{shared_folder(spark)}/larkfield-{spark.sparkContext.applicationId}/deliveries-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    first, second = (F.lit(c).cast("timestamp") for c in CUTS)
    old, near = F.col("ts") < first, (F.col("ts") >= first - F.expr("interval 12 hours")) & (F.col("ts") < first)
    deliveries = [
        rows.where(old).unionByName(rows.where(old & (F.col("event_id") % 5 == 0))),
        rows.where((F.col("ts") >= first) & (F.col("ts") < second)).unionByName(rows.where(near)),
        rows.where(F.col("ts") >= second).unionByName(rows.where(old & (F.col("event_id") % 7 == 0))),
    ]
    for delivery in deliveries:
        delivery.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        dedup.split(stream, f"{folder}/out", f"{folder}/c1").awaitTermination()
        dedup.once(spark, f"{folder}/out", ["event_id"], f"{folder}/c2").awaitTermination()
    made = spark.read.schema(rows.schema).parquet(f"{folder}/out/rows").withColumn("late", F.lit(False))
    late = spark.read.parquet(f"{folder}/out/late").select(*rows.columns).withColumn("late", F.lit(True))
    return made.unionByName(late).groupBy("event_id", "event_type", "late").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    next_event_window, asof_latest_match, interval_attribution, outcome_precedence, mrr_hit_at_k, precision_by_class, median_turns,
    session_vs_lifetime, count_by_reason_map, pivot_actions, guard_counts, session_bypass, slice_staleness, unchanged_lag, retention_prune,
    orphan_antijoin, ensure_session, tool_latency, verdict_join, priority_sort_limit, stream_session_counts,
    stateful_attribution, deduplicated_events, case_consumes,
)}

SQL = {
    "next_event_window": PRELUDE + "SELECT locate_id, session_id, seq, next_seq FROM l",
    "asof_latest_match": PRELUDE + "SELECT session_id, seq, path, locate_rank, cluster_kind FROM r",
    "interval_attribution": PRELUDE + "SELECT locate_id, session_id, seq, kind, path FROM w",
    "outcome_precedence": PRELUDE + """SELECT locate_id, outcome, CASE WHEN outcome = 'hit' THEN hit_rank END AS hit_rank, turns_to_useful, searches,
        justified_fallback FROM oo""",
    "mrr_hit_at_k": PRELUDE + """SELECT count(*) AS n_locates, count(*) FILTER (outcome = 'hit') AS n_hit,
        round(coalesce(avg(1.0 / hit_rank) FILTER (outcome = 'hit'), 0), 6) AS mrr,
        round(avg(CASE WHEN outcome = 'hit' AND hit_rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1,
        round(avg(CASE WHEN outcome = 'hit' AND hit_rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_at_3,
        round(avg(CASE WHEN outcome = 'hit' AND hit_rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5,
        round(avg(CASE WHEN outcome = 'hit' THEN 1.0 ELSE 0 END), 6) AS hit_rate,
        round(avg(CASE WHEN outcome = 'cluster-assist' THEN 1.0 ELSE 0 END), 6) AS cluster_assist_rate,
        round(avg(CASE WHEN outcome = 'miss-fallback' THEN 1.0 ELSE 0 END), 6) AS miss_fallback_rate,
        round(avg(CASE WHEN outcome = 'abandoned' THEN 1.0 ELSE 0 END), 6) AS abandoned_rate FROM oo""",
    "precision_by_class": PRELUDE + """SELECT round(avg(CASE WHEN outcome = 'hit' THEN 1.0 ELSE 0 END) FILTER (confidence = 'high'), 6) AS precision_high,
        round(avg(CASE WHEN outcome = 'hit' THEN 1.0 ELSE 0 END) FILTER (confidence = 'low'), 6) AS precision_low,
        count(*) FILTER (outcome = 'miss-fallback' AND NOT justified_fallback) AS n_unjustified_fallback FROM oo""",
    "median_turns": PRELUDE + """SELECT CAST(coalesce(median(turns_to_useful), 0) AS DOUBLE) AS median_turns,
        CAST(coalesce(sum(searches) FILTER (outcome = 'miss-fallback'), 0) AS BIGINT) AS fallback_searches FROM oo""",
    "session_vs_lifetime": PRELUDE + """SELECT session_id, count(*) AS n_locates, count(*) FILTER (outcome = 'hit') AS n_hit,
        count(*) FILTER (outcome = 'abandoned') AS n_abandoned, round(coalesce(avg(1.0 / hit_rank) FILTER (outcome = 'hit'), 0), 6) AS mrr
        FROM oo GROUP BY GROUPING SETS ((session_id), ())""",
    "count_by_reason_map": PRELUDE + """SELECT string_agg(concat(reason, '=', n), ',' ORDER BY reason) AS by_reason FROM (
        SELECT CASE WHEN k < 20 THEN 'non_git' WHEN k < 50 THEN 'disabled' ELSE 'booting' END AS reason, count(*) AS n FROM ev
        WHERE event_type = 'error' GROUP BY 1)""",
    "pivot_actions": """SELECT user_id AS session_id, count(*) FILTER (event_type = 'signup') AS allow, count(*) FILTER (event_type = 'view') AS warn,
        count(*) FILTER (event_type = 'error') AS block FROM events GROUP BY 1""",
    "guard_counts": """SELECT count(*) FILTER (event_type = 'signup') AS allow, count(*) FILTER (event_type = 'view') AS warn,
        count(*) FILTER (event_type = 'error') AS block FROM events""",
    "session_bypass": PRELUDE + """SELECT count(*) AS sessions, count(*) FILTER (u) AS with_locate, round(1 - count(*) FILTER (u) / count(*), 6) AS bypass_rate,
        count(*) FILTER (t) AS with_tools, count(*) FILTER (NOT t) AS without_tools FROM (
        SELECT session_id, bool_or(event_type = 'view' AND k < 5) AS u, arg_max(k % 2 = 0, seq) AS t FROM ev GROUP BY 1)""",
    "slice_staleness": PRELUDE + """SELECT count(*) AS slices, round(avg(CASE WHEN seq % 3 <> 0 AND seq % 2 = 0 THEN 1.0 ELSE 0 END), 6) AS stale_rate,
        count(*) FILTER (seq % 5 = 0) AS unchanged_avoided FROM c WHERE kind = 'slice'""",
    "unchanged_lag": PRELUDE + """SELECT session_id, seq, path, hash, lag(hash) OVER (PARTITION BY session_id, path ORDER BY seq) = hash AS unchanged FROM (
        SELECT session_id, seq, concat('f', k % 4) AS path, k % 3 AS hash FROM ev WHERE event_type = 'click')""",
    "retention_prune": PRELUDE + f""", s AS (SELECT session_id FROM ev GROUP BY 1
        HAVING min(epoch_ms(ts)) + (session_id % 40) * 86400000 >= {NOW_MS} - 20 * 86400000)
        SELECT session_id, count(*) AS n, min(seq) AS first_seq FROM ev WHERE event_type = 'click' AND epoch_ms(ts) >= {NOW_MS} - 20 * 86400000
        AND session_id IN (SELECT session_id FROM s) GROUP BY 1""",
    "orphan_antijoin": PRELUDE + """SELECT session_id, count(*) AS n FROM ev WHERE session_id NOT IN (
        SELECT session_id FROM ev WHERE event_type = 'signup' AND k >= 70) GROUP BY 1""",
    "ensure_session": PRELUDE + """SELECT session_id, min(ts) AS started_at, arg_min(concat('r', k), ts) AS repo_root,
        bool_or(event_type = 'purchase') AS is_writer, bool_or(event_type = 'view') AS used_locate, arg_max(k % 2 = 0, ts) AS tools_selected
        FROM ev GROUP BY 1""",
    "tool_latency": PRELUDE + """SELECT e.event_id, epoch_us(e.ts) // 1000 - b.ts AS latency_ms FROM ev e LEFT JOIN (
        SELECT session_id, k, min(epoch_us(ts) // 1000) AS ts FROM ev WHERE event_type = 'view' GROUP BY 1, 2) b ON b.session_id = e.session_id AND b.k = e.k
        WHERE e.event_type = 'purchase'""",
    "stateful_attribution": PRELUDE + """, calls AS (SELECT session_id, seq, event_type, epoch_us(ts) // 1000 AS ms, lag(event_type) OVER call AS before,
        lag(epoch_us(ts) // 1000) OVER call AS began FROM ev WHERE event_type IN ('view', 'purchase') WINDOW call AS (PARTITION BY session_id, k ORDER BY seq))
        SELECT r.session_id, r.seq, r.path, r.locate_rank, r.cluster_kind, w.locate_id,
        CASE WHEN calls.event_type = 'purchase' AND before = 'view' AND ms - began <= 86400000 THEN ms - began END AS latency_ms
        FROM r LEFT JOIN calls ON calls.session_id = r.session_id AND calls.seq = r.seq LEFT JOIN w ON w.session_id = r.session_id AND w.seq = r.seq""",
    "case_consumes": PRELUDE + """, top AS (SELECT locate_id, CASE WHEN outcome = 'miss-fallback' AND NOT justified_fallback THEN 0
        WHEN outcome = 'cluster-assist' THEN 1 WHEN outcome = 'miss-fallback' THEN 2 WHEN outcome = 'abandoned' THEN 3
        WHEN confidence = 'low' THEN 4 ELSE 5 END AS priority FROM oo ORDER BY priority, locate_id LIMIT 50),
        n AS (SELECT locate_id, count(*) AS n FROM shown WHERE src = 0 AND path <> 'f3' GROUP BY 1),
        u AS (SELECT * FROM w WHERE path IS NULL OR path <> 'f3')
        SELECT top.locate_id, coalesce(n.n, 0) AS n_results, u.seq, u.kind, u.path, u.locate_rank FROM top LEFT JOIN n USING (locate_id) LEFT JOIN u USING (locate_id)""",
    "deduplicated_events": f"""SELECT event_id, event_type, false AS late, 1 AS n FROM events
        UNION ALL SELECT event_id, event_type, true, 1 FROM events WHERE ts < TIMESTAMP '{CUTS[0]}' AND event_id % 7 = 0
        AND ts <= (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '{CUTS[1]}') - INTERVAL 1 DAY""",
    "verdict_join": PRELUDE + """, fs AS (SELECT locate_id, min(seq) AS s FROM w WHERE kind = 'search' GROUP BY 1),
        miss AS (SELECT w.locate_id, arg_min(path, seq) AS target FROM w JOIN fs USING (locate_id) WHERE kind <> 'search' AND seq > s GROUP BY 1),
        help AS (SELECT w.locate_id, arg_min(w.path, w.seq) AS target FROM w JOIN l USING (locate_id) WHERE kind <> 'search'
            AND w.path IN (concat('f', (l.k + 3) % 20), concat('f', (l.k + 11) % 20)) GROUP BY 1),
        t AS (SELECT oo.locate_id, oo.k, CASE oo.outcome WHEN 'miss-fallback' THEN miss.target ELSE help.target END AS target
            FROM oo LEFT JOIN miss USING (locate_id) LEFT JOIN help USING (locate_id) WHERE oo.outcome IN ('miss-fallback', 'cluster-assist'))
        SELECT locate_id, target, CASE WHEN target IS NULL THEN 'not_indexed' WHEN target IN (concat('f', (k + 3) % 20), concat('f', (k + 11) % 20))
            THEN 'indexed' WHEN CAST(substr(target, 2) AS INT) < 15 THEN 'indexed_not_returned' ELSE 'not_indexed' END AS verdict FROM t""",
    "priority_sort_limit": PRELUDE + """SELECT locate_id, CASE WHEN outcome = 'miss-fallback' AND NOT justified_fallback THEN 0
        WHEN outcome = 'cluster-assist' THEN 1 WHEN outcome = 'miss-fallback' THEN 2 WHEN outcome = 'abandoned' THEN 3
        WHEN confidence = 'low' THEN 4 ELSE 5 END AS priority, outcome FROM oo ORDER BY priority, locate_id LIMIT 50""",
}
