"""Whole flows: build an index of a folder, answer queries from it, read a slice of a file, render results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.config import Config
from larkfield.operators import extract, graph, search
from larkfield.operators.snapshot import backlog, file_id
from larkfield.sources import files as file_source
from larkfield.sources import git


@dataclass(frozen=True)
class Index:
    files: DataFrame
    symbols: DataFrame
    text: DataFrame
    refs: DataFrame
    cochange: DataFrame


def build(spark: SparkSession, root: str, now: int, config: Config = Config(), commits: DataFrame | None = None, before: DataFrame | None = None) -> tuple[Index, DataFrame]:
    """The index of a checkout, and its change list against an earlier ``files`` table; empty outside git.

    References resolve by joins after all paths are known, so the order of files does not matter. Recency comes from
    the commits each time; files that are gone drop out with all that hung on them.
    """
    listed = git.list_files(spark, root)
    read = file_source.read_files(spark, root, config.max_file_bytes, listed).withColumn("file_id", file_id(F.col("path")))
    commits = git.read_log(spark, root, config.cochange_max_commits) if commits is None else commits
    seen = graph.recency(commits, now).withColumnRenamed("file", "path")
    rows = read.join(seen, "path", "left").withColumn("symbols_done", F.lit(True))
    changes = backlog(read, before) if before is not None else read.withColumn("change", F.lit("new"))
    parsed = extract.with_extracted(read)
    symbols = parsed.select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.*")
    imports = parsed.select("file_id", "path", F.explode("imports").alias("i")).select("file_id", "path", "i.*")
    refs = graph.resolve_references(imports, read.select("file_id", "path"))
    ids = read.select("path", "file_id")
    pairs = graph.cochange(commits, now, config.cochange_window_days, config.cochange_max_files_per_commit)
    a, b = ids.toDF("file_a", "__a"), ids.toDF("file_b", "__b")
    edges = pairs.join(a, "file_a").join(b, "file_b").select(F.col("__a").alias("file_a"), F.col("__b").alias("file_b"), "weight")
    edges = graph.normalise_edges(edges)
    table = rows.drop("text", "indexable")
    return Index(table, symbols, extract.index_rows(parsed, config.keyword_stoplist), refs, edges), changes


def locate(index: Index, queries: DataFrame, now: int, limit: int | None = None, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Ranked rows for each query, and the cluster of related files of each first result."""
    rows = search.locate(queries, index.files, index.symbols, index.text, now, limit or config.max_locate_results)
    anchors = rows.where("rank = 1").select("query_id", F.col("file_id").alias("file"))
    return rows, graph.cluster(anchors, index.cochange, index.refs, index.files.count())


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (1-based, bounds included, clamped to the text)."""
    lines = F.split(text, "\n")
    lo = F.greatest(F.lit(1), F.least(start, F.size(lines)))
    hi = F.greatest(lo, F.least(end, F.size(lines)))
    return F.array_join(F.slice(lines, lo, hi - lo + 1), "\n")


def slices(requests: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """requests(request_id, path, symbol, start_line, end_line) with start_line, end_line (0-based), body, stale.

    A named symbol is taken from the index; its first definition counts. Paths that lead out or name secrets give an
    error text, and so do missing files and symbols. ``stale`` tells that the file changed since it was indexed.
    """
    live = files.select("path", "text", "content_hash", "indexed_hash", "file_id")
    first = symbols.groupBy("file_id", F.col("name").alias("symbol")).agg(F.min_by(F.struct("start_line", "end_line"), F.struct("start_line", "end_line")).alias("span"))
    asked = requests.withColumn("path", F.regexp_replace("path", "^@", ""))
    rows = asked.join(live, "path", "left").join(first, ["file_id", "symbol"], "left")
    bad = F.exists(F.split("path", "/"), lambda s: s == "..") | F.col("path").startswith("/") | file_source.is_secret(F.col("path"))
    lo = F.coalesce(F.col("span.start_line") + 1, F.col("start_line"), F.lit(1))
    hi = F.coalesce(F.col("span.end_line") + 1, F.col("end_line"), F.size(F.split("text", "\n")))
    lost = F.col("symbol").isNotNull() & F.col("span").isNull()
    error = F.when(bad, "forbidden path").when(F.col("text").isNull(), "no such file").when(lost, "no such symbol")
    n = F.size(F.split("text", "\n"))
    start = F.greatest(F.lit(1), F.least(lo, n))
    return rows.select(
        "request_id", "path", F.when(error.isNull(), start - 1).alias("start_line"), F.when(error.isNull(), F.greatest(start, F.least(hi, n)) - 1).alias("end_line"),
        F.when(error.isNull(), slice_lines(F.col("text"), lo, hi)).alias("body"),
        (~F.col("content_hash").eqNullSafe(F.col("indexed_hash"))).alias("stale"), error.alias("error"),
    )


def render(rows: DataFrame, queries: DataFrame | None = None, cluster: DataFrame | None = None, paths: DataFrame | None = None, coverage: float = 1.0, behind: int = 0, dirty: bool = False, directive: bool = True) -> DataFrame:
    """(query_id, text) of ranked rows: results with their symbols, related files of the first, and notes on the index.

    ``queries`` also gives those without a result their text; ``cluster`` is what ``locate`` returns beside the rows and
    needs ``paths`` (file_id, path) for its names. ``directive`` adds what to do after an exact hit.
    """
    names = F.array_join(F.transform("symbols", lambda s: s["name"]), ", ") if "symbols" in rows.columns else F.lit(None).cast("string")
    line = F.format_string("%d. %s (%.2f, %s)", "rank", "path", "score", F.coalesce("lang", F.lit("?")))
    line = F.concat(line, F.when(F.length(names) > 0, F.concat(F.lit("\n   symbols: "), names)).otherwise(""))
    flags = [F.first(c).alias(c) for c in ("confidence", "has_exact_def", "top_has_anchor") if c in rows.columns]
    out = rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"), *flags)
    if queries is not None:
        out = queries.select("query_id").join(out, "query_id", "left")
    parts = [F.coalesce("text", F.lit("no result: the index may not cover this, search the files themselves"))]
    if cluster is not None and paths is not None:
        named = paths.select("file_id", F.col("path").alias("__path"))
        for kind, label in (("cochange", "changes with"), ("referrers", "referred to by")):
            each = cluster.select("query_id", F.posexplode(kind).alias("at", "file_id")).join(named, "file_id")
            listed = each.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "__path"))), lambda x: x["__path"]), ", ").alias(kind))
            out = out.join(listed, "query_id", "left")
            parts.append(F.when(F.length(kind) > 0, F.concat(F.lit(f"{label}: "), F.col(kind))))
    notes = [(dirty, "uncommitted edits: ranking may lag behind the files"), (coverage < 1, f"{round(coverage * 100)}% of the files are indexed so far"), (behind > 0, f"{behind} commit(s) behind HEAD")]
    parts += [F.lit(note) for holds, note in notes if holds]
    parts.append(F.when(F.col("confidence") == "low", "low confidence: verify before use"))
    if directive and {"has_exact_def", "top_has_anchor"} <= set(rows.columns):
        parts.append(F.when(F.col("has_exact_def") & F.col("top_has_anchor"), "exact hit: read the first result, no further search is needed"))
    return out.select("query_id", F.concat_ws("\n", *parts).alias("text"))


def render_stats(metrics: DataFrame) -> DataFrame:
    """One line for a row of metrics: percentages without places, MRR to three."""
    return metrics.select(F.format_string(
        "locates %d, hit %.0f%%, assist %.0f%%, fallback %.0f%%, abandoned %.0f%%, mrr %.3f", "n_locates", F.col("hit_rate") * 100,
        F.col("cluster_assist_rate") * 100, F.col("miss_fallback_rate") * 100, F.col("abandoned_rate") * 100, "mrr",
    ).alias("text"))


def render_summary(outcomes: DataFrame, sessions: DataFrame, slices: DataFrame, guards: DataFrame, reasons: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """The text of all statistics, from the one-row frames of ``operators.metrics``: outcome_metrics, session_metrics,
    slice_metrics, guard_counts, reasons and, for the state of an index, coverage."""
    percent = lambda c: F.col(c) * 100
    listed = F.array_join(F.transform(F.map_entries(F.coalesce("by_reason", F.create_map().cast("map<string,bigint>"))), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))), ", ")
    rows = outcomes.select(F.format_string(
        "searches %d: hit %.0f%%, cluster assist %.0f%%, fallback %.0f%%, abandoned %.0f%%\nranking: mrr %.3f, hit@1 %.0f%%, hit@3 %.0f%%, hit@5 %.0f%%\n"
        "precision: high %.0f%%, low %.0f%%\nturns to a useful file (median) %.1f, fallback searches %d, unjustified %d",
        "n_locates", percent("hit_rate"), percent("cluster_assist_rate"), percent("miss_fallback_rate"), percent("abandoned_rate"), "mrr", percent("hit_at_1"), percent("hit_at_3"),
        percent("hit_at_5"), percent("precision_high"), percent("precision_low"), "median_turns", "fallback_searches", "n_unjustified_fallback",
    ).alias("a"))
    parts = [
        sessions.select(F.format_string("sessions %d, %d with a search, bypassed %.0f%%; tools selected in %d, not in %d", "sessions", "with_locate", percent("bypass_rate"), "with_tools", "without_tools").alias("b")),
        slices.select(F.format_string("slices %d, stale %.0f%%, reads of unchanged text avoided %d", "slices", percent("stale_rate"), "unchanged_avoided").alias("c")),
        guards.select(F.format_string("scans: allowed %d, warned %d, blocked %d", "allow", "warn", "block").alias("d")),
        reasons.select(F.concat(F.lit("unavailable: "), F.when(listed == "", "never").otherwise(listed)).alias("e")),
    ]
    if coverage is not None:
        parts.append(coverage.select(F.format_string("index: %d of %d files (%.0f%%)", "indexed", "total", percent("ratio")).alias("f")))
    for part in parts:  # each has one row
        rows = rows.crossJoin(F.broadcast(part))
    return rows.select(F.concat_ws("\n", *rows.columns).alias("text"))
