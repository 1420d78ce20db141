"""Tool events to telemetry rows: searches asked, files used, calls that could not be served.

events(session_id, ts, turn, tool, args map<string,string>, details string, content string, is_error boolean, root
string, cwd string): ``details`` is the JSON result of a served call, ``content`` its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkfield.functions.classify import query_type, unavailable_reason, with_searches
from larkfield.functions.text import white_space_tokens
from larkfield.operators.graph import normal_path

LOCATE, SLICE, READ, SHELL = "locate", "slice", "read", "bash"
SEARCH_TOOLS = ("grep", "find", "ls")
RESULT = (
    "results array<struct<path:string,score:double,signals:struct<fts:double,path:double,symbol:double,recency:double>>>,"
    "cluster struct<anchor:string,cochange:array<string>,referrers:array<string>>,confidence string,has_exact_def boolean,"
    "used_or_fallback boolean,top_has_anchor boolean,index struct<coverage:double,dirty:boolean,head_behind:bigint,fresh:boolean>,"
    "path string,stale_index boolean,unchanged_since_last_read boolean"
)


def inside(root: Column, path: Column, cwd: Column) -> Column:
    """The path below ``root``; null if it leads out or names the root itself."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.coalesce(cwd, root), path))
    clean, base = F.concat(F.lit("/"), normal_path(full)), F.regexp_replace(root, "/+$", "")
    return F.when(clean.startswith(F.concat(base, F.lit("/"))), F.substr(clean, F.length(base) + 2))


def dispatch(events: DataFrame) -> dict[str, DataFrame]:
    """locates, consumes and unavailable, with a seq that only events that give a row use up.

    A served locate gives a locate row, an unserved locate or slice an unavailable row. Reads that lead out of the
    root, shell commands that do not search and unknown tools give none.
    """
    rows = with_searches(events.withColumn("__command", F.when(F.col("tool") == SHELL, F.col("args")["command"])), "__command")
    rows = rows.withColumn("d", F.from_json("details", RESULT))
    served = F.col("details").isNotNull()
    raw = F.when(F.col("tool") == READ, F.coalesce(F.col("args")["path"], F.col("args")["file_path"])).when(F.col("tool") == SLICE, F.col("d.path"))
    rows = rows.withColumn("path", inside(F.col("root"), raw, F.col("cwd")))
    kind = (
        F.when((F.col("tool") == LOCATE) & served, "locate").when(F.col("tool").isin(LOCATE, SLICE) & ~served, "unavailable")
        .when(F.col("tool") == SLICE, "slice").when((F.col("tool") == READ) & F.col("path").isNotNull(), "read")
        .when((F.col("tool") == SHELL) & F.col("search").isNotNull(), "search").when(F.col("tool").isin(*SEARCH_TOOLS), "search")
    )
    rows = rows.withColumn("kind", kind).where("kind is not null")
    rows = rows.withColumn("seq", F.row_number().over(W.partitionBy("session_id").orderBy("ts", "turn")))
    query = F.coalesce(F.col("args")["query"], F.lit(""))
    paths = F.coalesce(F.transform("d.results", lambda r: r["path"]), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    locates = rows.where("kind = 'locate'").select(
        F.xxhash64("session_id", "seq").alias("locate_id"), "session_id", "seq", "turn", "ts", query.alias("query"), query_type(query).alias("query_type"),
        F.size(white_space_tokens(query)).alias("query_token_count"), F.coalesce(F.col("args")["limit"].try_cast("int"), F.size(paths)).alias("limit_n"),
        F.size(paths).alias("result_count"), F.coalesce("d.confidence", F.lit("low")).alias("confidence"),
        *[F.coalesce(f"d.{c}", F.lit(False)).alias(c) for c in ("has_exact_def", "used_or_fallback", "top_has_anchor")],
        F.coalesce("d.index.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("d.index.dirty", F.lit(False)).alias("dirty"),
        F.coalesce("d.index.head_behind", F.lit(0)).alias("head_behind"), F.coalesce("d.index.fresh", F.lit(False)).alias("fresh"),
        paths.alias("results"), F.coalesce("d.cluster.cochange", none).alias("cochange"), F.coalesce("d.cluster.referrers", none).alias("referrers"),
        F.to_json("d.results").alias("results_metadata"),
    )
    asked = F.col("kind") == "search"
    shell = F.col("tool") == SHELL
    consumes = rows.where("kind in ('slice', 'read', 'search')").select(
        "session_id", "seq", "turn", "ts", "kind", F.when(~asked, F.col("path")).alias("path"), F.col("d.stale_index").alias("stale_index"),
        F.col("d.unchanged_since_last_read").alias("unchanged"), F.when(asked, F.when(shell, F.col("search.tool")).otherwise(F.col("tool"))).alias("search_tool"),
        F.when(asked, F.when(shell, F.col("search.pattern")).otherwise(F.coalesce(F.col("args")["pattern"], F.col("args")["query"]))).alias("search_pattern"), "is_error",
    )
    reason = unavailable_reason(F.coalesce("content", F.lit("")))
    unavailable = rows.where("kind = 'unavailable'").select("session_id", "seq", "turn", "ts", "tool", reason.alias("reason"))
    return {"locates": locates, "consumes": consumes, "unavailable": unavailable}


def append(tables: dict[str, DataFrame], root: str) -> None:
    """Appends the rows to Parquet tables below ``root``."""
    for name, rows in tables.items():
        rows.write.mode("append").parquet(f"{root}/{name}")


def write_cases(cases: DataFrame, path: str) -> None:
    """Cases as JSON, one a line."""
    cases.write.mode("overwrite").json(path)
