"""The telemetry store: tables of sessions and events that are opened, migrated, added to and pruned."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.operators.sessions import retain
from larkfield.operators.snapshot import SnapshotTable

VERSION, RETENTION_DAYS = 3, 30
LOG = logging.getLogger("larkfield.telemetry")
#: The tables and their columns. What a search showed is kept as JSON.
TABLES = {
    "sessions": "session_id string, started_at long, repo_root string, head_sha string, is_writer boolean, used_locate boolean, tools_selected boolean",
    "locates": (
        "locate_id long, session_id string, seq long, turn long, ts long, head_sha string, query string, query_token_count int, query_type string, limit_n int, "
        "result_count int, confidence string, has_exact_def boolean, used_or_fallback boolean, top_has_anchor boolean, coverage double, dirty boolean, "
        "head_behind long, fresh boolean, latency_ms long, results_metadata string, cochange string, referrers string"
    ),
    "consumes": (
        "session_id string, seq long, turn long, ts long, kind string, path string, locate_rank int, stale_index boolean, unchanged boolean, search_tool string, "
        "search_pattern string, latency_ms long, is_error boolean, cluster_kind string"
    ),
    "unavailable": "session_id string, seq long, ts long, turn long, tool string, reason string",
    "guards": "session_id string, seq long, ts long, turn long, command string, action string, pattern_kind string, rg_available boolean",
}


def widened(name: str) -> Callable[[DataFrame], DataFrame]:
    """Brings rows of an earlier version to the columns of a table; new ones are null."""

    def migrate(df: DataFrame) -> DataFrame:
        schema = df.sparkSession.createDataFrame([], TABLES[name]).schema
        return df.select(*[(F.col(c.name) if c.name in df.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in schema])

    return migrate


#: Guard rows of the first version lack the kind of pattern; searches and uses of the second have fewer columns.
MIGRATIONS: dict[str, Mapping[int, Callable[[DataFrame], DataFrame]]] = {name: {1: widened(name), 2: widened(name)} for name in TABLES}


class TelemetryStore:
    """All tables below ``root``; opening drops what is older than ``days`` at ``now_ms`` and what hung on it."""

    def __init__(self, spark: SparkSession, root: str, now_ms: int | None = None, days: int = RETENTION_DAYS, version: int = VERSION):
        self.spark = spark
        self.tables = {name: SnapshotTable(spark, f"{root.rstrip('/')}/{name}", version, MIGRATIONS[name]) for name in TABLES}
        if now_ms is not None:
            self.prune(now_ms, days)

    def read(self, name: str) -> DataFrame:
        found = self.tables[name].read()
        return self.spark.createDataFrame([], TABLES[name]) if found is None else found

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; columns that a table does not have are dropped, missing ones are null, arrays become JSON."""
        columns = self.spark.createDataFrame([], TABLES[name]).schema
        nested = {f.name for f in rows.schema if f.dataType.typeName() in ("array", "struct", "map")}

        def value(c):
            if c.name not in rows.columns:
                return F.lit(None)
            return F.to_json(F.col(f"`{c.name}`")) if c.name in nested else F.col(f"`{c.name}`")

        made = rows.select(*[value(c).cast(c.dataType).alias(c.name) for c in columns])
        self.tables[name].write(self.read(name).select(*columns.names).unionByName(made))

    def prune(self, now_ms: int, days: int = RETENTION_DAYS) -> None:
        kept = retain({name: self.read(name) for name in TABLES}, now_ms, days)
        for name, table in self.tables.items():
            if table.meta():
                table.write(kept[name])


def open_store(spark: SparkSession, root: str, now_ms: int, days: int = RETENTION_DAYS) -> TelemetryStore | None:
    """The store, migrated and pruned; None, with a line in the log, if it cannot be opened: telemetry must not stop the work."""
    try:
        return TelemetryStore(spark, root, now_ms, days)
    except Exception:
        LOG.exception("the telemetry store at %s cannot be opened", root)
        return None


def guard_rows(commands: DataFrame, directories: list[str], active: bool = True) -> DataFrame:
    """Guard rows for commands(session_id, seq, ts, turn, command, rg_available): those that scan a tree."""
    from larkfield.functions.classify import guard_action, with_grep_class

    rows = with_grep_class(commands, directories).where("grep.scans")
    action = guard_action(F.col("grep.scans"), F.lit(active), F.col("rg_available"))
    return rows.select("session_id", "seq", "ts", "turn", "command", action.alias("action"), F.col("grep.kind").alias("pattern_kind"), "rg_available")
