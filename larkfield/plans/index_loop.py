"""The index of a checkout, kept between runs: each pass parses what changed and adds the commits that are new.

Below the store every pass has partitions of its own, written by Spark and never changed afterwards:

    parsed/pass=N    one row for each file that was new, changed, unfinished or gone, with all that was parsed from it
    weights/pass=N   co-change of the pass's commits as it stood then
    commits/pass=N   the commits themselves, for recency and for those dated in the future
    passes/pass=N    the commit up to which history is taken, and whether it was taken anew; written last

A pass counts once its row in ``passes`` is there: one that failed is overwritten by the next. The state of a file is its
row of the last pass; weights of earlier passes decay by one factor each. Files are told to be unchanged by size and time,
and are not opened; if HEAD no longer descends from the last commit taken, history is taken anew. Reference edges are
resolved by joins over all imports when the index is read, since a new path can change what an old import names.
``compact`` writes one pass that holds what all of them say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.config import Config
from larkfield.operators import extract, graph
from larkfield.operators.snapshot import backlog, deleted, file_id
from larkfield.plans.locate import Index
from larkfield.sources import files as file_source
from larkfield.sources import git

PARSED = (
    "path string, file_id long, lang string, size long, mtime long, content_hash string, symbols_done boolean, symbols " + extract.SYMBOLS.simpleString() + ", imports " + extract.IMPORTS.simpleString()
    + ", symbol_names string, keywords string, content string, gone boolean, pass long"
)
WEIGHTS = "file_a string, file_b string, weight double, asof long, pass long"
COMMITS = git.COMMITS + ", asof long, pass long"
PASSES = "head string, now long, anew boolean, whole boolean, n_read long, n_gone long, n_commits long, pass long"
TABLES = {"parsed": PARSED, "weights": WEIGHTS, "commits": COMMITS, "passes": PASSES}


class KeptIndex:
    def __init__(self, spark: SparkSession, store: str, config: Config = Config()):
        self.spark, self.store, self.config = spark, store.rstrip("/"), config
        for name, schema in TABLES.items():  # without rows there are no files: what is there stays
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy("pass").parquet(f"{self.store}/{name}")

    # ---- what is kept ------------------------------------------------------------------------------

    def _passes(self) -> list:
        """All passes that count, in order: one narrow row each."""
        return sorted(self.spark.read.schema(PASSES).parquet(f"{self.store}/passes").collect(), key=lambda r: r["pass"])

    def _table(self, name: str, passes: list, since: str) -> DataFrame:
        """Rows of the passes that count, from the last one on that has the flag ``since``."""
        first = max([r["pass"] for r in passes if r[since]], default=0)
        last = passes[-1]["pass"] if passes else -1
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.store}/{name}").where(F.col("pass").between(first, last))

    def _parsed(self, passes: list) -> DataFrame:
        """The last row of each file that is still there."""
        rows = self._table("parsed", passes, "whole")
        # The newest pass of a path is found among narrow columns; its row is joined, so that parsed arrays are not grouped.
        newest = rows.groupBy("path").agg(F.max("pass").alias("pass"))
        return rows.join(newest, ["path", "pass"], "left_semi").where(~F.col("gone"))

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        df.select(*[c for c in self.spark.createDataFrame([], TABLES[name]).columns if c != "pass"]).write.mode("overwrite").parquet(f"{self.store}/{name}/pass={number}")

    # ---- passes ------------------------------------------------------------------------------------

    def update(self, root: str, now: int) -> dict[str, int]:
        """One pass over a checkout; gives how many files were read, gone and how many commits were added."""
        passes = self._passes()
        number, head = (passes[-1]["pass"] + 1 if passes else 0), passes[-1]["head"] if passes else None
        disk = file_source.list_tree(self.spark, root, git.list_files(self.spark, root)).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))
        known = self._parsed(passes).select("path", "size", "mtime", "symbols_done")
        work = backlog(disk, known).where("change <> 'unchanged'").select("path")
        read = file_source.read_files(self.spark, root, self.config.max_file_bytes, work).withColumn("file_id", file_id(F.col("path")))
        rows = extract.with_extracted(read).withColumns(extract.index_columns(self.config.keyword_stoplist)).withColumns({"symbols_done": F.lit(True), "gone": F.lit(False)})
        left = deleted(disk, known).select("path", file_id(F.col("path")).alias("file_id"), F.lit(True).alias("gone"))
        self._write(rows.unionByName(left, allowMissingColumns=True), "parsed", number)

        anew = not git.descends(root, head)
        taken = self._table("commits", passes, "anew").select("sha") if not anew else None
        to = git.head_sha(root)
        commits = git.read_log(self.spark, root, self.config.cochange_max_commits, None if anew else head)
        self._fold(commits if taken is None else commits.join(taken, "sha", "left_anti"), now, number)

        done = self.spark.read.schema(PARSED).parquet(f"{self.store}/parsed").where(F.col("pass") == number)
        counts = done.agg(F.count_if(~F.col("gone")).alias("n_read"), F.count_if("gone").alias("n_gone")).first()
        n_commits = self.spark.read.schema(COMMITS).parquet(f"{self.store}/commits").where(F.col("pass") == number).count()
        self._finish(number, to, now, anew, number == 0, counts.n_read, counts.n_gone, n_commits)
        return {"pass": number, "read": counts.n_read, "gone": counts.n_gone, "commits": n_commits}

    def add_commits(self, commits: DataFrame, now: int) -> None:
        """A pass that only adds commits(sha, ts, files), for histories that do not come from a checkout."""
        passes = self._passes()
        number = passes[-1]["pass"] + 1 if passes else 0
        self._write(self.spark.createDataFrame([], PARSED), "parsed", number)
        self._fold(commits, now, number)
        self._finish(number, None, now, number == 0, number == 0, 0, 0, 0)

    def _fold(self, commits: DataFrame, now: int, number: int) -> None:
        self._write(commits.withColumn("asof", F.lit(now).cast("long")), "commits", number)
        stored = self.spark.read.schema(COMMITS).parquet(f"{self.store}/commits").where(F.col("pass") == number)
        # A pair of a commit is a row to add up; of commits as they are, a task for so many files.
        parts = max(graph.tasks(stored), -(-(stored.agg(F.sum(F.size("files"))).first()[0] or 0) // graph.TASK_ROWS))
        self._write(graph.cochange_part(stored, now, self.config.cochange_window_days, self.config.cochange_max_files_per_commit, parts), "weights", number)

    def _finish(self, number: int, *values) -> None:
        self._write(self.spark.createDataFrame([(*values, number)], PASSES).coalesce(1), "passes", number)

    def compact(self) -> None:
        """One pass with the rows of all of them, so that reading does not slow down; older ones are then passed over."""
        passes = self._passes()
        number, last = passes[-1]["pass"] + 1, passes[-1]
        self._write(self._parsed(passes), "parsed", number)
        commits = self._table("commits", passes, "anew")
        weights = graph.cochange_at(self._table("weights", passes, "anew"), last["now"], self.config.cochange_window_days)
        folded = graph.not_yet(commits, F.col("asof")).where(F.col("ts") <= last["now"])
        late = graph.cochange_part(folded, last["now"], self.config.cochange_window_days, self.config.cochange_max_files_per_commit)
        total = weights.unionByName(late.drop("asof")).groupBy("file_a", "file_b").agg(F.sum("weight").alias("weight"))
        self._write(total.withColumn("asof", F.lit(last["now"]).cast("long")), "weights", number)
        self._write(commits.withColumn("asof", F.lit(last["now"]).cast("long")), "commits", number)
        self._finish(number, last["head"], last["now"], True, True, 0, 0, 0)

    # ---- reading -----------------------------------------------------------------------------------

    def commits(self) -> DataFrame:
        return self._table("commits", self._passes(), "anew").select("sha", "ts", "files")

    def cochange(self, now: int) -> DataFrame:
        """(file_a, file_b, weight) by path, at ``now``."""
        passes = self._passes()
        waiting = graph.not_yet(self._table("commits", passes, "anew"), F.col("asof"))
        return graph.cochange_at(self._table("weights", passes, "anew"), now, self.config.cochange_window_days, waiting, self.config.cochange_max_files_per_commit)

    def recency(self, now: int) -> DataFrame:
        """``graph.recency``; a commit's own files are counted, so only narrow rows are read."""
        return graph.recency(self.commits(), now)

    def read(self, now: int) -> Index:
        """The index as ``locate.build`` gives it for the state of the last pass."""
        parsed = self._parsed(self._passes())
        seen = self.recency(now).withColumnRenamed("file", "path")
        files = parsed.select("path", "lang", "size", "mtime", "content_hash", "file_id", "symbols_done").join(seen, "path", "left")
        symbols = parsed.select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.*")
        imports = parsed.select("file_id", "path", F.explode("imports").alias("i")).select("file_id", "path", "i.*")
        ids = parsed.select("path", "file_id")
        a, b = ids.toDF("file_a", "__a"), ids.toDF("file_b", "__b")
        edges = self.cochange(now).join(a, "file_a").join(b, "file_b").select(F.col("__a").alias("file_a"), F.col("__b").alias("file_b"), "weight")
        text = parsed.where("lang is not null").select("file_id", "path", "symbol_names", "keywords", "content")
        return Index(files, symbols, text, graph.resolve_references(imports, ids), graph.normalise_edges(edges))
