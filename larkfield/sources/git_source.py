"""The commit log as a data source: ``spark.read.format("git_log")`` in partitions of commits, and as a stream.

    git_source.register(spark)
    spark.read.format("git_log").option("root", path).load()
    spark.readStream.format("git_log").option("root", path).load()

Rows are (sha, ts, files) as ``git.read_log`` gives them, without merges. Options: ``root``, a checkout that driver and
executors reach by that path; ``since``, a commit after which the log begins; ``max_commits`` (batch: the newest so many);
``per_partition``. The driver lists the names of commits only; each task asks git for those of its partition. Offsets of a
stream are commits: a batch holds what HEAD has and the last offset had not, so after a rewritten history it holds the new
commits that are not among the ancestors of the old one. Where git fails (no repository, no commit, no such ``since``) there
are no rows.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from larkfield.sources.git import COMMITS, HEADER, MAX_COMMITS

PER_PARTITION = 1_000


def _git(root: str, *args: str) -> list[str]:
    """Lines of git's answer; none if it fails."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=600)
    except (OSError, subprocess.TimeoutExpired):
        return []
    return done.stdout.decode(errors="replace").split("\n") if done.returncode == 0 else []


def commit_names(root: str, span: str, most: int | None = None) -> list[str]:
    limit = [f"-n{most}"] if most is not None else []
    return [x for x in _git(root, "rev-list", "--no-merges", *limit, span) if x]


@dataclass
class Commits(InputPartition):
    names: tuple[str, ...]


def parts(names: list[str], size: int) -> list[Commits]:
    return [Commits(tuple(names[i : i + size])) for i in range(0, len(names), size)]


def read_commits(root: str, names: tuple[str, ...]) -> Iterator[tuple[str, int, list[str]]]:
    """The named commits with their times and files; an error, if git fails now, as the driver has listed them."""
    asked = ["git", "-C", root, "log", "--no-walk=unsorted", "--stdin", "--name-only", f"--pretty=format:{HEADER} %H %ct"]
    done = subprocess.run(asked, input="\n".join(names).encode(), capture_output=True, timeout=600, check=True)
    row = None
    for line in done.stdout.decode(errors="replace").split("\n"):
        words = line.strip().split(" ")
        if words[0] == HEADER and len(words) == 3:
            if row:
                yield row
            row = (words[1], int(words[2]), [])
        elif row and line.strip():
            row[2].append(line.strip())
    if row:
        yield row


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return COMMITS

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options)


class BatchReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.since = options["root"], options.get("since")
        self.most, self.size = int(options.get("max_commits", MAX_COMMITS)), int(options.get("per_partition", PER_PARTITION))

    def partitions(self) -> list[Commits]:
        span = f"{self.since}..HEAD" if self.since else "HEAD"
        return parts(commit_names(self.root, span, self.most), self.size) or [Commits(())]

    def read(self, partition: Commits) -> Iterator[tuple]:
        return read_commits(self.root, partition.names) if partition.names else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.since, self.size = options["root"], options.get("since") or "", int(options.get("per_partition", PER_PARTITION))

    def initialOffset(self) -> dict:
        return {"sha": self.since}

    def latestOffset(self) -> dict:
        head = _git(self.root, "rev-parse", "HEAD")
        return {"sha": head[0] if head else self.since}

    def partitions(self, start: dict, end: dict) -> list[Commits]:
        if not end["sha"] or start["sha"] == end["sha"]:
            return []
        span = f"{start['sha']}..{end['sha']}" if start["sha"] else end["sha"]
        return parts(commit_names(self.root, span), self.size)

    def read(self, partition: Commits) -> Iterator[tuple]:
        return read_commits(self.root, partition.names)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLog)
