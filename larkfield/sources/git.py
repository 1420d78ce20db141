"""Git as a source: tracked files, the commit log, and the identity and state of a repository."""

from __future__ import annotations

import hashlib
import os
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkfield.sources.files import has_ignored_segment, is_secret, language

HEADER = "__C__"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Modes of entries that are no files: symbolic links and submodules.
NO_FILES = ("120000", "160000")
MAX_COMMITS = 4_000
COMMITS = "sha string, ts long, files array<string>"


def _git(root: str, *args: str) -> bytes | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=120)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def _line(root: str, *args: str) -> str | None:
    out = _git(root, *args)
    return None if out is None else out.decode(errors="replace").strip()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, lang) of tracked and of untracked, not ignored files; empty outside a repository."""
    tracked = _git(root, "ls-files", "-s", "-z")
    loose = _git(root, "ls-files", "--others", "--exclude-standard", "-z")
    rows = []
    for record in (tracked or b"").decode(errors="surrogateescape").split("\0"):
        head, tab, path = record.partition("\t")
        if tab and head.split(" ")[0] not in NO_FILES:
            rows.append((path,))
    for path in (loose or b"").decode(errors="surrogateescape").split("\0"):
        if path and not os.path.islink(os.path.join(root, path)):
            rows.append((path,))
    listed = spark.createDataFrame(rows, "path string").distinct()
    return listed.where(~is_secret(F.col("path")) & ~has_ignored_segment(F.col("path"))).select("path", language(F.col("path")).alias("lang"))


def parse_log(lines: DataFrame) -> DataFrame:
    """Commits of log lines(source, line_no, line): headers ``__C__ sha ts`` followed by paths.

    Lines are trimmed. A header has a number as its third word, signed or not, with or without a fraction; further words
    do not matter. A malformed header opens nothing, so its files go to the commit before; files before any header are
    dropped. Lines are numbered within their source (one log), which is what each task sorts.
    """
    lines = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    parts = F.split("line", " ")
    header, stamp = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)).try_cast("double")
    is_header = F.col("line").startswith(f"{HEADER} ")
    good = is_header & F.coalesce(F.get(parts, F.lit(2)).rlike(NUMBER) & stamp.isNotNull(), F.lit(False))
    opened = F.sum(good.cast("int")).over(W.partitionBy("source").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    rows = lines.where(F.trim("line") != "").select(
        "source", "line_no", opened.alias("no"), F.when(good, header).alias("sha"),
        F.when(good, stamp.cast("long")).alias("ts"), F.when(~is_header, F.col("line")).alias("file"),
    )
    files = F.transform(F.sort_array(F.collect_list(F.when(F.col("file").isNotNull(), F.struct("line_no", "file")))), lambda x: x["file"])
    return rows.where("no > 0").groupBy("source", "no").agg(F.max("sha").alias("sha"), F.max("ts").alias("ts"), files.alias("files")).select("sha", "ts", "files")


def read_log(spark: SparkSession, root: str, max_commits: int = MAX_COMMITS, since: str | None = None) -> DataFrame:
    """The newest commits without merges; empty on any error."""
    span = [f"{since}..HEAD"] if since else []
    out = _git(root, "log", "--no-merges", f"-n{max_commits}", "--name-only", f"--pretty=format:{HEADER} %H %ct", *span)
    lines = [(root, i, x) for i, x in enumerate((out or b"").decode(errors="replace").split("\n"))]
    return parse_log(spark.createDataFrame(lines, "source string, line_no long, line string"))


def descends(root: str, sha: str | None) -> bool:
    """Whether HEAD has ``sha`` among its ancestors; false once history was rewritten."""
    return bool(sha) and _git(root, "merge-base", "--is-ancestor", sha or "", "HEAD") is not None


def commits_between(root: str, sha: str | None) -> int:
    out = _line(root, "rev-list", "--count", f"{sha}..HEAD") if sha else None
    return int(out) if out and out.isdigit() else 0


def head_sha(root: str) -> str | None:
    return _line(root, "rev-parse", "HEAD") or None


def is_dirty(root: str) -> bool:
    """True for uncommitted or untracked files, and if it cannot be told."""
    out = _line(root, "status", "--porcelain")
    return out is None or out != ""


@dataclass(frozen=True)
class Repository:
    root: str
    name: str
    repo_id: str
    is_git: bool

    def index_path(self, folder: str) -> str:
        """Where the index of the repository lies; empty outside git."""
        return os.path.join(folder, f"{self.name}_{self.repo_id}") if self.is_git else ""


def resolve(cwd: str) -> Repository:
    """Identity from the first commit, so that all checkouts share it; from a hash of the place without commits."""
    root = _line(cwd, "rev-parse", "--show-toplevel")
    is_git, root = root is not None, root or cwd
    common = _line(cwd, "rev-parse", "--git-common-dir") if is_git else None
    first = (_line(cwd, "rev-list", "--max-parents=0", "HEAD") or "").split("\n")[-1].strip()
    basis = common or root
    repo_id = first[:12] if first else hashlib.sha256(basis.encode()).hexdigest()[:12]
    if common and _line(cwd, "rev-parse", "--is-bare-repository") == "true":
        name = os.path.basename(_line(cwd, "rev-parse", "--git-dir") or root)
    else:
        name = os.path.basename(os.path.dirname(os.path.join(root, common))) if common else os.path.basename(root)
    return Repository(root, name, repo_id, is_git)
