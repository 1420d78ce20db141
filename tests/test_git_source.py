"""The log as a data source against the log read in one piece."""

import subprocess

import pytest

from larkfield.sources import git, git_source


@pytest.fixture
def checkout(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    run(root, "init", "-q")
    return root


def run(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b", "-c", "user.name=n", *args], check=True, capture_output=True)


def commit(root, n, *names):
    for name in names:
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(f"{n}\n")
    run(root, "add", "-A")
    run(root, "commit", "-qm", f"c{n}", "--allow-empty")


def rows(df):
    found = [(r.sha, r.ts, tuple(r.files)) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_batches_and_streams_give_the_rows_of_the_log(spark, checkout, tmp_path):
    git_source.register(spark)
    root = str(checkout)
    read = lambda **o: spark.read.format("git_log").option("root", root).options(**o).load()
    assert read().count() == 0  # no commit yet
    for n in range(5):
        commit(checkout, n, "a.py", f"lib/b {n % 2}.rb", "ü.md")
    run(checkout, "checkout", "-qb", "side", "HEAD~2")
    commit(checkout, 9, "side.py")
    commit(checkout, 10)
    run(checkout, "checkout", "-q", "-")
    run(checkout, "merge", "-q", "--no-ff", "-m", "merge", "side")
    whole = rows(git.read_log(spark, root))
    assert len(whole) == 7 and rows(read(per_partition=2)) == whole == rows(read())
    assert read(per_partition=2).rdd.getNumPartitions() == 4
    assert rows(read(max_commits=3)) == rows(git.read_log(spark, root, 3))
    first = next(sha for sha, _, files in whole if len(files) == 3 and git.commits_between(root, sha) > 6)
    assert rows(read(since=first)) == rows(git.read_log(spark, root, since=first))
    assert read(since="0" * 40).count() == 0 and spark.read.format("git_log").option("root", str(tmp_path)).load().count() == 0

    def take():
        """All commits so far through the stream, in a folder that keeps what earlier runs gave."""
        stream = spark.readStream.format("git_log").option("root", root).option("per_partition", 3).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.schema(git.COMMITS).parquet(f"{tmp_path}/out"))

    assert take() == whole
    assert take() == whole
    commit(checkout, 11, "c.py")
    assert take() == rows(git.read_log(spark, root)) and len(take()) == 8
