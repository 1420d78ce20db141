import json
import subprocess

import pytest

from larkfield.config import Config, load_config, merge_config
from larkfield.plans import locate
from larkfield.sources import files, git, traces


@pytest.fixture
def checkout(tmp_path):
    root = tmp_path / "repo"
    (root / "app").mkdir(parents=True)
    (root / "node_modules").mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "app/grid.rb").write_text("class Grid\n  def power_flow\n  end\nend\n")
    (root / "app/grid_sync.rb").write_text('require_relative "grid"\nclass GridSync\n  def run\n    Grid.new\n  end\nend\n')
    (root / "unrelated.rb").write_text("class Widget\nend\n")
    (root / "notes.md").write_text("# Design\nThe power flow of the grid.\n")
    (root / ".env.local").write_text("SECRET=1\n")
    (root / "node_modules/x.js").write_text("const x = 1;\n")
    (root / "blob.py").write_bytes(b"a\0b")
    run("add", "-A")
    run("commit", "-qm", "one")
    return root


def test_files_and_gates(spark, checkout):
    rows = {r.path: r for r in files.read_files(spark, str(checkout)).collect()}
    assert "app/grid.rb" in rows and ".env.local" not in rows and not any(p.startswith(("node_modules", ".git/")) for p in rows)
    assert rows["blob.py"].lang is None and rows["blob.py"].text is None and not rows["blob.py"].indexable
    assert rows["notes.md"].lang == "prose"


def test_git(spark, checkout, tmp_path):
    root = str(checkout)
    assert {r.path for r in git.list_files(spark, root).collect()} >= {"app/grid.rb", "notes.md"}
    log = git.read_log(spark, root).collect()
    assert len(log) == 1 and "app/grid.rb" in log[0].files
    sha = git.head_sha(root)
    assert git.commits_between(root, sha) == 0 and git.commits_between(root, "") == 0
    assert not git.is_dirty(root)
    (checkout / "new.rb").write_text("x\n")
    assert git.is_dirty(root)
    repo = git.resolve(root)
    assert repo.is_git and repo.name == "repo" and len(repo.repo_id) == 12 and repo.index_path("/i") == f"/i/repo_{repo.repo_id}"
    outside = git.resolve(str(tmp_path))
    assert not outside.is_git and outside.index_path("/i") == "" and git.read_log(spark, str(tmp_path)).count() == 0


def test_build_and_locate(spark, checkout):
    index, changes = locate.build(spark, str(checkout), now=2_000_000_000)
    assert {r.change for r in changes.collect()} == {"new"}
    asked = spark.createDataFrame([(1, "Grid"), (2, "GridSync"), (3, "Grid Widget")], "query_id long, query string")
    rows, cluster = locate.locate(index, asked, now=2_000_000_000)
    top = {r.query_id: r for r in rows.where("rank = 1").collect()}
    assert top[1].path == "app/grid.rb" and top[1].confidence == "high"
    assert top[2].path == "app/grid_sync.rb" and top[2].has_exact_def
    assert top[3].confidence == "low"
    near = {r.query_id: r for r in cluster.collect()}
    assert near[1].cochange
    assert "app/grid.rb" in locate.render(rows).where("query_id = 1").first().text
    again, changes = locate.build(spark, str(checkout), now=2_000_000_000, before=index.files)
    assert {r.change for r in changes.collect()} == {"unchanged"}


def test_slices(spark):
    live = spark.createDataFrame([("a.rb", "l1\nl2\nl3\nl4", "h", "h", 1), ("b.rb", "x", "h2", "old", 2)], "path string, text string, content_hash string, indexed_hash string, file_id long")
    symbols = spark.createDataFrame([(1, "foo", 1, 2)], "file_id long, name string, start_line int, end_line int")
    asked = spark.createDataFrame(
        [(1, "@a.rb", "foo", None, None), (2, "a.rb", None, 3, 99), (3, "../x", None, 1, 2), (4, "no.rb", None, 1, 2), (5, "a.rb", "bar", None, None), (6, "b.rb", None, None, None)],
        "request_id long, path string, symbol string, start_line int, end_line int",
    )
    rows = {r.request_id: r for r in locate.slices(asked, live, symbols).collect()}
    assert (rows[1].start_line, rows[1].end_line, rows[1].body) == (1, 2, "l2\nl3")
    assert (rows[2].start_line, rows[2].end_line, rows[2].body) == (2, 3, "l3\nl4")
    assert [rows[i].error for i in (3, 4, 5)] == ["forbidden path", "no such file", "no such symbol"]
    assert rows[6].stale and not rows[1].stale


def test_relative_path():
    assert files.relative_path("/r", "a/b.rb") == "a/b.rb"
    assert files.relative_path("/r", "../x") is None
    assert files.relative_path("/r", "b.rb", "/r/a") == "a/b.rb"


def test_config(tmp_path):
    made = merge_config({"max_locate_results": 0, "index_idle_ms": 0, "enabled": "yes", "languages": ["ruby", "cobol"], "keyword_stoplist": ["A"], "unknown": 1, "telemetry": True})
    assert (made.max_locate_results, made.index_idle_ms, made.enabled, made.languages, made.keyword_stoplist, made.telemetry) == (10, 0, True, ("ruby",), ("a",), True)
    path = tmp_path / "s.json"
    path.write_text("{broken")
    assert load_config(str(path)) == Config() == load_config(str(tmp_path / "none.json"))


def test_cases_and_traces(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text('{"query": "a", "expect": ["x"]}\n{"query": "b"}\n{"query": "c", "expect_prefix": "p"}\n')
    assert [r.query for r in traces.read_cases(spark, f"{tmp_path}/cases.jsonl").collect()] == ["a", "c"]
    (tmp_path / "t.json").write_text(json.dumps([{"turn": 1, "toolName": "read"}, {"turn": 2, "toolName": "bash"}]))
    rows = traces.read_trace(spark, f"{tmp_path}/t.json", "turn int, toolName string").collect()
    assert [(r.seq, r.toolName) for r in rows] == [(1, "read"), (2, "bash")]
