"""The kept index of a checkout against a full build, over random histories of edits, deletions and commits."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from larkfield.config import Config
from larkfield.operators import graph
from larkfield.plans import locate
from larkfield.plans.index_loop import KeptIndex

BASE = 1_700_000_000
WORDS = "grid power flow sync model order line node".split()


class Checkout:
    """A repository that changes at random."""

    def __init__(self, root, seed):
        self.root, self.rng, self.n, self.clock = root, random.Random(seed), 0, BASE
        root.mkdir()
        self.git("init", "-q")

    def git(self, *args, at=None):
        env = {**os.environ, "GIT_COMMITTER_DATE": f"{at} +0000", "GIT_AUTHOR_DATE": f"{at} +0000"} if at else None
        subprocess.run(["git", "-C", str(self.root), "-c", "user.email=a@b", "-c", "user.name=n", *args], check=True, capture_output=True, env=env)

    def edit(self):
        rng = self.rng
        there = sorted(p for p in self.root.rglob("*.*") if ".git" not in p.parts)
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if there and kind < 0.2:
                there.pop(rng.randrange(len(there))).unlink()
                continue
            word = rng.choice(WORDS)
            path = rng.choice(there) if there and kind < 0.5 else self.root / rng.choice(["app", "lib"]) / f"{word}_{self.n % 9}{rng.choice(['.rb', '.py', '.md', '.ts'])}"
            self.n += 1
            path.parent.mkdir(exist_ok=True)
            name = word.title() + str(self.n % 5)
            text = {".rb": f"require_relative 'grid_{self.n % 9}'\nclass {name} < Base\n  def {word}\n  end\nend\n", ".py": f"import {word}_1\nclass {name}:\n    pass  # {word}\n", ".ts": f"import {{ x }} from './{word}_2';\nexport class {name} {{}}\n"}
            path.write_text(text.get(path.suffix, f"# {name}\nsome {word} text\n") + "x " * rng.randint(0, 9))

    def commit(self):
        self.clock += self.rng.randint(1, 40) * 86_400
        self.git("add", "-A")
        self.git("commit", "-qm", f"c{self.n}", "--allow-empty", at=self.clock + (500 * 86_400 if self.rng.random() < 0.1 else 0))


def state(index):
    rows = lambda df, *columns: {tuple(r) for r in df.select(*columns).collect()}
    files = rows(index.files, "path", "file_id", "lang", "size", "mtime", "content_hash", "last_commit_at", "commits_30d", "commits_90d")
    edges = {(r.file_a, r.file_b): pytest.approx(r.weight, rel=1e-9) for r in index.cochange.collect()}
    return files, rows(index.symbols, "file_id", "name", "kind", "start_line", "end_line"), rows(index.text, "file_id", "path", "symbol_names", "keywords", "content"), rows(index.refs, "src", "dst", "kind"), edges


@pytest.mark.parametrize("seed", [1, 2])
def test_passes_equal_full_builds(spark, tmp_path, seed):
    repo, kept = Checkout(tmp_path / "repo", seed), KeptIndex(spark, f"{tmp_path}/store")
    for step in range(4):
        for _ in range(repo.rng.randint(1, 3)):
            repo.edit()
            if repo.rng.random() < 0.8:
                repo.commit()
        now = repo.clock + 3_600
        done = kept.update(str(repo.root), now)
        whole, changes = locate.build(spark, str(repo.root), now)
        assert state(kept.read(now)) == state(whole), step
        assert done["pass"] == step and (step > 0 or done["read"] == changes.count())
        if step == 1:
            kept.compact()
            kept = KeptIndex(spark, f"{tmp_path}/store")
            assert state(kept.read(now)) == state(whole)
            assert kept._passes()[-1]["pass"] == 2
            repo.n += 1
            break
    repo.edit(), repo.commit()
    later = repo.clock + 90 * 86_400  # weights and recency are taken at another time than they were kept
    kept.update(str(repo.root), later)
    assert state(kept.read(later)) == state(locate.build(spark, str(repo.root), later)[0])
    idle = kept.update(str(repo.root), later)
    assert (idle["read"], idle["gone"], idle["commits"]) == (0, 0, 0)


def test_unchanged_files_are_not_opened_and_failed_passes_do_not_count(spark, tmp_path, monkeypatch):
    repo, kept = Checkout(tmp_path / "repo", 5), KeptIndex(spark, f"{tmp_path}/store")
    (repo.root / "a.rb").write_text("class Alpha\nend\n")
    (repo.root / "b.rb").write_text("class Beta\nend\n")
    repo.commit()
    kept.update(str(repo.root), repo.clock)
    names = lambda: {r.name for r in kept.read(repo.clock).symbols.collect()}
    at = os.stat(repo.root / "a.rb")
    (repo.root / "a.rb").write_text("class Omega\nend\n")  # same size, same time: taken as unchanged
    os.utime(repo.root / "a.rb", ns=(at.st_atime_ns, at.st_mtime_ns))
    (repo.root / "b.rb").write_text("class BetaTwo\nend\n")
    with monkeypatch.context() as m:
        m.setattr(KeptIndex, "_finish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.update(str(repo.root), repo.clock)
    assert names() == {"Alpha", "Beta"}
    assert kept.update(str(repo.root), repo.clock)["read"] == 1 and names() == {"Alpha", "BetaTwo"}


def test_rewritten_history_is_taken_anew(spark, tmp_path):
    repo, kept = Checkout(tmp_path / "repo", 6), KeptIndex(spark, f"{tmp_path}/store")
    for _ in range(3):
        repo.edit(), repo.commit()
    kept.update(str(repo.root), repo.clock)
    repo.git("reset", "-q", "--hard", "HEAD~2")
    repo.edit(), repo.commit()
    kept.update(str(repo.root), repo.clock)
    assert state(kept.read(repo.clock)) == state(locate.build(spark, str(repo.root), repo.clock)[0])


def test_decayed_parts_equal_the_whole(spark):
    rng = random.Random(3)
    rows = [(f"c{i}", BASE + rng.randrange(-300, 100) * 86_400, rng.sample("abcdef", rng.randint(1, 4))) for i in range(60)]
    commits = spark.createDataFrame(rows, "sha string, ts long, files array<string>")
    first, second = commits.where(F.col("sha") < "c4"), commits.where(F.col("sha") >= "c4")
    then, now = BASE - 50 * 86_400, BASE + 10 * 86_400
    parts = graph.cochange_part(first, then).unionByName(graph.cochange_part(second, now))
    waiting = graph.not_yet(first, then).unionByName(graph.not_yet(second, now))
    show = lambda df: {(r.file_a, r.file_b): pytest.approx(r.weight, rel=1e-12) for r in df.collect()}
    assert show(graph.cochange_at(parts, now, waiting=waiting)) == show(graph.cochange(commits, now))
