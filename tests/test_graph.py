import pytest
from pyspark.sql import functions as F

from larkfield.operators import graph
from larkfield.plans import graph_queries
from larkfield.sources import git

COMMITS = [("aaa", 1000, ["grid", "grid_sync"]), ("bbb", 900, ["grid", "README"])]
SCHEMA = "sha string, ts long, files array<string>"


def test_recency_and_weights(spark):
    commits = spark.createDataFrame(COMMITS, SCHEMA)
    seen = {r.file: (r.last_commit_at, r.commits_90d) for r in graph.recency(commits, 1000).collect()}
    assert seen == {"grid": (1000, 2), "grid_sync": (1000, 1), "README": (900, 1)}
    pairs = {(r.file_a, r.file_b): r.weight for r in graph.cochange(commits, 1000).collect()}
    assert pairs.keys() == {("grid", "grid_sync"), ("README", "grid")} and pairs["grid", "grid_sync"] == 1.0


def test_future_commits_and_large_ones(spark):
    commits = spark.createDataFrame([("f", 9_999_999_999, ["z", "a"]), ("m", 10, ["p", "q", "r"])], SCHEMA)
    rows = graph.cochange(commits, 1000, max_files=2).collect()
    assert [(r.file_a, r.file_b, r.weight) for r in rows] == [("a", "z", 1.0)]
    assert graph.recency(commits, 1000).count() == 5


def test_same_path_twice(spark):
    commits = spark.createDataFrame([("x", 10, ["a", "a", "b"])], SCHEMA)
    assert {(r.file_a, r.file_b) for r in graph.cochange(commits, 10).collect()} == {("a", "b")}
    assert ("a", "a") in {(r.file_a, r.file_b) for r in graph.cochange(commits, 10, self_pairs=True).collect()}


def test_neighbours_and_hub_cap(spark):
    edges = spark.createDataFrame([("a", x, float(w)) for x, w in zip("bcdefg", (1, 2, 3, 3, 1, 9))], "file_a string, file_b string, weight double")
    assert [r.other for r in graph.neighbours(edges).where("file = 'a'").orderBy("rank").collect()] == ["g", "d", "e", "c", "b"]
    refs = spark.createDataFrame([(1, 9, "ruby_const"), (2, 9, "ruby_const"), (3, 9, "ruby_const"), (1, 8, "import"), (1, 8, "require")], "src long, dst long, kind string")
    assert {r.dst for r in graph.referrers(refs, 4).collect()} == {8}
    assert [(r.dst, r.src) for r in graph.referrers(refs, 100).where("dst = 8").collect()] == [(8, 1)]


def test_reference_resolution(spark):
    files = spark.createDataFrame(
        [(1, "app/models/grid.rb"), (2, "app/models/billing/invoice.rb"), (3, "lib/grid_sync.rb"), (4, "web/dep.ts"), (5, "web/ui/index.ts"), (6, "web/main.ts"), (7, "web/dep.js")],
        "file_id long, path string",
    )
    imports = spark.createDataFrame(
        [
            (3, "lib/grid_sync.rb", "Grid", "ruby_const"), (3, "lib/grid_sync.rb", "Billing::Invoice", "ruby_const"), (1, "app/models/grid.rb", "../../lib/grid_sync", "require_relative"),
            (6, "web/main.ts", "./dep", "import"), (6, "web/main.ts", "./ui", "import"), (6, "web/main.ts", "grid_sync", "import"), (6, "web/main.ts", "nowhere", "import"),
            (1, "app/models/grid.rb", "Grid", "ruby_const"),
        ],
        "file_id long, path string, hint string, kind string",
    )
    rows = {(r.src, r.dst, r.kind) for r in graph.resolve_references(imports, files).collect()}
    assert rows == {(3, 1, "ruby_const"), (3, 2, "ruby_const"), (1, 3, "require_relative"), (6, 4, "import"), (6, 5, "import"), (6, 3, "import")}


def test_log_with_a_malformed_header(spark):
    lines = ["stray", "__C__ bbb 900", "grid", "", "__C__ broken", "extra", "__C__ aaa 1000", "README"]
    frame = spark.createDataFrame([("x", i, t) for i, t in enumerate(lines)], "source string, line_no long, line string")
    rows = {r.sha: (r.ts, r.files) for r in git.parse_log(frame).collect()}
    assert rows == {"bbb": (900, ["grid", "extra"]), "aaa": (1000, ["README"])}


def test_cluster(spark):
    edges = spark.createDataFrame([(1, 2, 0.5)], "file_a long, file_b long, weight double")
    refs = spark.createDataFrame([(3, 1, "import")], "src long, dst long, kind string")
    rows = graph.cluster(spark.createDataFrame([(0, 1), (1, 4)], "query_id long, file long"), edges, refs, 10).orderBy("query_id").collect()
    assert [(r.cochange, r.referrers) for r in rows] == [([2], [3]), ([], [])]


@pytest.mark.parametrize("now", [0, 10**10])
def test_age_is_never_negative(spark, now):
    assert spark.range(1).select(graph.age_days(F.lit(5), now)).first()[0] >= 0


def test_references_by_constants_are_met_once_and_not_compared(spark, monkeypatch):
    monkeypatch.setattr(graph, "IMPORTERS", 3)
    paths = [(d, f"app/{'abc'[d % 3]}/item_{d % 4}.rb") for d in range(40)] + [(0, "lib/item_1.rb"), (0, "app/b/item_1.rb"), (41, None), (42, "item_1.rb")]
    hints = [(100 + k, h) for k in range(20) for h in ("Item_1", "B::Item_1", "App::B::Item_1", f"A::Item_{k % 4}", "Item_1")] + [(0, "Item_1"), (101, None)]
    files = spark.createDataFrame(paths, "file_id long, path string")
    imports = spark.createDataFrame([(s, "x.rb", h, "ruby_const") for s, h in hints], "file_id long, path string, hint string, kind string")
    tail = lambda h: h.lower().replace("::", "/") + ".rb"
    expected = {(s, d) for s, h in hints if h for d, p in paths if p and s != d and (p == tail(h) or p.endswith("/" + tail(h)))}
    found = graph.resolve_references(imports, files)
    rows = [(r.src, r.dst) for r in found.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    # What is shuffled is in line with the rows, and not with the pairs.
    files = spark.createDataFrame([(d, "a/item.rb") for d in range(200)], "file_id long, path string")
    imports = spark.createDataFrame([(1_000 + s, "x.rb", "Item", "ruby_const") for s in range(30)], "file_id long, path string, hint string, kind string")
    monkeypatch.setattr(graph, "IMPORTERS", 4_096)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = graph.resolve_references(imports, files)
        assert len(found.collect()) == 6_000 and shuffled(found) < 3_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hints_are_not_multiplied_by_endings(spark):
    files = spark.createDataFrame([(d, f"a/f{d}.ts") for d in range(50)] + [(90, "a/f1"), (91, "a/f2/index.js"), (92, "a/f2.rb")], "file_id long, path string")
    imports = files.select("file_id", "path", F.concat(F.lit("./f"), (F.col("file_id") % 50).cast("string")).alias("hint"), F.lit("import").alias("kind")).where("file_id < 50")
    imports = imports.withColumn("file_id", F.col("file_id") + 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.resolve_references(imports, files)
        assert {(r.src, r.dst) for r in found.collect()} == {(d + 100, {1: 90, 2: 92}.get(d, d)) for d in range(50)}
        assert shuffled(found) < 50 * len(graph.EXTENSIONS)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled(df):
    """Rows that the plan's exchanges wrote, broadcasts apart."""
    def walk(node):
        own = [node.metrics().apply("shuffleRecordsWritten").value()] if node.metrics().contains("shuffleRecordsWritten") else []
        return own + [n for i in range(node.children().size()) for n in walk(node.children().apply(i))]

    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_tasks_of_pairs_grow_with_the_rows(spark, monkeypatch):
    """What one task groups is bounded by its rows, whatever Spark makes of the bytes before commits are unfolded."""
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    for made in (graph_queries.edges(spark, sf_dir), graph_queries.commits(spark, sf_dir)):
        assert made.rdd.getNumPartitions() == -(-rows // 100)
