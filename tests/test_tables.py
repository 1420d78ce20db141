from larkfield.operators import snapshot as S


def test_backlog_and_work_list(spark):
    disk = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 3, 10), ("d", 4, 10)], "path string, mtime long, size long")
    old = spark.createDataFrame([("a", 1, 10, True), ("b", 9, 10, True), ("c", 3, 10, False), ("z", 1, 1, True)], "path string, mtime long, size long, symbols_done boolean")
    changes = S.backlog(disk, old)
    assert {r.path: r.change for r in changes.collect()} == {"a": "unchanged", "b": "changed", "c": "unfinished", "d": "new"}
    assert [r.path for r in S.deleted(disk, old).collect()] == ["z"]
    work = S.work_list(changes, spark.createDataFrame([("b",), ("q",), ("b",)], "path string"))
    assert {(r.path, r.turn) for r in work.collect()} == {("b", 0), ("q", 0), ("c", 1), ("d", 1)}


def test_dml(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string")
    assert {tuple(r) for r in S.upsert(old, new, "id").collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert {tuple(r) for r in S.insert_or_ignore(old, new, "id", "v").collect()} == {(1, "x"), (2, "y"), (3, "w")}
    edges = spark.createDataFrame([(1, 2, "k"), (1, 3, "k"), (2, 1, "k")], "src long, dst long, kind string")
    fresh = spark.createDataFrame([(1, 9, "k"), (1, 9, "k")], "src long, dst long, kind string")
    assert sorted(map(tuple, S.replace_children(edges, fresh, "src", ["src", "dst", "kind"]).collect())) == [(1, 9, "k"), (2, 1, "k")]
    live = spark.createDataFrame([(1,), (2,)], "id long")
    assert {tuple(r) for r in S.cascade(edges, live, ("src", "id"), ("dst", "id")).collect()} == {(1, 2, "k"), (2, 1, "k")}


def test_versions(spark, tmp_path):
    table = S.SnapshotTable(spark, f"{tmp_path}/t")
    assert table.read() is None
    table.write(spark.range(3))
    table.write(spark.range(5))
    assert table.read().count() == 5
    assert S.SnapshotTable(spark, f"{tmp_path}/t", schema_version=9).read() is None
    table.reset()
    assert table.read() is None
