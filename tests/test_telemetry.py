import json

import pytest
from pyspark.sql import functions as F

from larkfield.functions import classify
from larkfield.operators.snapshot import Conflict, SnapshotTable
from larkfield.operators import events, metrics, sessions
from larkfield.operators.telemetry import TABLES, TelemetryStore, guard_rows, open_store
from larkfield.plans import locate

DAY = 86_400_000


def test_store_opens_migrates_appends_and_prunes(spark, tmp_path):
    old = SnapshotTable(spark, f"{tmp_path}/t/guards", 1)
    old.write(spark.createDataFrame([("s", 1, 40 * DAY, 1, "grep -r x .", "block", True)], "session_id string, seq long, ts long, turn long, command string, action string, rg_available boolean"))
    store = TelemetryStore(spark, f"{tmp_path}/t")
    assert store.read("guards").first().pattern_kind is None and store.read("locates").count() == 0
    store.append("sessions", spark.createDataFrame([("s", 40 * DAY, "x"), ("old", 1 * DAY, "x")], "session_id string, started_at long, extra string"))
    store.append("locates", spark.createDataFrame([("s", 1, 41 * DAY), ("old", 1, 41 * DAY), ("s", 2, 2 * DAY)], "session_id string, seq long, ts long"))
    again = TelemetryStore(spark, f"{tmp_path}/t", now_ms=60 * DAY)
    assert [r.session_id for r in again.read("sessions").collect()] == ["s"]
    assert [(r.session_id, r.seq) for r in again.read("locates").collect()] == [("s", 1)]
    assert again.read("guards").count() == 1


def test_full_rows_of_searches_and_older_versions(spark, tmp_path):
    old = SnapshotTable(spark, f"{tmp_path}/t/locates", 2)
    old.write(spark.createDataFrame([("s", 1, 5, 1, "grid", "keyword", 2, "high")], "session_id string, seq long, ts long, turn long, query string, query_type string, result_count int, confidence string"))
    store = TelemetryStore(spark, f"{tmp_path}/t")
    calls = spark.createDataFrame(
        [("s", 20, 3, "locate", {"query": "power flow"}, json.dumps({"results": [{"path": "a.rb", "score": 1.5}], "cluster": {"cochange": ["c.rb"], "referrers": []}, "confidence": "high"}), None, False, "/r", "/r")],
        "session_id string, ts long, turn int, tool string, args map<string,string>, details string, content string, is_error boolean, root string, cwd string",
    )
    made = events.dispatch(calls)
    store.append("locates", made["locates"].withColumns({"head_sha": F.lit("abc"), "latency_ms": F.lit(7)}))
    rows = {r.ts: r for r in store.read("locates").collect()}
    assert len(rows[20]) == len(TABLES["locates"].split(",")) == 23 and (rows[20].cochange, rows[20].referrers, rows[20].head_sha, rows[20].latency_ms) == ('["c.rb"]', "[]", "abc", 7)
    assert json.loads(rows[20].results_metadata)[0]["path"] == "a.rb" and (rows[5].query, rows[5].coverage, rows[5].cochange) == ("grid", None, None)
    store.append("consumes", made["consumes"])
    assert store.read("consumes").columns[-1] == "cluster_kind"


def test_a_store_that_cannot_be_opened_is_none(spark, tmp_path):
    (tmp_path / "t" / "sessions" / "pointers").mkdir(parents=True)
    (tmp_path / "t" / "sessions" / "pointers" / "000000000001").write_text('{"version": "v-lost", "schema_version": "3"}')
    assert open_store(spark, f"{tmp_path}/t", 10) is None and open_store(spark, f"{tmp_path}/u", 10).read("guards").count() == 0


def test_all_statistics_as_text(spark):
    locates = spark.createDataFrame([(1, "s", 1, 1, "high", 2), (2, "s", 4, 4, "low", 0)], "locate_id long, session_id string, seq long, turn long, confidence string, result_count int")
    used = spark.createDataFrame([("s", 2, 2, "read", "a", 2, None), ("s", 5, 5, "search", None, None, None)], "session_id string, seq long, turn long, kind string, path string, locate_rank int, cluster_kind string")
    outcomes = metrics.outcome_metrics(sessions.outcomes(locates, used))
    flags = metrics.session_metrics(spark.createDataFrame([(True, True), (False, False)], "used_locate boolean, tools_selected boolean"))
    slices = metrics.slice_metrics(spark.createDataFrame([("slice", True, None), ("slice", None, True)], "kind string, stale_index boolean, unchanged boolean"))
    guards = metrics.guard_counts(spark.createDataFrame([("warn",)], "action string"))
    none = spark.createDataFrame([], "reason string")
    show = lambda reasons, *more: locate.render_summary(outcomes, flags, slices, guards, metrics.reasons(reasons), *more).first().text.split("\n")
    lines = show(spark.createDataFrame([("booting",), ("booting",), ("non_git",)], "reason string"), metrics.coverage(spark.createDataFrame([(True,), (False,)], "symbols_done boolean")))
    assert lines == [
        "searches 2: hit 50%, cluster assist 0%, fallback 50%, abandoned 0%", "ranking: mrr 0.500, hit@1 0%, hit@3 50%, hit@5 50%", "precision: high 100%, low 0%",
        "turns to a useful file (median) 1.0, fallback searches 1, unjustified 0", "sessions 2, 1 with a search, bypassed 50%; tools selected in 1, not in 1",
        "slices 2, stale 50%, reads of unchanged text avoided 1", "scans: allowed 0, warned 1, blocked 0", "unavailable: booting 2, non_git 1", "index: 1 of 2 files (50%)",
    ]
    assert show(none)[-1] == "unavailable: never"


def test_guard_rows(spark):
    rows = [("s", 1, 5, 1, "grep -rn foo src", True), ("s", 2, 6, 1, "ls", True), ("s", 3, 7, 1, "grep -R 'a.b'", False)]
    made = guard_rows(spark.createDataFrame(rows, "session_id string, seq long, ts long, turn long, command string, rg_available boolean"), ["src"]).collect()
    assert [(r.seq, r.action, r.pattern_kind) for r in made] == [(1, "block", "symbol"), (3, "warn", "regex")]


def test_writers_that_collide_and_meta(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/t")
    first = table.write(spark.range(3))
    table.set_meta("cursor", "abc")
    table.write(spark.range(4))
    assert table.get_meta("cursor") == "abc" and first.count() == 3  # a reader keeps what it opened
    number, content = table._current()
    table.write(spark.range(5))
    with pytest.raises(Conflict):
        table._commit(number, content)
    fs, path = table._fs(f"pointers/{table._pointers()[-1] + 1:012d}")
    fs.create(path, False).close()  # a writer that failed half way
    assert table.read().count() == 5
    table.write(spark.range(6))
    assert table.read().count() == 6


def test_sub_commands_and_guidance(spark):
    asked = spark.createDataFrame([("",), (" reindex  a b ",), ("stats x",), ("reindex",), ("other",), (None,)], "a string")
    got = [tuple(r[0]) for r in asked.select(classify.sub_command(F.col("a"))).collect()]
    assert got == [("status", None), ("reindex", "a b"), ("stats", None), ("reindex", None), ("status", None), ("status", None)]
    rows = [
        ("investigate the crash", " act ", True, ["locate"], 95, 100, True, False, False, "h", "h"), ("investigate the crash", "act", True, ["locate"], 0, 100, False, False, True, "h", "k"),
        ("what branch am i on", "act", True, ["locate"], 9, 10, True, False, True, "", ""), ("investigate", "", False, None, 9, 10, True, False, False, "", ""),
    ]
    df = spark.createDataFrame(rows, "prompt string, persona string, resolved boolean, tools array<string>, indexed int, total int, done boolean, failed boolean, dirty boolean, ih string, hd string")
    c = F.col
    made = [r[0] for r in df.select(classify.guidance(c("prompt"), c("persona"), c("resolved"), c("tools"), c("indexed"), c("total"), c("done"), c("failed"), c("dirty"), c("ih"), c("hd"), F.lit(True))).collect()]
    assert made[0] == ["act", "locate first, then read the best result"] and made[2] == ["act"] and made[3] == []
    assert made[1] == ["0 of 100 files are indexed: use it where it helps", "nothing is indexed yet", "the index lags behind the files"]
