import json

from larkfield.operators import events, export, metrics, sessions

SCHEMA = "session_id string, ts long, turn int, tool string, args map<string,string>, details string, content string, is_error boolean, root string, cwd string"


def rows(*items):
    out = []
    for i, (tool, args, details, content) in enumerate(items):
        out.append(("s", i * 10, i, tool, args, None if details is None else json.dumps(details), content, False, "/r", "/r/sub"))
    return out


def test_events_become_rows_and_outcomes(spark, tmp_path):
    shown = {"results": [{"path": "a.rb", "score": 1.5, "signals": {"fts": 1.0}}, {"path": "b.rb", "score": 1.0}], "cluster": {"cochange": ["c.rb"], "referrers": []}, "confidence": "high"}
    frame = spark.createDataFrame(
        rows(
            ("locate", {"query": "grid"}, None, "not inside a git repository"),
            ("slice", {}, None, "still booting"),
            ("locate", {"query": "power flow", "limit": "3"}, shown, None),
            ("edit", {}, None, None),
            ("read", {"path": "../../etc/x"}, None, None),
            ("bash", {"command": "ls | grep x"}, None, None),
            ("bash", {"command": "cd y && rg -n 'z'"}, None, None),
            ("grep", {"pattern": "p"}, None, None),
            ("read", {"file_path": "../b.rb"}, None, None),
            ("slice", {}, {"path": "/r/c.rb", "stale_index": True}, None),
        ),
        SCHEMA,
    )
    out = events.dispatch(frame)
    locate = out["locates"].collect()
    assert [(r.seq, r.query_type, r.result_count, r.limit_n, r.results, r.cochange) for r in locate] == [(3, "keyword", 2, 3, ["a.rb", "b.rb"], ["c.rb"])]
    used = {r.seq: r for r in out["consumes"].collect()}
    assert {s: (r.kind, r.path, r.search_tool, r.search_pattern) for s, r in used.items()} == {
        4: ("search", None, "rg", "z"), 5: ("search", None, "grep", "p"), 6: ("read", "b.rb", None, None), 7: ("slice", "c.rb", None, None),
    }
    assert {(r.seq, r.tool, r.reason) for r in out["unavailable"].collect()} == {(1, "locate", "non_git"), (2, "slice", "booting")}
    marked = sessions.attribute_ring(out["locates"], out["consumes"])
    assert {r.seq: (r.locate_rank, r.cluster_kind) for r in marked.collect()} == {4: (None, None), 5: (None, None), 6: (2, None), 7: (None, "cochange")}
    done = sessions.outcomes(out["locates"], marked)
    assert done.first().outcome == "hit" and metrics.outcome_metrics(done).first().mrr == 0.5
    events.append(out, str(tmp_path))
    events.append(out, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/consumes").count() == 8
    cases = export.export_cases(done, marked, spark.createDataFrame([("z",)], "path string"))
    events.write_cases(cases, f"{tmp_path}/cases")
    assert spark.read.json(f"{tmp_path}/cases").count() == 1
