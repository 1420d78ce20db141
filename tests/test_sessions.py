import random

import pytest
from pyspark.sql import functions as F

from larkfield.operators import export, metrics, sessions

LOCATES = "locate_id long, session_id string, seq int, turn int, results array<string>, cochange array<string>, referrers array<string>, confidence string, result_count int, query_type string"
CONSUMES = "session_id string, seq int, turn int, kind string, path string"


def brute(locates, consumes):
    """Marks and outcomes by the plain rules."""
    marked = []
    for c in consumes:
        seen = [x for x in locates if x[1] == c[0] and x[2] < c[1]][-8:]
        rank = kind = None
        for x in reversed(seen):
            if c[4] in x[4]:
                rank = x[4].index(c[4]) + 1
            elif c[4] in x[5] or c[4] in x[6]:
                kind = "cochange" if c[4] in x[5] else "referrer"
            if rank or kind:
                break
        marked.append((*c, rank, kind))
    out = {}
    for i, x in enumerate(locates):
        after = [y[2] for y in locates if y[1] == x[1] and y[2] > x[2]]
        end = min(after, default=10**9)
        w = sorted((c for c in marked if c[0] == x[1] and x[2] < c[1] < end and c[2] <= x[3] + 10), key=lambda c: c[1])
        hit = next((c for c in w if c[3] != "search" and c[5]), None)
        assist = next((c for c in w if c[3] != "search" and c[6]), None)
        soon = next((c for c in w if c[3] == "search" and c[2] <= x[3] + 3), None)
        if hit:
            out[x[0]] = "hit"
        elif assist and (not soon or assist[1] < soon[1]):
            out[x[0]] = "cluster-assist"
        else:
            out[x[0]] = "miss-fallback" if soon else "abandoned"
    return {(c[0], c[1]): (c[5], c[6]) for c in marked}, out


def generated(seed):
    rng = random.Random(seed)
    locates, consumes = [], []
    for s in range(40):
        seq = turn = 0
        for _ in range(rng.randint(1, 30)):
            seq += 1
            turn += rng.randint(0, 3)
            if rng.random() < 0.3:
                paths = rng.sample("abcdefgh", rng.randint(0, 4))
                locates.append((len(locates), f"s{s}", seq, turn, paths, rng.sample("abcdefgh", rng.randint(0, 2)), rng.sample("abcdefgh", 1), "low", len(paths), "keyword"))
            else:
                kind = rng.choice(["read", "slice", "search"])
                consumes.append((f"s{s}", seq, turn, kind, None if kind == "search" else rng.choice("abcdefghij")))
    return locates, consumes


@pytest.mark.parametrize("seed", [1, 2])
def test_attribution_and_outcomes_match_brute_force(spark, seed):
    locates, consumes = generated(seed)
    lf, cf = spark.createDataFrame(locates, LOCATES), spark.createDataFrame(consumes, CONSUMES)
    used = sessions.attribute_ring(lf, cf)
    rows = sessions.outcomes(lf, used).collect()
    marks, expected = brute(locates, consumes)
    assert {(r.session_id, r.seq): (r.locate_rank, r.cluster_kind) for r in used.collect()} == marks
    assert {r.locate_id: r.outcome for r in rows} == expected
    assert all((r.hit_rank is not None) == (r.outcome == "hit") for r in rows)


def one(spark, consumes, **changes):
    base = {"locate_id": 1, "session_id": "s", "seq": 1, "turn": 1, "results": ["a", "b"], "cochange": ["c"], "referrers": [], "confidence": "high", "result_count": 2, "query_type": "keyword"} | changes
    lf = spark.createDataFrame([tuple(base.values())], LOCATES)
    return sessions.outcomes(lf, sessions.attribute_ring(lf, spark.createDataFrame(consumes, CONSUMES))).first()


def test_window_edges(spark):
    assert one(spark, [("s", 2, 4, "search", None)]).outcome == "miss-fallback"
    assert one(spark, [("s", 2, 5, "search", None)]).outcome == "abandoned"
    assert one(spark, [("s", 2, 11, "read", "a")]).outcome == "hit"
    assert one(spark, [("s", 2, 12, "read", "a")]).outcome == "abandoned"
    assert one(spark, [("s", 2, 2, "search", None), ("s", 3, 2, "read", "c")]).outcome == "miss-fallback"
    assert one(spark, [("s", 2, 2, "search", None), ("s", 3, 2, "read", "b")]).hit_rank == 2
    assert one(spark, []).outcome == "abandoned"


def test_metrics(spark):
    rows = [("s", "hit", 2, 1, 0, "high", False), ("s", "miss-fallback", None, None, 2, "low", True), ("t", "cluster-assist", None, 3, 0, "high", False)]
    frame = spark.createDataFrame(rows, "session_id string, outcome string, hit_rank int, turns_to_useful int, searches long, confidence string, justified_fallback boolean")
    m = metrics.outcome_metrics(frame).first()
    assert (m.mrr, m.median_turns, m.fallback_searches, m.precision_high) == (0.5, 2.0, 2, 0.5)
    assert m.hit_at_1 == 0 and m.hit_at_3 == pytest.approx(1 / 3)
    empty = metrics.outcome_metrics(frame.where("false")).first()
    assert (empty.n_locates, empty.mrr, empty.hit_rate, empty.median_turns) == (0, 0.0, 0.0, 0.0)
    assert metrics.both_scopes(frame).count() == 3


def test_small_aggregates(spark):
    guards = spark.createDataFrame([("allow",), ("block",), ("block",)], "action string")
    assert tuple(metrics.guard_counts(guards).first()) == (1, 0, 2)
    reasons = spark.createDataFrame([("x",), ("y",), ("x",)], "reason string")
    assert metrics.reasons(reasons).first().by_reason == {"x": 2, "y": 1}
    flags = spark.createDataFrame([("s", 1, "r", True, False, True), ("s", 2, "q", False, True, False)], "session_id string, ts long, repo_root string, is_writer boolean, used_locate boolean, tools_selected boolean")
    row = sessions.session_flags(flags).first()
    assert (row.started_at, row.repo_root, row.is_writer, row.used_locate, row.tools_selected) == (1, "r", True, True, False)


def test_both_marks_are_refused(spark):
    frame = spark.createDataFrame([(1, "cochange")], "locate_rank int, cluster_kind string")
    with pytest.raises(Exception, match="both a rank"):
        sessions.checked(frame).collect()


def test_retention(spark):
    day = 86_400_000
    kept = sessions.retain(
        {
            "sessions": spark.createDataFrame([("old", 0), ("new", 39 * day)], "session_id string, started_at long"),
            "consumes": spark.createDataFrame([("old", 39 * day), ("new", 39 * day), ("new", 0)], "session_id string, ts long"),
        },
        40 * day,
    )
    assert [tuple(r) for r in kept["consumes"].collect()] == [("new", 39 * day)]


def test_export_verdicts_and_redaction(spark):
    lf = spark.createDataFrame([(1, "s", 1, 1, ["a", "id_rsa"], ["c"], [], "high", 2, "keyword")], LOCATES)
    used = sessions.attribute_ring(lf, spark.createDataFrame([("s", 2, 1, "search", None), ("s", 3, 1, "read", "z")], CONSUMES))
    rows = sessions.outcomes(lf, used)
    verdict = lambda files: export.verdicts(rows, used, spark.createDataFrame(files, "path string")).first().verdict
    assert verdict([("z",)]) == "indexed_not_returned"
    assert verdict([("y",)]) == "not_indexed"
    case = export.export_cases(rows, used, spark.createDataFrame([("z",)], "path string")).first()
    assert case.results == ["a"] and case.priority == 0 and case.target == "z"


def test_string_set(spark):
    frame = spark.createDataFrame([('["a","b","a"]',), ("{broken",), (None,)], "j string")
    assert [r.v for r in frame.select(export.string_set(F.col("j")).alias("v")).collect()] == [["a", "b"], [], []]


def test_pairing_keeps_ends_without_start(spark):
    starts = spark.createDataFrame([("s", "1", 10, "x")], "session_id string, call_id string, ts long, args string")
    ends = spark.createDataFrame([("s", "1", 15), ("s", "2", 20)], "session_id string, call_id string, ts long")
    assert {r.call_id: r.latency_ms for r in sessions.pair_calls(starts, ends).collect()} == {"1": 5, "2": None}
