"""The jobs over growing input: what a second run takes, what it leaves as it is, and what a replayed batch does."""

import json
import os
import random
import re
import subprocess
import sys
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import common, index_documents, session_outcomes

SCHEMA = "doc_id long, text string, lang string, source string"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def arrive(spark, rows, folder, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def postings(texts):
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    terms = {i: re.findall(r"[^\W_]+", fold(t or "")) for i, t in texts.items()}
    return {(t, i): (n, len(found)) for i, found in terms.items() for t, n in Counter(found).items()}


def held(spark, output):
    rows = index_documents.read_postings(spark, output).collect()
    assert len({(r.term, r.doc_id) for r in rows}) == len(rows)
    return {(r.term, r.doc_id): (r.tf, r.n_terms) for r in rows}


def files(spark, path):
    return {(r.path, r.modificationTime) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime").collect()}


def test_index_takes_only_what_is_new(spark, tmp_path):
    docs, output, mark = (f"{tmp_path}/{n}" for n in ("docs", "out", "ck"))
    run = lambda: index_documents.run(spark, docs, output, mark)
    arrive(spark, [(1, "Élan of the élan", "fr", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "no id", "en", "a")], docs)
    (first,) = run()
    assert (first["rows"], first["documents"]) == (4, 3)
    assert held(spark, output) == postings({1: "Élan of the élan", 2: None, 3: ""})
    before = files(spark, output)
    assert run() == [] and files(spark, output) == before  # nothing came, nothing changes
    # One new document, one new text, one text as it was, one document twice in a batch.
    arrive(spark, [(4, "fresh words", "en", "b"), (1, "other words", "fr", "a"), (2, "", "en", "a"), (5, "twice", "en", "b"), (5, "twice", "en", "b")], docs)
    (second,) = run()
    assert (second["rows"], second["documents"], second["batch"]) == (5, 3, first["batch"] + 1)
    assert held(spark, output) == postings({1: "other words", 2: None, 3: "", 4: "fresh words", 5: "twice"})
    assert before <= files(spark, output)  # what the first run wrote stays as it is
    words = spark.read.parquet(f"{output}/words").where(F.col("batch") == second["batch"]).collect()
    assert {(w.term, w.df, w.max_tf) for w in words} == {("fresh", 1, 1), ("words", 2, 1), ("other", 1, 1), ("twice", 1, 1)}


def test_a_batch_played_again_gives_the_same_index(spark, tmp_path):
    docs, output, mark = (f"{tmp_path}/{n}" for n in ("docs", "out", "ck"))
    arrive(spark, [(i, f"text {i} of many", "en", "a") for i in range(30)], docs)
    index_documents.run(spark, docs, output, mark)
    arrive(spark, [(i, f"text {i} of few", "en", "a") for i in range(20, 40)], docs)
    index_documents.run(spark, docs, output, mark)
    expected = held(spark, output)
    batch = spark.createDataFrame([(i, f"text {i} of few", "en", "a") for i in range(20, 40)], SCHEMA)
    counts = index_documents.index_batch(spark, batch, 1, output, index_documents.Settings())
    assert counts["documents"] == 20 and held(spark, output) == expected
    # A run over all files with a new checkpoint finds every text known: those of batch 0 that changed since are not.
    again = index_documents.run(spark, docs, output + "2", mark + "2", index_documents.Settings(files_per_batch=1))
    assert [c["documents"] for c in again] == [30, 20] and held(spark, output + "2") == expected


def test_index_of_an_empty_table_and_of_a_single_file(spark, tmp_path):
    arrive(spark, [], f"{tmp_path}/none")
    index_documents.run(spark, f"{tmp_path}/none", f"{tmp_path}/out", f"{tmp_path}/ck")
    assert held(spark, f"{tmp_path}/out") == {}
    arrive(spark, [(7, "one file", "en", "a")], f"{tmp_path}/some")
    (part,) = (tmp_path / "some").glob("*.parquet")
    index_documents.run(spark, str(part), f"{tmp_path}/out1", f"{tmp_path}/ck1")
    assert held(spark, f"{tmp_path}/out1") == postings({7: "one file"})


def test_settings(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"buckets": 4}, indent=1))
    assert common.settings(spark, index_documents.Settings, str(path)) == index_documents.Settings(buckets=4)
    assert common.settings(spark, index_documents.Settings, f"{ROOT}/jobs/index_documents.json") == index_documents.Settings()
    assert common.settings(spark, session_outcomes.Settings, f"{ROOT}/jobs/session_outcomes.json") == session_outcomes.Settings()
    for bad in ({"bucket": 4}, {"buckets": "4"}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            common.settings(spark, index_documents.Settings, str(path))


def test_command_line(spark, tmp_path):
    arrive(spark, [(7, "one file", "en", "a")], f"{tmp_path}/docs")
    args = ["--documents", f"{tmp_path}/docs", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/ck", "--config", f"{ROOT}/jobs/index_documents.json"]
    done = subprocess.run([sys.executable, "-m", "jobs.index_documents", *args], cwd=ROOT, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0 and "batch 0: read 1 rows, indexed 1 documents, wrote 2 postings of 2 words" in done.stderr
    assert held(spark, f"{tmp_path}/out") == postings({7: "one file"})


# ---- outcomes of sessions --------------------------------------------------------------------------

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def log(seed, n=400, first="2024-01-01"):
    """Events of six users over eight days, in order of time."""
    rng = random.Random(seed)
    at = sorted(rng.randrange(8 * 86_400) for _ in range(n))
    kinds = ("view", "view", "click", "click", "purchase", "error", "signup")
    return [(i, t, rng.randrange(6), rng.choice(kinds), rng.random() * 90, json.dumps({"k": rng.randrange(40)})) for i, t in enumerate(at)]


def deliver(spark, rows, folder):
    df = spark.createDataFrame(rows, EVENTS.replace("ts timestamp_ntz", "at long")).withColumn("ts", (F.timestamp_seconds(F.col("at") + 1_704_067_200)).cast("timestamp_ntz"))
    df.select(*[c.split()[0] for c in EVENTS.split(", ")]).coalesce(1).write.mode("append").parquet(folder)


def judged(spark, output):
    return {tuple(r) for r in spark.read.schema(session_outcomes.OUTCOMES).parquet(f"{output}/outcomes").collect()}


def summary(spark, output):
    rows = spark.read.parquet(f"{output}/summary").drop("upto")
    return {tuple(r[c] for c in sorted(rows.columns)) for r in rows.collect()}


def test_outcomes_of_a_growing_log(spark, tmp_path):
    rows, parts = log(1), (150, 151, 290, 400)
    deliver(spark, rows, f"{tmp_path}/all")
    whole = session_outcomes.run(spark, f"{tmp_path}/all", f"{tmp_path}/out0", f"{tmp_path}/ck0")
    assert whole["rows"] == 400 and len(judged(spark, f"{tmp_path}/out0")) == sum(r[3] == "view" for r in rows)
    run = lambda: session_outcomes.run(spark, f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/ck", session_outcomes.Settings(files_per_batch=1))
    before, start = set(), 0
    for stop in parts:
        deliver(spark, rows[start:stop], f"{tmp_path}/log")
        assert run()["rows"] == stop - start
        # Days that no new row belongs to keep their files.
        now, start = files(spark, f"{tmp_path}/out/outcomes"), stop
        same = {f for f in before if "day=2024-01-01" in f[0]}
        assert before == set() or same <= now
        before = now
    assert judged(spark, f"{tmp_path}/out") == judged(spark, f"{tmp_path}/out0")
    assert summary(spark, f"{tmp_path}/out") == summary(spark, f"{tmp_path}/out0")
    everything = files(spark, f"{tmp_path}/out")
    assert run() == {"rows": 0, "batches": 0, "days": 0} and files(spark, f"{tmp_path}/out") == everything


def test_an_interrupted_run_is_made_good(spark, tmp_path, monkeypatch):
    rows = log(2, 200)
    deliver(spark, rows, f"{tmp_path}/log")
    run = lambda: session_outcomes.run(spark, f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/ck")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with monkeypatch.context() as m:  # after the rows were taken, before they are judged
        m.setattr(session_outcomes, "judge", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run()
    with monkeypatch.context() as m:  # in the middle of a batch
        deliver(spark, [], f"{tmp_path}/log")
        deliver(spark, [(900, 9 * 86_400, 1, "view", 50.0, '{"k": 3}')], f"{tmp_path}/log")
        m.setattr(session_outcomes, "replace", lambda *a: 1 / 0)
        with pytest.raises(Exception):
            run()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    run()
    deliver(spark, [*rows, (900, 9 * 86_400, 1, "view", 50.0, '{"k": 3}')], f"{tmp_path}/log0")
    session_outcomes.run(spark, f"{tmp_path}/log0", f"{tmp_path}/out0", f"{tmp_path}/ck0")
    assert judged(spark, f"{tmp_path}/out") == judged(spark, f"{tmp_path}/out0")


def test_a_log_with_named_files_late_rows_and_nulls(spark, tmp_path):
    shown = json.dumps({"results": ["a", "b"], "cochange": ["c"], "referrers": [], "call": "x"})
    rows = [(1, 0, 1, "view", 10.0, shown), (2, 5, 1, "click", None, '{"path": "b"}'), (3, 9, 1, "purchase", None, '{"path": "c", "call": "x"}'), (4, 9, None, None, None, None), (5, 10, 2, "view", 99.0, "broken")]
    deliver(spark, rows, f"{tmp_path}/log")
    session_outcomes.run(spark, f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/ck")
    used = {r.event_id: r for r in spark.read.parquet(f"{tmp_path}/out/calls").collect()}
    assert (used[2].locate_rank, used[3].cluster_kind, used[3].latency_ms) == (2, "cochange", 9_000) and set(used) == {1, 2, 3, 5}
    out = {r.locate_id: r for r in spark.read.parquet(f"{tmp_path}/out/outcomes").collect()}
    assert (out[1].outcome, out[1].hit_rank, out[1].confidence, out[5].outcome) == ("hit", 2, "low", "abandoned")
    deliver(spark, [(6, 40 * 86_400, 2, "view", 1.0, None)], f"{tmp_path}/log")
    session_outcomes.run(spark, f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/ck")
    deliver(spark, [(7, 20, 1, "click", 1.0, None)], f"{tmp_path}/log")
    with pytest.raises(ValueError, match="later than 1 day"):
        session_outcomes.run(spark, f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/ck")


def test_tasks_of_postings_grow_with_the_documents(spark, tmp_path, monkeypatch):
    """What a task sorts is bounded by its documents; a bucket was dealt to four tasks, however many documents came."""
    monkeypatch.setattr(index_documents, "TASK_DOCUMENTS", 20)
    texts = {i: f"same other word{i} same" for i in range(400)}
    arrive(spark, [(i, t, "en", "s") for i, t in texts.items()], f"{tmp_path}/in")
    index_documents.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", index_documents.Settings(buckets=1))
    assert held(spark, f"{tmp_path}/out") == postings(texts)
    assert len(files(spark, f"{tmp_path}/out/postings/batch=0/bucket=0")) > 4
