"""The kept index against search over the texts, through replacement, deletion and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from larkfield.operators import postings, search, substrings
from larkfield.operators.postings import PostingsIndex

WEIGHTS = {"title": 4.0, "text": 0.5}
SCHEMA = "doc_id long, title string, text string"


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.n_hit, round(r.b, 9), r.used_or) for r in df.collect())


def test_index_equals_search_over_the_texts(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: rng.choice([f"w{rng.randrange(25)}", rng.choice(("power", "sync", "model")) + rng.choice(("", "s", "ed", "ing"))])
    text = lambda n: " ".join(word() + rng.choice(["", "-", "."]) for _ in range(n))
    docs = {d: (text(2), text(rng.randrange(30))) for d in range(60)} | {60: (None, None)}
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3-w4 w5"), (3, "w6-w7-w8"), (4, "absent w9"), (5, "..."), (6, "w1.w1 w2"), (7, "powers synced"), (8, "power-syncing models"), (9, "modeling absent")], "query_id long, query string")
    index = PostingsIndex(spark, f"{tmp_path}/i", list(WEIGHTS), buckets=4)
    frame = lambda ds: spark.createDataFrame([(d, *t) for d, t in ds.items()], SCHEMA)

    def same():
        assert rows(index.match(asked, WEIGHTS, k=7)) == rows(search.match(frame(docs), asked, WEIGHTS, k=7))
        assert rows(index.match(asked, WEIGHTS, k=7, stem=True)) == rows(search.match(frame(docs), asked, WEIGHTS, k=7, stem=True))

    index.add(frame(docs))
    same()
    changed = {d: (text(2), text(12)) for d in (3, 4, 5, 70)}
    docs |= changed
    index.add(frame(changed))
    same()
    index.delete(spark.createDataFrame([(7,), (70,), (999,)], "doc_id long"))
    docs = {d: t for d, t in docs.items() if d not in (7, 70)}
    same()
    index.compact()
    assert len(index.segments()) == 1
    same()
    index.delete(spark.createDataFrame([(8,)], "doc_id long"))
    del docs[8]
    same()


def scanned(df):
    """Rows that the plan's file scans gave out, after files and pages were skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


def test_ranges_give_the_rows_of_a_scan_and_skip_pages(spark, tmp_path, monkeypatch):
    for name, value in (("RANGE_DOCS", 8), ("SPAN_RANGES", 60), ("PAGE_ROWS", 100), ("FIRST_RANGES", 2)):
        monkeypatch.setattr(postings, name, value)
    rng = random.Random(4)
    word = lambda: f"w{min(int(rng.expovariate(0.05)), 200)}"
    docs = spark.createDataFrame([(d, f"{word()} {word()}", " ".join(word() for _ in range(rng.randrange(60)))) for d in range(1_500)], SCHEMA)
    # Frequent words, rare ones, words that never meet, one that is nowhere, a repeated one, ties.
    texts = ["w0 w1", "w1 w90 w3", "w150 w151 w152 w153", "w2", "absent w5", "w7 w7", "w0 w1 w2 w3 w4 w5", "absent", "w140 w0"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    index = PostingsIndex(spark, f"{tmp_path}/i", list(WEIGHTS), buckets=3)
    index.add(docs)
    expected = rows(search.match(docs, asked, WEIGHTS, k=7))
    assert rows(index.match(asked, WEIGHTS, k=7)) == expected
    called = []
    in_ranges = PostingsIndex._in_ranges
    monkeypatch.setattr(PostingsIndex, "_in_ranges", lambda self, asked, wanted, weights: called.append(wanted.count()) or in_ranges(self, asked, wanted, weights))
    monkeypatch.setattr(postings, "SCAN_POSTINGS", 0)
    assert rows(index.match(asked, WEIGHTS, k=7)) == expected and len(called) == 4
    assert rows(index.match(asked, WEIGHTS, k=400)) == rows(search.match(docs, asked, WEIGHTS, k=400))
    # The dictionary holds the frequencies, and says which ranges a query leaves out.
    known = {r.term: r.df for r in index._postings(None).groupBy("term").agg(F.count_distinct("doc_id").alias("df")).collect()}
    assert index.frequencies(["w0", "w150", "absent"]) == {t: known[t] for t in ("w0", "w150") if t in known}
    for query, terms in ((2, "w150 w151 w152 w153"), (3, "w2"), (0, "w0 w1")):
        called.clear()
        index.match(asked.where(f"query_id = {query}"), WEIGHTS, k=2).collect()
        assert sum(called) < index.blocks(terms.split()).select("range").distinct().count() / (2 if query == 3 else 1)
    assert called[0] == 2
    # Pages: the intervals of a few ranges give fewer rows out of the files.
    monkeypatch.setattr(postings, "INTERVALS", 64)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few = spark.createDataFrame([("w0", 3), ("w0", 150)], "term string, range int")
        assert scanned(index._postings(["w0"], pushed=index._intervals(few))) < scanned(index._postings(["w0"])) / 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    spans = {r.span for r in spark.read.parquet(f"{tmp_path}/i/{index.segments()[0]}/postings").where("term = 'w0'").select("span").distinct().collect()}
    assert len(spans) == 4  # postings of a frequent term lie in several files


def test_kept_index_outlives_the_application(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "some words", "x")], SCHEMA).write.parquet(f"{tmp_path}/t")
    first = postings.kept(spark, f"{tmp_path}/t", ["text"])
    monkeypatch.setattr(postings, "_built", {})  # as in another application
    monkeypatch.setattr(PostingsIndex, "add", lambda *a: pytest.fail("built again"))
    assert postings.kept(spark, f"{tmp_path}/t", ["text"]).segments() == first.segments()


def test_texts_that_contain_strings(spark, tmp_path):
    rng = random.Random(9)
    letters = "abcÉé"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    texts = {d: " ".join(word() + rng.choice(["", ",", ".x", "-", "İ", "ΑΣ"]) for _ in range(rng.randrange(25))) for d in range(200)} | {200: None, 201: ""}
    docs = spark.createDataFrame([(d, "", t) for d, t in texts.items()], SCHEMA)
    index = PostingsIndex(spark, f"{tmp_path}/i", ["text"], buckets=3)
    index.add(docs.where("doc_id < 100"))
    index.add(docs.where("doc_id >= 90"))  # two segments, some documents in both
    cut = [t[(i := rng.randrange(len(t))) : i + rng.choice([1, 2, 4, 5, 9, 30])] for t in rng.choices([t for t in texts.values() if t], k=60)]
    needles = [*cut, "absent", "zzz zzz", ", ", "ΑΣ", "abc", "Éa", *(texts[d] for d in (3, 4, 5)), "", None, cut[0]]
    found = substrings.containing(index, docs, spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    expected = {(n, d) for n in needles if n for d, t in texts.items() if t and n in t}
    assert len(found) == len(expected) and {(r.needle, r.doc_id) for r in found} == expected


def test_batches_are_scored_by_documents_whatever_queries_share(spark, tmp_path, monkeypatch):
    for name, value in (("CELLS", 900), ("AT_ONCE", 300)):
        monkeypatch.setattr(postings, name, value)
    rng = random.Random(6)
    word = lambda: f"w{min(int(rng.expovariate(0.08)), 90)}"
    texts = {d: (word(), " ".join(word() for _ in range(rng.randrange(40)))) for d in range(500)}
    texts |= {d: texts[d % 500] for d in range(500, 700)} | {700: (None, None)}  # ties
    docs = spark.createDataFrame([(d, *t) for d, t in texts.items()], SCHEMA)
    asked = spark.createDataFrame([(q, " ".join(word() for _ in range(rng.randint(1, 5)))) for q in range(60)] + [(60, "w1 absent"), (61, "w2 w2"), (62, "w3 ..."), (63, "absent")], "query_id long, query string")
    index = PostingsIndex(spark, f"{tmp_path}/i", list(WEIGHTS), buckets=3)
    index.add(docs)
    assert rows(index.match(asked, WEIGHTS, k=7)) == rows(search.match(docs, asked, WEIGHTS, k=7))
    hits, lengths = search.phrase_hits(search.postings(docs, list(WEIGHTS)), search.query_phrases(asked), WEIGHTS), search.document_lengths(docs, list(WEIGHTS))
    scores = lambda df: sorted((r.query_id, r.n_terms, r.doc_id, r.n_hit, round(r.b, 9)) for r in df.collect())
    expected = scores(search.bm25(hits, lengths))
    found = index.score(search.query_phrases(asked), WEIGHTS)
    assert scores(found) == expected
    # Many queries share few terms: what is shuffled are the postings of the terms, and not the hits of all queries.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = index.score(search.query_phrases(asked), WEIGHTS)
        found.collect()
        assert shuffled(found) < len(expected) / 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def shuffled(df):
    """Rows that the plan's exchanges wrote, broadcasts apart."""
    def walk(node):
        own = [node.metrics().apply("shuffleRecordsWritten").value()] if node.metrics().contains("shuffleRecordsWritten") else []
        return own + [n for i in range(node.children().size()) for n in walk(node.children().apply(i))]

    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_occurrences_are_grouped_before_they_are_shuffled(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(postings, "GROUPED", 7)
    docs = [(1, ["a", "b", "a"], ["a"]), (2, [], []), (3, ["c"] * 9, ["b", "c"]), (4, [], ["a", "b"])]
    lists = pa.list_(pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs], lists), pa.array([d[2] for d in docs], lists)], names=["doc_id", "terms0", "terms1"])
    found = [r for b in postings._grouped(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    expected = {(d, f, t): [i for i, x in enumerate(words) if x == t] for d, *fields in docs for f, words in enumerate(fields) for t in words}
    assert len(found) == len(expected) == 8 and {(r["doc_id"], r["field"], r["term"]): r["positions"] for r in found} == expected
    assert {r["doc_id"]: r["length"] for r in found} == {1: 4, 3: 11, 4: 2}
    assert sorted((r["doc_id"], r["term"]) for r in found if r["first"]) == sorted({(d, t) for d, _, t in expected})
    # The dictionary: groups that go on in the next batch are one row.
    rows = [(0, "a", 1, 1, 5, 2, 0), (0, "a", 1, 0, 5, 0, 3), (0, "a", 1, 1, 4, 1, 0), (0, "a", 2, 1, 9, 1, 0), (0, "b", 2, 1, 9, 0, 7)]
    names, types = ["bucket", "term", "range", "n_docs", "min_length", "tf0", "tf1"], [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k]], t) for k, t in enumerate(types)], names=names) for r in rows]
    blocks = [tuple(r.values()) for b in postings._blocks(iter(batches)) for r in b.to_pylist()]
    assert blocks == [(0, "a", 1, 2, 4, 2, 3), (0, "a", 2, 1, 9, 1, 0), (0, "b", 2, 1, 9, 0, 7)]


def test_phrases_are_found_by_documents_whatever_queries_share(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "AT_ONCE", 200)
    rng = random.Random(8)
    word = lambda: f"w{min(int(rng.expovariate(0.5)), 9)}"
    docs = spark.createDataFrame([(d, " ".join(word() for _ in range(rng.randrange(4))), " ".join(word() for _ in range(rng.randrange(60)))) for d in range(150)] + [(150, None, None)], SCHEMA)
    asked = spark.createDataFrame([(q, " ".join("-".join(word() for _ in range(rng.randint(1, 4))) for _ in range(2))) for q in range(40)] + [(40, "w1-absent"), (41, "w0-w0-w0"), (42, "w1-w2 w1-w2")], "query_id long, query string")
    index = PostingsIndex(spark, f"{tmp_path}/i", list(WEIGHTS), buckets=2)
    index.add(docs)
    found = lambda df: sorted((r.query_id, r.n_terms, r.term_no, r.doc_id, r.tf) for r in df.collect())
    expected = found(search.phrase_hits(search.postings(docs, list(WEIGHTS)), search.query_phrases(asked), WEIGHTS))
    assert len(expected) > 1_000 and found(index.hits(search.query_phrases(asked), WEIGHTS)) == expected
    # What is shuffled are the postings of the terms, once, and not their positions for each phrase.
    long = search.query_phrases(asked).where("phrase_len > 1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hits = index.hits(long, WEIGHTS)
        hits.collect()
        assert shuffled(hits) <= 2 * index._postings(None).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_runs_of_characters_are_not_shuffled_for_few_needles(spark, tmp_path):
    docs = spark.createDataFrame([(d, "", f"word{d}x other{d % 7} more{d}") for d in range(300)], SCHEMA)
    index = PostingsIndex(spark, f"{tmp_path}/i", ["text"], buckets=2)
    index.add(docs)
    of = lambda texts: sorted((r.needle, r.doc_id) for r in substrings.containing(index, docs, spark.createDataFrame([(t,) for t in texts], "needle string")).collect())
    assert of(["word7x other0 more7", "x other3 more1"]) == [("word7x other0 more7", 7), *(("x other3 more1", d) for d in (10, 17, 101, 108, 115, 122, 129, 136, 143, 150, 157, 164, 171, 178, 185, 192, 199) if d % 7 == 3 and str(d).startswith("1"))]
    assert not index._written(f"{index.root}/{index.segments()[0]}/grams")  # whole terms need none
    assert of(["ord25x", "rd25"]) == [("ord25x", 25), *(("rd25", d) for d in (25, *range(250, 260)))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        words = substrings._words_with(index, spark.createDataFrame([("ord25x", "ord25x")], "needle string, part string"))
        assert [r.term for r in words.collect()] == ["word25x"] and shuffled(words) < index.grams().count() / 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stems_are_scored_by_documents(spark, tmp_path, monkeypatch):
    for name, value in (("CELLS", 900), ("AT_ONCE", 300)):
        monkeypatch.setattr(postings, name, value)
    rng = random.Random(12)
    word = lambda: rng.choice(("power", "sync", "model", "graph", "index", "float")) + rng.choice(("", "s", "ed", "ing", "er")) if rng.random() < 0.4 else f"w{rng.randrange(300)}"
    texts = {d: (word(), " ".join(word() for _ in range(rng.randrange(40)))) for d in range(300)}
    texts |= {d: texts[d % 300] for d in range(300, 420)} | {420: (None, None)}  # ties
    docs = spark.createDataFrame([(d, *t) for d, t in texts.items()], SCHEMA)
    asked = spark.createDataFrame([(q, " ".join(word() for _ in range(rng.randint(1, 5)))) for q in range(40)] + [(40, "powers power"), (41, "syncing absent"), (42, "models ..."), (43, "absent")], "query_id long, query string")
    index = PostingsIndex(spark, f"{tmp_path}/i", list(WEIGHTS), buckets=3)
    index.add(docs)
    monkeypatch.setattr(PostingsIndex, "_hits", lambda *a: pytest.fail("hits of all queries are shuffled"))
    assert rows(index.match(asked, WEIGHTS, k=7, stem=True)) == rows(search.match(docs, asked, WEIGHTS, k=7, stem=True))


def test_postings_of_many_terms_are_not_shuffled_for_needles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "PUSHED_TERMS", 1)
    docs = spark.createDataFrame([(d, "", " ".join(f"a{d}b{i}" for i in range(40)) + f" word{d}x") for d in range(60)], SCHEMA)
    index = PostingsIndex(spark, f"{tmp_path}/i", ["text"], buckets=2)
    index.add(docs)
    needles = spark.createDataFrame([("ord5",), ("ord17x",)], "needle string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = substrings.containing(index, docs, needles)
        assert sorted((r.needle, r.doc_id) for r in found.collect()) == [("ord17x", 17), *(("ord5", d) for d in (5, *range(50, 60)))]
        assert shuffled(found) < index._postings(None).count() / 4
        monkeypatch.setattr(search, "BROADCAST_ROWS", 0)  # more of them: by a shuffle, without a sort
        many = substrings.containing(index, docs, needles)
        assert sorted(many.collect()) == sorted(found.collect()) and "ShuffledHashJoin" in many._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
