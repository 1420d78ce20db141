import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from larkfield.llm import decontaminate, line_quality, queries, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_pipeline_by_stages(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = line_quality.line_model()
    good = {i: t for i, t in docs.items() if line_quality.judge(t, model)[-1]}
    sets = {i: set(simhash.shingle_set(t).tolist()) for i, t in good.items()}
    bits = {i: simhash.simhash(t) % 2**64 for i, t in good.items()}
    index = decontaminate.SeedIndex([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and set(ids) <= good.keys()
    for i in ids:
        assert not index.overlaps(docs[i])
        assert not any(i > j and ((bits[i] ^ bits[j]).bit_count() <= 2 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for j in ids)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(corpus_pipeline.SHARDS)) <= 1


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries_run(spark, name):
    df = queries.queries()[name](spark, SF)
    n = {"op2_url_filter": 50, "op7_html_extract": 50, "op1_substring_dedup": None, "op4_decontaminate": None, "op11_packing": None}.get(name, 200)
    rows = df.collect()
    assert n is None or len(rows) == n
    if name in ("op9_quality", "op10_toxicity"):
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "op11_packing":  # pieces of a document follow one another and hold it whole
        ends = {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            assert r.start == ends.get(r.doc_id, 0)
            ends[r.doc_id] = r.start + r.length
        assert len(ends) == 200 and ends == {r.doc_id: r.doc_tokens for r in rows}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    rows = queries.queries()[name](spark, SF).select(*names).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, result.fetchall()))
