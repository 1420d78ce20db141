"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkfield.llm import decontaminate, html_extract, line_quality, mixing, quality_nbsvm, sharding, simhash, substring_dedup, toxicity, url_filter

LONG = " ".join(f"word{i % 7000}" for i in range(120_000))
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"
ROWS = [
    (1, "plain words of a text that is long enough to pass for an ordinary document, with twenty words or more in it, truly.", "s", "en", 10),
    (1, "plain words of a text that is long enough to pass for an ordinary document, with twenty words or more in it, truly.", "s", "en", 10),
    (2, None, None, None, None), (3, "", "s", None, 0), (None, "no id here", None, "en", 1), (4, LONG, "t", "de", 5), (5, LONG, "t", "de", 5), (6, " \n\t ", "s", "fr", 2),
    (7, "a\0b \u2028 \ud7ff é", "s", "en", 3), (None, None, None, None, None),
]
CLASHES = (
    "score predicted shard slot row_number kept n_words word_chars base_failed content_share fingerprint_bits component_id probability sampled n_tokens host path rule "
    "verdict risk label id h a b leaf value text_key node component first_id n abuse quoted body key side"
).split()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "some benchmark item of quite a few words in a row for a test"), (2, None), (None, "short"), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def models(spark):
    docs = spark.createDataFrame([(i, "bad $$$ ###" if i % 2 else "good words here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(40)] + [(None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    return {
        "quality": quality_nbsvm.train(docs, labels, F.lit(True)), "toxic": toxicity.train(docs, labels, F.lit(True)),
        "url": url_filter.fit_urls(url_filter.labelled_urls(spark, 400), rounds=2),
    }


def operators(bench, models):
    return {
        "passages": substring_dedup.repeated_passages, "mix": mixing.mix, "overlaps": lambda d: decontaminate.overlaps(d, bench), "clean": lambda d: decontaminate.clean(d, bench),
        "shard": lambda d: sharding.shard(d, 4, ties=("text",)), "lines": line_quality.line_quality, "near": simhash.near_duplicates, "keep_one": simhash.keep_one,
        "similar": simhash.keep_one_similar, "quality": lambda d: quality_nbsvm.score_quality(d, models["quality"]), "toxic": lambda d: toxicity.score_toxicity(d, models["toxic"]),
        "html": lambda d: html_extract.extract(d.withColumnRenamed("text", "html")), "url": lambda d: url_filter.judge_urls(d.withColumnRenamed("text", "url"), models["url"]),
    }


NAMES = ["passages", "mix", "overlaps", "clean", "shard", "lines", "near", "keep_one", "similar", "quality", "toxic", "html", "url"]
#: How many rows come out of ROWS, where not as many as went in. ``keep_one``: blank texts (2, 3, 6 and the last) are one
#: group, as are both rows of 1 and the long texts 4 and 5; 7 and the text without id stand alone.
COUNTS = {"passages": 1, "overlaps": 0, "keep_one": 5, "similar": None}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, bench, models, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = operators(bench, models)[name](docs).collect()
    if name == "similar":
        assert {r.doc_id for r in rows} == {1, 2, 3, None, 4, 6, 7}
    else:
        assert len(rows) == COUNTS.get(name, len(ROWS))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, bench, models, name):
    assert operators(bench, models)[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(spark, bench, models, name):
    docs = spark.createDataFrame(ROWS[:4], SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})
    operators(bench, models)[name](docs).collect()


@pytest.mark.parametrize("step", range(5))
def test_stages(spark, step, tmp_path):
    spark.createDataFrame([(1, "one benchmark item of some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[step]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for frame in (docs, docs.limit(0), docs.limit(4).withColumns({c: F.lit("x") for c in CLASHES})):
        out = stage(spark, frame, str(tmp_path))
        assert out.columns[: len(frame.columns)] == frame.columns
        out.collect()
    if name == "sharding":
        assert out.columns[len(frame.columns) :] == ["shard_", "slot_"]
    if name == "quality_rules":
        assert {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()} == {1}


def test_defined_values_of_odd_rows(spark, bench, models):
    """What null, empty and blank texts, null ids and repeated rows give, operator by operator."""
    docs = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], i) for i, r in enumerate(ROWS)], SCHEMA + ", row long")
    at = {name: {r.row: r for r in f(docs).collect()} for name, f in operators(bench, models).items() if name in ("mix", "shard", "lines", "quality", "toxic", "html", "url", "keep_one")}
    blank = (2, 3, 7, 9)  # null, empty, white space, null with null id
    for i in blank:
        assert (at["lines"][i].n_words, at["lines"][i].base_failed, at["lines"][i].kept) == (0, True, False)
        assert (at["mix"][i].n_tokens, at["mix"][i].mix_topic) == (0, "(none)")
        assert at["quality"][i].score == at["quality"][3].score and at["toxic"][i].score == at["toxic"][3].score
        assert at["html"][i].text == "" and at["html"][i].n_chars == 0
        assert (at["url"][i].host, at["url"][i].path, at["url"][i].rule) == ("", "", None)
    for name in ("lines", "quality", "toxic", "html"):  # repeated rows alike
        assert at[name][0].asDict() | {"row": 0} == at[name][1].asDict() | {"row": 0}
    places = {(r.shard, r.slot) for r in at["shard"].values()}
    assert len(places) == len(ROWS)
    assert at["lines"][5].n_words == 120_000 and at["mix"][5].n_tokens == 120_000  # long texts are read whole
    near = simhash.near_duplicates(spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string")).collect()
    zero = [r for r in near if r.fingerprint_bits == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2}
    assert {r.component_id for r in near if r.doc_id in (4, 5)} == {4} and {r.component_id for r in near if r.doc_id == 1} == {1}


def test_tied_rows_share_their_fate(spark, bench, models):
    rows = [(5, "the same words again and again, enough of them to be judged in earnest by each of the operators here.", "s", "en", 3)] * 6
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("mix", "lines", "quality", "toxic", "html", "url", "near"):
        made = [r.asDict() for r in operators(bench, models)[name](docs).collect()]
        assert len(made) == 6 and all(r == made[0] for r in made), name
    assert sorted((r.shard, r.slot) for r in sharding.shard(docs, 4).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (3, 0)]
    assert simhash.keep_one(docs).count() == 1 and decontaminate.clean(docs, bench).count() == 6


def test_tokens_of_mixing_are_counted_beside_the_topics(spark):
    """One pass over the texts counts words and finds topics; words end at ASCII white space alone."""
    import re

    from larkfield.llm.mixing import describe

    texts = ["a b  c", "", None, " \t\n\x0b\x0c\r ", "a b c d", "x\x1cy\x1fz\x85w", "café 日本 \U0001f600", "a\x00b c\n"]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    made = describe(docs)
    assert {r.doc_id: r.n_tokens for r in made.collect()} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert "regexp_count" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
