"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.llm.common import Stored, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkfield.llm.substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkfield.llm.url_filter import fit_urls, judge_urls, labelled_urls

    model = fit_urls(labelled_urls(spark))
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), model).drop("url")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkfield.llm.mixing import describe, draw

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return draw(Stored(describe(docs).drop("text", "source", "lang")).df).select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"),
        "n_tokens", "probability", "sampled",
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, each with the items it contains."""
    from larkfield.llm.decontaminate import overlaps

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return overlaps(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: counts differ by one at most."""
    from larkfield.llm.sharding import shard

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = shard(docs, 16, ties=("size", "text_crc32"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkfield.llm.line_quality import line_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_quality(docs).drop("text")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkfield.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkfield.llm.simhash import near_duplicates

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hexed = F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0")
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkfield.llm import labelled, quality_nbsvm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_nbsvm.train(docs, table(spark, sf_dir, "labels"), labelled.fold("doc_id", 5) != 0)
    out = quality_nbsvm.score_quality(docs, model)
    return out.select("doc_id", (labelled.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkfield.llm import labelled, toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), labelled.fold("doc_id", 3) != 1)
    out = toxicity.score_toxicity(docs, model)
    held_out = (labelled.fold("doc_id", 3) == 1).alias("held_out")
    return out.select("doc_id", held_out, "score", "predicted", "abuse", "misspelled", "quoted", "aimed")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from larkfield.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkfield.llm.importance import resample

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text")).drop("n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_substring_dedup, op2_url_filter, op3_mixing, op4_decontaminate, op5_sharding, op6_line_quality, op7_html_extract, op8_simhash, op9_quality, op10_toxicity, op11_packing,
        op12_importance,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """SQL can state the sharding and the resampling; the other queries fit models, tokenise, hash by XXH64 or search
    tolerantly, and are tested by brute force."""
    from larkfield.llm import importance, sharding

    return {"op5_sharding": sharding.oracle(), "op12_importance": importance.oracle()}
