"""Keeps a full-text index of a growing collection of documents current.

    python -m jobs.index_documents --documents PATH --output PATH --checkpoint PATH [--config jobs/index_documents.json]

A run takes the Parquet files of ``documents`` (doc_id, text, further columns) that came since the last one, leaves out
documents whose text is what the index holds already, and writes for each batch of files its documents, its postings and
its words:

    OUTPUT/documents/batch=N/            doc_id, content_hash, n_terms, lang
    OUTPUT/postings/batch=N/bucket=B/    term, doc_id, tf
    OUTPUT/words/batch=N/                term, df, max_tf

Files are told apart by the stream's checkpoint. A batch that is played again after a failure compares with the batches
before it and replaces its own partitions, so it gives the same rows; a run without new files writes nothing. Readers take
the last batch of each document (``current``). A document is what has one ``doc_id``: of several rows of one batch the one of
the greatest hash stays; rows without an id cannot be found again and are left out, null texts are indexed as empty. The
log tells what was read, unchanged and written.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line_session, ensure, logger, own_folder, settings
from larkfield.functions.text import MARKED, PLAIN, index_terms
from larkfield.operators import postings as kept
from larkfield.streaming.event_log import file_stream

NAME = "job1_index_documents"
LOG = logger("index_documents")
DOCUMENTS = "doc_id long, content_hash string, n_terms long, lang string, batch long"
POSTINGS = "term string, doc_id long, tf long, batch long, bucket int"
WORDS = "term string, df long, max_tf long, batch long"

#: Documents whose words of one bucket a task sorts.
TASK_DOCUMENTS = 50_000


@dataclass(frozen=True)
class Settings:
    #: Buckets of the postings of a batch, by term.
    buckets: int = 16
    files_per_batch: int = 1_000


def current(documents: DataFrame) -> DataFrame:
    """The last state of each document."""
    return documents.groupBy("doc_id").agg(F.max_by(F.struct(*documents.columns), "batch").alias("d")).select("d.*")


def fresh(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text, lang, content_hash) of the documents of a batch whose text the index does not hold."""
    lang = F.col("lang") if "lang" in rows.columns else F.lit(None).cast("string")
    named = rows.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    hashed = named.withColumn("content_hash", F.sha2("text", 256))
    # Unchanged texts go before anything is shuffled but ids and hashes.
    new = hashed.join(known.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")
    return new.groupBy("doc_id").agg(F.max_by(F.struct("text", "lang", "content_hash"), "content_hash").alias("d")).select("doc_id", "d.*")


def index_batch(spark: SparkSession, rows: DataFrame, number: int, output: str, options: Settings) -> dict[str, int]:
    """Writes the partitions of one batch, and counts what it did."""
    before = current(spark.read.schema(DOCUMENTS).parquet(f"{output}/documents").where(F.col("batch") < number))
    new = fresh(rows, before).withColumn("terms", index_terms(F.col("text")))
    documents = new.select("doc_id", "content_hash", F.size("terms").cast("long").alias("n_terms"), "lang", F.lit(number).alias("batch"))

    def replace(df: DataFrame, name: str, *parts: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *parts).parquet(f"{output}/{name}")

    # A document has one row here, so its words are counted beside it and no task groups those of others.
    found = new.select("doc_id", "terms").mapInArrow(kept._grouped, "doc_id long, length long, field byte, first boolean, term string, positions array<int>")
    bucket = F.pmod(F.xxhash64("term"), F.lit(options.buckets)).cast("int")
    # A bucket is dealt to several tasks, as a frequent word may hold a good part of it; a task sorts words of so many documents.
    n_rows = rows.count()
    parts = max(4, -(-n_rows // TASK_DOCUMENTS))
    postings = found.select("term", "doc_id", F.size("positions").cast("long").alias("tf"), F.lit(number).alias("batch"), bucket.alias("bucket"))
    postings = postings.repartition(options.buckets * parts, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    replace(postings.sortWithinPartitions("bucket", "term", "doc_id"), "postings", "bucket")
    written = spark.read.schema(POSTINGS).parquet(f"{output}/postings").where(F.col("batch") == number)
    replace(written.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf")).withColumn("batch", F.lit(number)), "words")
    replace(documents, "documents")  # last: what it names is written
    count = lambda name, schema: spark.read.schema(schema).parquet(f"{output}/{name}").where(F.col("batch") == number).count()
    return {"rows": n_rows, "documents": count("documents", DOCUMENTS), "postings": written.count(), "words": count("words", WORDS)}


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, options: Settings = Settings()) -> list[dict[str, int]]:
    """Indexes what is new; gives the counts of each batch (none if nothing came)."""
    for name, schema in (("documents", DOCUMENTS), ("postings", POSTINGS), ("words", WORDS)):
        ensure(spark, f"{output}/{name}", schema, "batch")
    done: list[dict[str, int]] = []

    def take(rows: DataFrame, number: int) -> None:
        counts = {"batch": number, **index_batch(spark, rows, number, output, options)}
        LOG.info("batch %(batch)d: read %(rows)d rows, indexed %(documents)d documents, wrote %(postings)d postings of %(words)d words", counts)
        done.append(counts)

    LOG.info("reading %s, writing %s", documents, output)
    source = file_stream(spark, documents, options.files_per_batch)
    source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    LOG.info("%d batches: %d rows read, %d documents indexed", len(done), sum(d["rows"] for d in done), sum(d["documents"] for d in done))
    return done


def read_postings(spark: SparkSession, output: str) -> DataFrame:
    """(term, doc_id, tf, n_terms, lang) of the documents as they are now."""
    documents = current(spark.read.schema(DOCUMENTS).parquet(f"{output}/documents"))
    return spark.read.schema(POSTINGS).parquet(f"{output}/postings").join(documents, ["doc_id", "batch"]).select("term", "doc_id", "tf", "n_terms", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over ``documents``, twice: the second run finds nothing new."""
    folder = own_folder(spark, NAME)
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint")
    return read_postings(spark, f"{folder}/output")


_TERMS = f"list_filter(string_split_regex(translate(lower(coalesce(text, '')), '{MARKED}', '{PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
SQL = f"""WITH d AS (SELECT doc_id, lang, {_TERMS} AS terms FROM documents WHERE doc_id IS NOT NULL),
    t AS (SELECT doc_id, lang, len(terms) AS n_terms, unnest(terms) AS term FROM d)
    SELECT term, doc_id, count(*) AS tf, CAST(any_value(n_terms) AS BIGINT) AS n_terms, any_value(lang) AS lang FROM t GROUP BY term, doc_id"""


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    given = parser.parse_args()
    spark = command_line_session("index_documents")
    try:
        run(spark, given.documents, given.output, given.checkpoint, settings(spark, Settings, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
