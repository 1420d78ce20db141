"""Which texts contain which strings, through a kept index: few texts are read, and each of those is tested.

A needle of three index terms or more has whole terms of a text within it: the rarest of them gives the candidates. One of
one or two terms may lie within words: its longest term is cut into runs of three characters, the rarest of these are
intersected over the vocabulary (which grows far more slowly than the texts), and the words that do contain it give the
candidates. The runs of needles are counted and broadcast, so that those of the vocabulary are read and not shuffled.
What has no term of three characters is tested against all texts, a block of needles at a time.

Defined results: texts are compared as they are, with case and marks; null texts contain nothing; null and empty needles
are left out, repeated ones count once; each pair is given once. The index must hold ``text`` of the same documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkfield.functions.text import index_terms
from larkfield.operators import search
from larkfield.operators.postings import GRAM, PostingsIndex, grams_of
from larkfield.operators.search import _small

#: Grams intersected for a needle, and needles tested against all texts at once.
RAREST, BLOCK = 3, 500
#: Letters whose lower case depends on what stands beside them.
BY_PLACE = "[Σσς]"


def containing(index: PostingsIndex, docs: DataFrame, needles: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(needle, id) for needles(needle) and the documents of ``index``."""
    wanted = needles.select("needle").where("needle <> ''").distinct()
    parts = wanted.withColumn("parts", index_terms(F.col("needle")))
    longest = F.array_max(F.transform("parts", lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    parts = parts.withColumn("longest", F.when(~F.col("needle").rlike(BY_PLACE), longest))
    inner = (F.size("parts") > 2) & ~F.col("needle").rlike(BY_PLACE)
    within = ~inner & (F.col("longest.n") >= GRAM)

    whole = parts.where(inner).select("needle", F.explode(F.array_distinct(F.expr("slice(parts, 2, size(parts) - 2)"))).alias("term"))
    counted = whole.join(index.words(index.few(whole)), "term", "left").groupBy("needle").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    terms = index._aside(counted.unionByName(_words_with(index, parts.where(within).select("needle", F.col("longest.p").alias("part")))))
    postings = index._postings(index.few(terms)).where(F.col("field") == text).select("term", "doc_id")
    # Words that hold a short needle may be a million: tables of them by part of the terms, so that postings are not sorted.
    few = terms.limit(search.BROADCAST_ROWS + 1).count() <= search.BROADCAST_ROWS
    found = postings.join(terms.hint("broadcast" if few else "shuffle_hash"), "term").groupBy(F.col("doc_id").alias(id_column)).agg(F.collect_set("needle").alias("needles"))
    tested = docs.select(id_column, text).join(found, id_column).select(id_column, F.explode(F.filter("needles", lambda n: F.col(text).contains(n))).alias("needle"))

    rest = parts.where(~inner & ~F.coalesce(within, F.lit(False)))
    blocks = rest.groupBy(F.pmod(F.xxhash64("needle"), F.lit(max(1, -(-rest.count() // BLOCK)))).alias("block")).agg(F.collect_list("needle").alias("needles")).select("needles")
    scanned = docs.select(id_column, text).crossJoin(F.broadcast(blocks)).select(id_column, F.explode(F.filter("needles", lambda n: F.col(text).contains(n))).alias("needle"))
    return tested.unionByName(scanned).select("needle", id_column).distinct()


def _words_with(index: PostingsIndex, parts: DataFrame) -> DataFrame:
    """(needle, term): the terms of the index that contain the part of each needle."""
    cut = index._aside(parts.select("needle", "part", F.explode(grams_of(F.col("part"))).alias("gram")))
    if cut.isEmpty():
        return parts.select("needle", F.col("part").alias("term"))
    grams = index.grams()
    counted = grams.join(_small(cut.select("gram").distinct()), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    order = W.partitionBy("needle").orderBy(F.coalesce("n", F.lit(0)), "gram")
    rare = cut.join(counted, "gram", "left").withColumn("no", F.row_number().over(order)).where(F.col("no") <= RAREST)
    asked = rare.withColumn("asked", F.count("*").over(W.partitionBy("needle"))).select("needle", "part", "gram", "asked")
    met = grams.join(_small(index._aside(asked)), "gram").groupBy("needle", "part", "term", "asked").agg(F.count("*").alias("met"))
    return met.where((F.col("met") == F.col("asked")) & F.col("term").contains(F.col("part"))).select("needle", "term")
