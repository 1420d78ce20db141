"""Retrieval quality: hits of ranked results against expectations, and an unranked text-scan baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.functions.text import white_space_tokens
from larkfield.operators import substrings
from larkfield.operators.postings import PostingsIndex


def _any_match(path: Column, expect: Column) -> Column:
    return F.exists(expect, lambda e: path.contains(e) | e.contains(path))


def judge(results: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, hit1, hitk): cases test, in this order, a suffix the first must not have, a prefix, a part, a list."""
    listed = results.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))
    rows = cases.join(listed, "query_id", "left")
    top, paths = F.col("paths")[0], F.col("paths")

    def first_and_any(test) -> tuple[Column, Column]:
        return test(top), F.exists(paths, test)

    suffix = ~top.endswith(F.col("expect_not_suffix"))
    prefix = first_and_any(lambda p: p.startswith(F.col("expect_prefix")))
    part = first_and_any(lambda p: p.contains(F.col("expect_contains")))
    same = first_and_any(lambda p: _any_match(p, F.col("expect")))
    out = {}
    for i, name in enumerate(("hit1", "hitk")):
        made = F.when(F.col("expect_not_suffix").isNotNull(), suffix).when(F.col("expect_prefix").isNotNull(), prefix[i])
        made = made.when(F.col("expect_contains").isNotNull(), part[i]).when(F.col("expect").isNotNull(), same[i])
        out[name] = F.coalesce(made, F.lit(False))
    return rows.select("query_id", *[c.alias(n) for n, c in out.items()])


def scan_token(query: Column) -> Column:
    """The first token of over three characters."""
    return F.get(F.filter(white_space_tokens(query), lambda t: F.length(t) > 3), F.lit(0))


def scan_baseline(index: PostingsIndex, docs: DataFrame, queries: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, n_candidates): documents that contain the scanned token, for a stated set of queries."""
    asked = queries.select("query_id", scan_token(F.col("query")).alias("token")).where("token is not null")
    hits = substrings.containing(index, docs, asked.withColumnRenamed("token", "needle"), id_column, text)
    counted = hits.groupBy(F.col("needle").alias("token")).agg(F.count_distinct(id_column).alias("n_candidates"))
    return asked.join(counted, "token", "left").select("query_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def totals(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("n"), F.avg(F.col("hit1").cast("double")).alias("hit_at_1"), F.avg(F.col("hitk").cast("double")).alias("hit_at_k"))
