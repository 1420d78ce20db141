"""Full-text search: positional postings, phrases, BM25 over weighted fields, fusion with other signals.

Queries come as a frame (query_id, query), so that any number of them shares one scan of the postings. Query terms are
few and are broadcast only after being counted; postings of other terms are dropped by that join before any shuffle.
Sides derived from the postings carry no hint: counting them would scan the postings again, so AQE decides by size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkfield.functions import ranking as R
from larkfield.functions.stem import stemmed
from larkfield.functions.text import identifier_like, index_terms, white_space_tokens

#: At most so many rows of queries or of their candidates are broadcast.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def postings(docs: DataFrame, fields: list[str], id_column: str = "doc_id", stem: bool = False) -> DataFrame:
    """(doc_id, field, term, pos): a row for each occurrence."""
    named = [F.struct(F.lit(f).alias("field"), index_terms(F.coalesce(F.col(f), F.lit(""))).alias("terms")) for f in fields]
    rows = docs.select(F.col(id_column).alias("doc_id"), F.explode(F.array(*named)).alias("f"))
    out = rows.select("doc_id", "f.field", F.posexplode("f.terms").alias("pos", "term"))
    return stem_column(out) if stem else out


def stem_column(df: DataFrame, column: str = "term") -> DataFrame:
    """Stems a column through its distinct values, so that the Python function sees each term once."""
    table = df.select(column).distinct().withColumn("__stem", stemmed(F.col(column)))
    return df.join(table, column).withColumn(column, F.col("__stem")).drop("__stem")


def stemmed_postings(docs: DataFrame, fields: list[str], phrases: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Postings of the terms whose stem the phrases ask for, under that stem.

    The distinct terms are stemmed once and cut to the stems asked for; what remains is counted and broadcast, so that
    all other postings go before any shuffle.
    """
    raw = postings(docs, fields, id_column)
    asked = phrases.where("term is not null").select(F.col("term").alias("stem")).distinct()
    words = raw.select("term").distinct().withColumn("stem", stemmed(F.col("term"))).join(_small(asked), "stem")
    return raw.join(_small(words), "term").drop("term").withColumnRenamed("stem", "term")


def document_lengths(docs: DataFrame, fields: list[str], id_column: str = "doc_id") -> DataFrame:
    """(doc_id, length): the terms of all fields, counted in the scan."""
    size = sum((F.size(index_terms(F.coalesce(F.col(f), F.lit("")))) for f in fields), F.lit(0))
    return docs.select(F.col(id_column).alias("doc_id"), size.cast("long").alias("length"))


def query_phrases(queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, term_no, offset, term, phrase_len, n_terms): each white-space token is a phrase of index terms.

    A token without any index term keeps a row with a null term, so that the all-terms test fails for it.
    """
    tokens = queries.select("query_id", white_space_tokens("query").alias("tokens"))
    each = tokens.select("query_id", F.size("tokens").alias("n_terms"), F.posexplode("tokens").alias("term_no", "token"))
    parts = each.withColumn("parts", index_terms(F.col("token")))
    out = parts.select("query_id", "n_terms", "term_no", F.size("parts").alias("phrase_len"), F.posexplode_outer("parts").alias("offset", "term"))
    return stem_column(out) if stem else out


def phrase_hits(postings: DataFrame, phrases: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(query_id, n_terms, term_no, doc_id, tf): occurrences of each phrase in each document, weighted by field."""
    found = postings.join(_small(phrases.where("term is not null")), "term")
    starts = found.groupBy("query_id", "n_terms", "term_no", "phrase_len", "doc_id", "field", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count("*").alias("n"))
    weight = F.lit(0.0)
    for field, w in weights.items():
        weight = F.when(F.col("field") == field, w).otherwise(weight)
    return starts.where("n = phrase_len").groupBy("query_id", "n_terms", "term_no", "doc_id").agg(F.sum(weight).alias("tf"))


def bm25(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """(query_id, n_terms, doc_id, n_hit, b): b is negative, and less is better."""
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    df = hits.groupBy("query_id", "term_no").agg(F.count("*").alias("df"))  # one row for each document and phrase
    each = hits.join(df, ["query_id", "term_no"]).join(lengths, "doc_id").crossJoin(F.broadcast(stats))
    part = R.bm25_term(F.col("tf"), F.col("length"), F.col("mean_length"), F.col("n_docs"), F.col("df"))
    return each.groupBy("query_id", "n_terms", "doc_id").agg(F.count("*").alias("n_hit"), (-F.sum(part)).alias("b"))


def all_or_any(scored: DataFrame) -> DataFrame:
    """Rows with all terms where a query has any such row, else all rows; ``used_or`` tells which."""
    most = scored.groupBy("query_id").agg(F.max(F.col("n_hit") == F.col("n_terms")).alias("has_all"))
    kept = scored.join(most, "query_id").where("n_hit = n_terms or not has_all")
    return kept.withColumn("used_or", ~F.col("has_all")).drop("has_all")


def ranked(scored: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k rows of each group with their rank; row limits go down into the groups' sorts."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def match(docs: DataFrame, queries: DataFrame, weights: Mapping[str, float], k: int = R.CANDIDATES, stem: bool = False, id_column: str = "doc_id") -> DataFrame:
    """(query_id, n_terms, doc_id, n_hit, b, used_or, rank): the best k documents of each query.

    Scores that agree to nine places are ties, so that the order in which parts were summed does not show.
    """
    fields, phrases = list(weights), query_phrases(queries, stem)
    found = stemmed_postings(docs, fields, phrases, id_column) if stem else postings(docs, fields, id_column)
    hits = phrase_hits(found, phrases, weights)
    scored = all_or_any(bm25(hits, document_lengths(docs, fields, id_column)))
    return ranked(scored, k, F.round("b", 9).asc(), F.col("doc_id").asc())


def exact_definitions(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, file_id): files that define a symbol named by an identifier-like token, compared without case."""
    tokens = queries.select("query_id", F.explode(white_space_tokens("query")).alias("token"))
    wanted = tokens.where(identifier_like(F.col("token"))).select("query_id", F.lower("token").alias("name")).distinct()
    named = symbols.select(F.lower("name").alias("name"), "file_id")
    return named.join(_small(wanted), "name").select("query_id", "file_id").distinct()


def locate(
    queries: DataFrame, files: DataFrame, symbols: DataFrame, index: DataFrame, now: int, limit: int = 10,
    weights: R.Weights = R.Weights(), penalty: float = R.TEST_PENALTY, stem: bool = True,
) -> DataFrame:
    """Ranked files for each query with their signals, flags and the verdict of confidence.

    files(file_id, path, lang, commits_30d, last_commit_at), symbols(file_id, name, kind, start_line, end_line) and
    index(file_id, path, symbol_names, keywords, content). Ties end by the text score, then by file_id.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    found = match(index, queries, R.FIELD_WEIGHTS, stem=stem, id_column="file_id")
    fts = found.select("query_id", F.col("doc_id").alias("file_id"), "b", "used_or")
    fallback = queries.select("query_id").join(fts.groupBy("query_id").agg(F.max("used_or").alias("used_or")), "query_id", "left")
    fallback = fallback.select("query_id", F.coalesce("used_or", F.lit(True)).alias("used_or"))
    defs = exact_definitions(queries, symbols).withColumn("is_def", F.lit(True))
    merged = fts.drop("used_or").join(defs, ["query_id", "file_id"], "full_outer")
    terms = queries.select("query_id", white_space_tokens("query").alias("tokens"))
    names = symbols.groupBy("file_id").agg(
        F.collect_set(F.lower("name")).alias("names"),
        F.sort_array(F.collect_list(F.struct("start_line", "end_line", "name", "kind"))).alias("symbols"),
    )
    rows = merged.join(files, "file_id").join(_small(terms), "query_id").join(names, "file_id", "left")
    worst = F.max("b").over(W.partitionBy("query_id"))
    is_def = F.coalesce("is_def", F.lit(False))
    lower = F.transform("tokens", F.lower)
    rows = rows.withColumns({
        "is_def": is_def,
        "fts": F.coalesce(worst - F.col("b"), F.lit(0.0)),
        "path_signal": R.path_match(F.col("tokens"), F.col("path")),
        "symbol_signal": F.when(is_def | F.coalesce(F.arrays_overlap("names", lower), F.lit(False)), 1.0).otherwise(0.0),
        "recency": R.recency_boost(F.col("commits_30d"), F.col("last_commit_at"), now),
        "n_tokens": F.size("tokens"),
    })
    fused = R.fused_score(F.col("fts"), F.col("path_signal"), F.col("symbol_signal"), F.col("recency"), weights)
    rows = rows.withColumn("score", R.penalised(fused, F.col("path"), penalty))
    top = ranked(rows, limit, F.desc("is_def"), F.desc("score"), F.asc_nulls_last("b"), F.asc("file_id"))
    per = W.partitionBy("query_id")
    anchored = F.max(F.when(F.col("rank") == 1, (F.col("symbol_signal") > 0) | (F.col("path_signal") > 0))).over(per)
    top = top.join(fallback, "query_id").withColumns({"has_exact_def": F.max("is_def").over(per), "top_has_anchor": anchored})
    verdict = R.confidence(F.col("has_exact_def"), F.col("used_or"), F.col("n_tokens"), F.col("top_has_anchor"))
    return top.select(
        "query_id", "rank", "file_id", "path", "lang", "score", "fts", "path_signal", "symbol_signal", "recency", "is_def",
        "symbols", "has_exact_def", "used_or", "top_has_anchor", verdict.alias("confidence"),
    )
