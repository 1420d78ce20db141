"""A full-text index that is kept: postings written once, replaced document by document, read by term.

A segment holds the postings of the documents that one call added, in buckets by term and spans of documents, sorted by
term, so that a query opens the files of its terms, skips what lies between them, and no task holds all postings of a
frequent term. A posting carries the length of its document, and its positions in a column of their own, which only phrases
of several terms read. Documents are dealt to ranges by a hash of their id; a segment's dictionary has a row for each term
and range: how many documents there have the term, its largest counts by field, and the least length. So document
frequencies are read and not counted, and a search can tell what a range may score at most without looking at it.
``live`` is the table of documents with the segment that holds each one's last state: replacing or deleting a document
changes that table alone, and ``compact`` merges the segments once there are many. Writers commit by ``SnapshotTable``:
readers see a whole index.

Searches over many postings go range by range (``match``): ranges that hold all terms of a query first, as only they can
hold a document with all of them; for a query without any, the ranges that may score most, then those that may still reach
the k-th score found. That gives the rows of a full scan. It needs an index of one segment without deletions and queries
without phrases of several terms; others are scanned. Batches of more than ``RANGE_QUERIES`` queries are scored document by
document (``_by_documents``): the postings of all their terms are shuffled once, however many queries ask for a term.

Defined results: null texts have no terms but count as documents of length zero; of documents added twice in one call
the rows stay as they are, as one call is expected to hold a document once.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from larkfield.functions import ranking as R
from larkfield.functions.stem import stemmed
from larkfield.functions.text import index_terms
from larkfield.operators import search
from larkfield.operators.snapshot import Conflict, SnapshotTable

#: Number of the way in which segments are laid out.
LAYOUT = 3
#: Buckets of a segment by term, documents of a range, ranges of a span, and rows of a page of a file.
BUCKETS, RANGE_DOCS, SPAN_RANGES, PAGE_ROWS = 32, 64, 1_024, 4_000
#: Terms that become a pushed filter and a list of buckets; more are joined.
PUSHED_TERMS = 2_000
#: Postings of the terms of a batch of queries beyond which it goes range by range, and ranges looked at first then.
SCAN_POSTINGS, FIRST_RANGES = 20_000_000, 16
#: Terms whose wanted ranges are pushed to the files, as so many intervals each.
PUSHED_RANGES, INTERVALS = 32, 16
#: Queries that go range by range at most; terms times queries that are scored document by document, numbers of a matrix
#: of documents, and postings that are scored at once.
RANGE_QUERIES, DENSE, CELLS, AT_ONCE = 16, 4_000_000, 1_000_000, 400_000
#: Occurrences that are grouped by document and term at once.
GROUPED = 400_000


#: Characters of the parts by which words are found that hold a part of a needle.
GRAM = 3


def grams_of(word: Column) -> Column:
    """The distinct runs of ``GRAM`` characters of a word."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - (GRAM - 1)))
    return F.array_distinct(F.transform(at, lambda i: F.substr(word, i, F.lit(GRAM))))


class PostingsIndex:
    """An index over the text ``fields`` of documents, below ``root``."""

    def __init__(self, spark: SparkSession, root: str, fields: list[str], id_column: str = "doc_id", buckets: int = BUCKETS):
        self.spark, self.root, self.fields, self.id_column, self.buckets = spark, root.rstrip("/"), list(fields), id_column, buckets
        self.live = SnapshotTable(spark, f"{self.root}/live")
        self._buckets: dict[str, int] = {}  # of terms asked for before

    # ---- writing ---------------------------------------------------------------------------------

    def add(self, docs: DataFrame) -> None:
        """Adds documents, or replaces those that are there."""
        segment, n_docs = f"s-{uuid.uuid4().hex}", docs.count()
        terms = [index_terms(F.coalesce(F.col(f), F.lit(""))) for f in self.fields]
        rows = docs.select(F.col(self.id_column).alias("doc_id"), *[t.alias(f"terms{i}") for i, t in enumerate(terms)])
        kind = rows.schema["doc_id"].dataType.simpleString()
        found = rows.mapInArrow(_grouped, f"doc_id {kind}, length long, field byte, first boolean, term string, positions array<int>")
        self._write(self._dealt(found, n_docs), segment)
        length = sum((F.size(t) for t in terms), F.lit(0)).cast("long")
        fresh = docs.select(F.col(self.id_column).alias("doc_id"), length.alias("length"), F.lit(segment).alias("segment"))
        old = self.live.read()
        if old is not None:
            fresh = old.join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)
        self._commit(fresh, [*self.segments(), segment])

    def _dealt(self, rows: DataFrame, n_docs: int) -> DataFrame:
        """Postings in the order in which they are written, a task for each bucket and span. What follows from the term and
        the document is made after the shuffle."""
        spans, ranges = max(1, -(-n_docs // (RANGE_DOCS * SPAN_RANGES))), max(1, -(-n_docs // RANGE_DOCS))
        range_ = F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int")
        span = F.floor(range_ / SPAN_RANGES).cast("int")
        out = rows.repartitionById(self.buckets * spans, self._bucket() * spans + span)
        names = F.array(*[F.lit(f) for f in self.fields])
        out = out.select(
            self._bucket().alias("bucket"), span.alias("span"), "term", range_.alias("range"), "doc_id", F.get(names, F.col("field").cast("int")).alias("field"), "length", F.size("positions").alias("tf"), "first", "positions",
        )
        return out.sortWithinPartitions("bucket", "span", "term", "range", "doc_id", "field")

    def _bucket(self):
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _write(self, found: DataFrame, segment: str) -> None:
        """Postings that are dealt and sorted, and the dictionary made from their files, which needs no shuffle: where a
        file is read in parts, a term may have two rows for a range (``blocks`` adds them up)."""
        small = {"parquet.page.row.count.limit": PAGE_ROWS, "parquet.page.size.row.check.min": 100}
        found.write.options(**small).partitionBy("bucket", "span").parquet(f"{self.root}/{segment}/postings")
        rows = self.spark.read.parquet(f"{self.root}/{segment}/postings")
        tops = [F.when(F.col("field") == f, F.col("tf")).otherwise(0).alias(f"tf{i}") for i, f in enumerate(self.fields)]
        blocks = rows.select("bucket", "term", "range", F.col("first").cast("long").alias("n_docs"), F.col("length").alias("min_length"), *tops)
        names = [f"tf{i}" for i in range(len(self.fields))]
        blocks = blocks.mapInArrow(_blocks, f"bucket int, term string, range int, n_docs long, min_length long, {', '.join(f'{n} int' for n in names)}")
        blocks = blocks.select("bucket", "term", "range", "n_docs", F.array(*names).alias("max_tf"), "min_length").sortWithinPartitions("bucket", "term", "range")
        blocks.write.options(**small).partitionBy("bucket").parquet(f"{self.root}/{segment}/blocks")

    def grams(self) -> DataFrame:
        """(gram, term): the runs of three characters of each term of the index, made at their first use."""
        out = None
        for segment in self.segments():
            path = f"{self.root}/{segment}/grams"
            if not self._written(path):
                terms = self.spark.read.parquet(f"{self.root}/{segment}/blocks").select("term").distinct().where(F.length("term") >= GRAM)
                cut = terms.select(F.explode(grams_of(F.col("term"))).alias("gram"), "term")
                cut.write.mode("overwrite").parquet(path)  # as the terms lie: searches read all of it and shuffle none
            part = self.spark.read.parquet(path).select("gram", "term")
            out = part if out is None else out.unionByName(part)
        return out.distinct() if len(self.segments()) > 1 else out

    def stems(self, stems: list[str] | None) -> DataFrame:
        """(stem, term): the terms of the index by their stem, for ``stems`` or all; made at their first use, so that each
        term is stemmed once for all searches."""
        out = None
        for segment in self.segments():
            path = f"{self.root}/{segment}/stems"
            if not self._written(path):
                cut = self.spark.read.parquet(f"{self.root}/{segment}/blocks").select("term").distinct().select(stemmed(F.col("term")).alias("stem"), F.col("term").alias("word"))
                cut = cut.withColumnRenamed("stem", "term").withColumn("bucket", self._bucket())
                cut.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)
            part = self.spark.read.parquet(path)
            part = (part if stems is None else self._of_terms(part, stems)).select(F.col("term").alias("stem"), F.col("word").alias("term"))
            out = part if out is None else out.unionByName(part)
        return out.distinct() if len(self.segments()) > 1 else out

    def _written(self, path: str) -> bool:
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def few(self, rows: DataFrame) -> list[str] | None:
        """The terms of rows(term) if they are few enough to be pushed to the files."""
        found = [r.term for r in rows.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        return sorted(found) if len(found) <= PUSHED_TERMS else None

    def words(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df) of all segments, or those of ``terms``; replaced documents are counted as well, so df is not less
        than what is live."""
        out = None
        for segment in self.segments():
            part = self.spark.read.parquet(f"{self.root}/{segment}/blocks")
            part = (part if terms is None else self._of_terms(part, terms)).select("term", "n_docs")
            out = part if out is None else out.unionByName(part)
        return out.groupBy("term").agg(F.sum("n_docs").alias("df"))

    def delete(self, ids: DataFrame) -> None:
        """Drops the documents in ids(doc_id)."""
        self._commit(self._live().join(ids.select("doc_id").distinct(), "doc_id", "left_anti"), self.segments(), deleted=True)

    def compact(self) -> None:
        """Merges all segments into one that holds live documents only."""
        segment = f"s-{uuid.uuid4().hex}"
        rows = self._postings(None, "positions", "first")
        code = F.array_position(F.array(*[F.lit(f) for f in self.fields]), F.col("field")) - 1
        self._write(self._dealt(rows.select("doc_id", "length", code.cast("byte").alias("field"), "first", "term", "positions"), self.stats()[0]), segment)
        self._commit(self._live().withColumn("segment", F.lit(segment)), [segment], deleted=False)

    def _commit(self, live: DataFrame, segments: list[str], deleted: bool | None = None) -> None:
        seen = Observation()
        live = live.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
        self.live.write(live, meta={"segments": " ".join(segments)} | ({} if deleted is None else {"deleted": "yes" if deleted else ""}), after=lambda: {"stats": f"{seen.get['n']} {seen.get['length'] or 0}"})

    # ---- reading ---------------------------------------------------------------------------------

    def segments(self) -> list[str]:
        return (self.live.get_meta("segments") or "").split()

    def _live(self) -> DataFrame:
        found = self.live.read()
        if found is None:
            raise ValueError(f"nothing is indexed below {self.root}")
        return found

    def stats(self) -> tuple[int, float]:
        """How many documents there are, and their mean length."""
        n, length = map(int, (self.live.get_meta("stats") or "0 0").split())
        return n, length / n if n else 0.0

    def _whole(self) -> bool:
        """One segment that nothing was deleted from: all its postings and its dictionary are those of live documents."""
        return len(self.segments()) == 1 and not self.live.get_meta("deleted")

    def _of_terms(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        new = [t for t in terms if t not in self._buckets]
        if new:
            found = self.spark.createDataFrame([(t,) for t in new], "term string").select("term", self._bucket()).collect()
            kept = self._buckets if len(self._buckets) < search.BROADCAST_ROWS else {t: self._buckets[t] for t in terms if t in self._buckets}
            self._buckets = {**kept, **dict(found)}
        return rows.where(F.col("bucket").isin(sorted({self._buckets[t] for t in terms})) & F.col("term").isin(terms))

    def _postings(self, terms: list[str] | None, *more: str, pushed: Column | None = None) -> DataFrame:
        segments = self.segments()
        columns = ["term", "range", "doc_id", "field", "length", "tf", *more]
        out = None
        for segment in segments:
            part = self.spark.read.parquet(f"{self.root}/{segment}/postings")
            part = part if terms is None else self._of_terms(part, terms)
            part = part if pushed is None else part.where(pushed)
            part = part.select(*columns, F.lit(segment).alias("segment"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError(f"nothing is indexed below {self.root}")
        if not self._whole():
            out = out.join(self._live().select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        return out.drop("segment")

    def blocks(self, terms: list[str]) -> DataFrame:
        """(term, range, n_docs, max_tf, min_length) of the dictionary; ``max_tf`` by field."""
        (segment,) = self.segments()
        rows = self._of_terms(self.spark.read.parquet(f"{self.root}/{segment}/blocks"), terms)
        tops = F.array(*[F.max(F.get("max_tf", F.lit(i))) for i in range(len(self.fields))])
        return rows.groupBy("term", "range").agg(F.sum("n_docs").alias("n_docs"), tops.alias("max_tf"), F.min("min_length").alias("min_length"))

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """How many documents have each of the terms."""
        (segment,) = self.segments()
        rows = self._of_terms(self.spark.read.parquet(f"{self.root}/{segment}/blocks"), terms)
        return {r.term: r.df for r in rows.groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}

    def _asked(self, phrases: DataFrame) -> tuple[DataFrame, list, bool]:
        """The phrases with terms; on the driver as well if they are few."""
        phrases = phrases.where("term is not null").select("query_id", "n_terms", "term_no", "phrase_len", "offset", "term")
        rows = phrases.limit(search.BROADCAST_ROWS + 1).collect()
        few = len(rows) <= search.BROADCAST_ROWS
        return (self.spark.createDataFrame(rows, phrases.schema) if few else phrases), rows, few

    def _weight(self, weights: Mapping[str, float]) -> Column:
        weight = F.lit(0.0)
        for field, w in weights.items():
            weight = F.when(F.col("field") == field, w).otherwise(weight)
        return weight

    def hits(self, phrases: DataFrame, weights: Mapping[str, float]) -> DataFrame:
        """(query_id, n_terms, term_no, doc_id, length, tf) for phrases as ``search.query_phrases`` gives them."""
        return self._hits(*self._asked(phrases), weights)

    def _of_stems(self, stems: list[str] | None, *more: str) -> DataFrame:
        """Postings of all terms of the stems, under the stem."""
        table = self.stems(stems)
        terms = self.few(table) if stems is not None else None
        rows = self._postings(terms, *more).join(search._small(table) if stems is not None else table, "term")
        return rows.drop("term").withColumnRenamed("stem", "term")

    def _hits(self, asked: DataFrame, rows: list, few: bool, weights: Mapping[str, float], stem: bool = False) -> DataFrame:
        hint = F.broadcast if few else (lambda df: df)
        keys = ["query_id", "n_terms", "term_no", "doc_id"]
        total = F.sum(self._weight(weights) * F.col("tf")).alias("tf")

        def terms(long: bool) -> list[str] | None:
            found = sorted({r.term for r in rows if (r.phrase_len > 1) == long})
            return found if few and len(found) <= PUSHED_TERMS else None

        of = self._of_stems if stem else self._postings
        single = of(terms(False)).join(hint(asked.where("phrase_len = 1")), "term")
        out = self._summed(single, weights, stem)
        if few and any(r.phrase_len > 1 for r in rows):
            out = out.unionByName(self._phrases(of(terms(True), "positions"), asked, [r for r in rows if r.phrase_len > 1], weights))
        elif not few:
            places = of(None, "positions").join(asked.where("phrase_len > 1"), "term")
            starts = places.select(*keys, "length", "field", "phrase_len", F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start"))
            whole = starts.groupBy(*keys, "length", "field", "phrase_len", "start").agg(F.count("*").alias("n")).where("n = phrase_len").withColumn("tf", F.lit(1))
            out = out.unionByName(whole.groupBy(*keys, "length").agg(total))
        return out

    def _phrases(self, places: DataFrame, asked: DataFrame, rows: list, weights: Mapping[str, float]) -> DataFrame:
        """Hits of phrases of several terms: the positions of all their terms come together by document, once however many
        phrases ask for a term, and a task looks for the phrases in its documents."""
        parts: dict[tuple, list[tuple]] = {}
        for r in rows:
            parts.setdefault((r.query_id, r.n_terms, r.term_no), []).append((r.offset, r.term))
        code = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        alike: dict[tuple, list[int]] = {}
        for i, p in enumerate(parts.values()):
            alike.setdefault(tuple(sorted((o, code[t]) for o, t in p)), []).append(i)
        shipped = self.spark.sparkContext.broadcast((list(parts), list(alike.items()), len(code), np.array([float(weights.get(f, 0.0)) for f in self.fields])))
        codes = self.spark.createDataFrame(list(code.items()), "term string, code int")
        field = (F.array_position(F.array(*[F.lit(f) for f in self.fields]), F.col("field")) - 1).cast("byte").alias("field")
        found = places.join(F.broadcast(codes), "term").select("doc_id", "length", field, "code", "positions")
        kinds = {c.name: c.dataType.simpleString() for c in (*asked.schema.fields, *found.schema.fields)}
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "n_terms", "term_no", "doc_id", "length")) + ", tf double"

        def search_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, phrases, n_codes, of_field = shipped.value
            names = [pa.array(list(x)) for x in zip(*keys)]
            for table in _whole_documents(batches):
                at, row, tf = _phrase_hits(table, phrases, n_codes, of_field)
                columns = [x.take(pa.array(at)) for x in names] + [table.column(c).combine_chunks().take(pa.array(row)) for c in ("doc_id", "length")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(tf)], names=["query_id", "n_terms", "term_no", "doc_id", "length", "tf"]).cast(target)

        target = to_arrow_schema(_parse_datatype_string(schema))
        return found.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(search_, schema)

    def _summed(self, single: DataFrame, weights: Mapping[str, float], stem: bool = False) -> DataFrame:
        """Hits of terms that are phrases of their own: the fields of a document are added up, and the terms of a stem."""
        keys = ["query_id", "n_terms", "term_no", "doc_id", "length"]
        tf = self._weight(weights) * F.col("tf")
        return single.groupBy(*keys).agg(F.sum(tf).alias("tf")) if stem or len(self.fields) > 1 else single.select(*keys, tf.alias("tf"))

    def _counted(self, hits: DataFrame, rows: list, few: bool, known: Mapping[str, int] | None = None) -> DataFrame:
        """``hits`` with ``df``: from the dictionary for single terms, counted for phrases of several terms."""
        if not (few and self._whole() and len({r.term for r in rows}) <= PUSHED_TERMS):
            counted = hits.groupBy("query_id", "term_no").agg(F.count("*").alias("df"))
            return hits.join(F.broadcast(counted) if few else counted, ["query_id", "term_no"])
        single = {(r.query_id, r.term_no): r.term for r in rows if r.phrase_len == 1}
        if known is None:
            known = self.frequencies(sorted(set(single.values()))) if single else {}
        long = sorted({(r.query_id, r.term_no) for r in rows if r.phrase_len > 1})
        schema = hits.select("query_id", "term_no", F.lit(0).cast("long").alias("df")).schema
        table = self.spark.createDataFrame([(*key, known.get(term, 0)) for key, term in single.items()], schema)
        if long:
            phrases = self.spark.createDataFrame(long, hits.select("query_id", "term_no").schema)
            table = table.unionByName(hits.join(F.broadcast(phrases), ["query_id", "term_no"]).groupBy("query_id", "term_no").agg(F.count("*").alias("df")))
        return hits.join(F.broadcast(table), ["query_id", "term_no"])

    def _parts(self, hits: DataFrame) -> DataFrame:
        """Hits with their df to scores."""
        n, mean = self.stats()
        part = R.bm25_term(F.col("tf"), F.col("length"), F.lit(mean), F.lit(n), F.col("df"))
        return hits.groupBy("query_id", "n_terms", "doc_id").agg(F.count("*").alias("n_hit"), (-F.sum(part)).alias("b"))

    def score(self, phrases: DataFrame, weights: Mapping[str, float]) -> DataFrame:
        """(query_id, n_terms, doc_id, n_hit, b) as ``search.bm25`` gives it."""
        return self._score(*self._asked(phrases), weights)

    def _score(self, asked: DataFrame, rows: list, few: bool, weights: Mapping[str, float], known: Mapping[str, int] | None = None, k: int | None = None) -> DataFrame:
        """All scores, or with ``k`` at least those of the first ``k`` documents of each query."""
        if self._dense(rows, few):
            return self._by_documents(asked, rows, self.frequencies(sorted({r.term for r in rows})) if known is None else known, weights, k)
        return self._parts(self._counted(self._hits(asked, rows, few, weights), rows, few, known))

    def _dense(self, rows: list, few: bool) -> bool:
        """Whether a batch of queries can be scored document by document."""
        n = len({r.term for r in rows})
        return bool(rows) and few and self._whole() and n <= PUSHED_TERMS and n * len({r.query_id for r in rows}) <= DENSE and all(r.phrase_len == 1 for r in rows)

    def match(self, queries: DataFrame, weights: Mapping[str, float], k: int = R.CANDIDATES, stem: bool = False) -> DataFrame:
        """(query_id, n_terms, doc_id, n_hit, b, used_or, rank) as ``search.match`` gives it."""
        asked, rows, few = self._asked(search.query_phrases(queries, stem))
        terms = sorted({r.term for r in rows})
        scored = known = None
        if stem and self._dense(rows, few):
            scored = self._by_documents(asked, rows, None, weights, k, stem)
        elif stem:
            scored = self._parts(self._counted(self._hits(asked, rows, few, weights, stem), [], few=False))
        elif rows and few and self._whole() and len(terms) <= PUSHED_TERMS and all(r.phrase_len == 1 for r in rows):
            known = self.frequencies(terms)
            if sum(known.values()) > SCAN_POSTINGS and len({r.query_id for r in rows}) <= RANGE_QUERIES:
                scored = self._by_ranges(asked, known, weights, k)
        scored = self._score(asked, rows, few, weights, known, k) if scored is None else scored
        scored = scored.withColumn("whole", F.col("n_hit") == F.col("n_terms"))
        # Rows with all terms come first, so the first row of a query tells whether it has any.
        top = search.ranked(scored, k, F.desc("whole"), F.round("b", 9).asc(), F.col("doc_id").asc())
        any_whole = F.max("whole").over(W.partitionBy("query_id"))
        return top.withColumn("used_or", ~any_whole).where(F.col("whole") | F.col("used_or")).select("query_id", "n_terms", "doc_id", "n_hit", "b", "used_or", "rank")

    # ---- document by document ----------------------------------------------------------------------

    def _by_documents(self, asked: DataFrame, rows: list, known: Mapping[str, int] | None, weights: Mapping[str, float], k: int | None, stem: bool = False) -> DataFrame:
        """The postings of all terms come together by document, and a task scores its documents against all queries. Those of
        the terms of a stem are added up there first, and stored, so that documents of a stem are counted without a shuffle."""
        terms = sorted({r.term for r in rows})
        code = {t: i for i, t in enumerate(terms)}
        queries = sorted({(r.query_id, r.n_terms) for r in rows})
        column = {q: i for i, (q, _) in enumerate(queries)}
        times = np.zeros((len(terms), len(queries)))
        for r in rows:
            times[code[r.term], column[r.query_id]] += 1
        codes = self.spark.createDataFrame(list(code.items()), "term string, code int")
        tf = (self._weight(weights) * F.col("tf")).alias("tf")
        found = (self._of_stems(terms) if stem else self._postings(terms)).join(F.broadcast(codes), "term").select("doc_id", "length", "code", tf)
        together = found.repartition("doc_id").sortWithinPartitions("doc_id")
        if stem:
            summed = together.mapInArrow(_summed_documents, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, length long, code array<int>, tf array<double>")
            summed = self._aside(summed)
            known = {terms[r.code]: r["count"] for r in summed.select(F.explode("code").alias("code")).groupBy("code").count().collect()}
            # Files are read in any order; the scorer wants its documents in the order of their ids.
            together = summed.sortWithinPartitions("doc_id").select("doc_id", "length", F.explode(F.arrays_zip("code", "tf")).alias("x")).select("doc_id", "length", "x.code", "x.tf")
        n, mean = self.stats()
        shipped = self.spark.sparkContext.broadcast((queries, times, np.array([known.get(t, 0) for t in terms], dtype=np.float64), n, mean))
        kinds = {c.name: c.dataType.simpleString() for c in (*asked.schema.fields, *found.schema.fields)}
        schema = f"query_id {kinds['query_id']}, n_terms int, doc_id {kinds['doc_id']}, n_hit long, b double"

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = _Scorer(*shipped.value, k)
            for ids, lengths, at, codes, tf in _documents(batches):
                yield from scorer.add(ids, lengths, at, codes, tf)
            yield from scorer.rest()

        return together.mapInArrow(score, schema)

    # ---- range by range ----------------------------------------------------------------------------

    def _by_ranges(self, asked: DataFrame, known: Mapping[str, int], weights: Mapping[str, float], k: int) -> DataFrame:
        """Scores of all documents that can be among the first k of their query, and of others."""
        n, mean = self.stats()
        df = self.spark.createDataFrame(sorted(known.items()), "term string, df long")
        asked = asked.select("query_id", "n_terms", "term_no", "term").join(F.broadcast(df), "term")
        most = sum((F.lit(float(weights.get(f, 0.0))) * F.get("max_tf", F.lit(i)) for i, f in enumerate(self.fields)), F.lit(0.0))
        bound = R.bm25_term(most, F.col("min_length"), F.lit(mean), F.lit(n), F.col("df"))
        of_terms = self.blocks(sorted(known)).join(F.broadcast(asked), "term")
        per = of_terms.groupBy("query_id", "n_terms", "range").agg(F.count("*").alias("present"), F.sum(bound).alias("bound"))
        per = self._aside(per)

        whole = self._aside(self._best(asked, per.where("present = n_terms"), weights, k, F.col("n_hit") == F.col("n_terms")))
        open_ = per.join(whole.select("query_id").distinct(), "query_id", "left_anti")
        return whole.unionByName(self._best(asked, open_, weights, k, F.lit(True)))

    def _best(self, asked: DataFrame, per: DataFrame, weights: Mapping[str, float], k: int, fit: Column) -> DataFrame:
        """Scores of ``fit`` documents in the ranges of ``per`` that may score most, and in those that may still reach the
        k-th of these."""
        order = W.partitionBy("query_id").orderBy(F.desc("bound"), "range")
        per = per.withColumn("__no", F.row_number().over(order))
        first = self._aside(self._in_ranges(asked, per.where(F.col("__no") <= FIRST_RANGES), weights).where(fit))
        kth = search.ranked(first, k, F.col("b").asc()).where(F.col("rank") == k).select("query_id", (-F.col("b")).alias("kth"))
        # Ties are broken after nine places, so a range that may come that near is looked at as well.
        rest = per.where(F.col("__no") > FIRST_RANGES).join(kth, "query_id", "left").where("kth is null or bound >= kth - 1e-8")
        return first.unionByName(self._in_ranges(asked, rest, weights).where(fit))

    def _in_ranges(self, asked: DataFrame, wanted: DataFrame, weights: Mapping[str, float]) -> DataFrame:
        """Scores of the documents in wanted(query_id, range, ...)."""
        wanted = wanted.select("query_id", "range")
        named = wanted.join(F.broadcast(asked.select("query_id", "term")), "query_id").select("term", "range").distinct()
        terms = sorted(r.term for r in named.select("term").distinct().collect())
        pushed = self._intervals(named) if 0 < len(terms) <= PUSHED_RANGES else None
        single = self._postings(terms, pushed=pushed).join(F.broadcast(asked), "term").join(search._small(wanted), ["query_id", "range"])
        return self._parts(self._summed(single, weights).join(F.broadcast(asked.select("query_id", "term_no", "df")), ["query_id", "term_no"]))

    def _intervals(self, named: DataFrame) -> Column:
        """A filter on term and range that files can use to skip pages: each term with a few intervals that hold its ranges."""
        width = F.expr(f"range div {max(1, -(-(self._last_range(named) + 1) // INTERVALS))}")
        spans = named.groupBy("term", width.alias("__i")).agg(F.min("range").alias("lo"), F.max("range").alias("hi")).collect()
        tests = [(F.col("term") == r.term) & F.col("range").between(r.lo, r.hi) for r in spans]
        while len(tests) > 1:  # balanced, so that the expression is not deep
            tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
        return tests[0]

    @staticmethod
    def _last_range(named: DataFrame) -> int:
        return named.agg(F.max("range")).first()[0]

    def _aside(self, df: DataFrame) -> DataFrame:
        """``df`` written beside the index, as several steps read it."""
        path = f"{shared_folder(self.spark)}/larkfield-{self.spark.sparkContext.applicationId}/ranges-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of documents (doc_id, the terms of each field): an occurrence leaves its task as a position in a list.
    ``first`` marks one posting of each document and term."""
    for batch in batches:
        n, width = batch.num_rows, batch.num_columns - 1
        counts = np.stack([c.value_lengths().to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(np.int64)
        length = counts.sum(0)
        done, lo = np.cumsum(length), 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + GROUPED, side="right")))
            size = counts[:, lo:hi].ravel()
            words = pa.concat_arrays([c.slice(lo, hi - lo).flatten() for c in batch.columns[1:]]).dictionary_encode()
            at = np.repeat(np.tile(np.arange(hi - lo), width), size)
            field = np.repeat(np.repeat(np.arange(width), hi - lo), size)
            place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            term = at * len(words.dictionary) + code
            key = term * width + field
            order = np.argsort(key, kind="stable")
            begin = np.flatnonzero(np.diff(key[order], prepend=-1))
            head = order[begin]
            offsets = pa.array(np.append(begin, len(order)).astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(lo + at[head])), pa.array(length[lo:hi][at[head]]), pa.array(field[head].astype(np.int8)), pa.array(np.diff(term[head], prepend=-1) != 0),
                words.dictionary.take(pa.array(code[head])), pa.ListArray.from_arrays(offsets, pa.array(place[order].astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "length", "field", "first", "term", "positions"])
            lo = hi


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, term, range, n_docs, min_length, a count for each field) sorted by the first three, one for each of these."""
    held = None

    def begins(rows: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(rows.num_rows, dtype=bool)
        new[:1] = True
        for c in rows.columns[:3]:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def made(rows: pa.RecordBatch, begin: np.ndarray) -> pa.RecordBatch:
        sums, least, *tops = (c.to_numpy(zero_copy_only=False) for c in rows.columns[3:])
        columns = [np.add.reduceat(sums, begin), np.minimum.reduceat(least, begin), *[np.maximum.reduceat(t, begin) for t in tops]]
        return pa.RecordBatch.from_arrays([*[c.take(pa.array(begin)) for c in rows.columns[:3]], *map(pa.array, columns)], names=rows.schema.names)

    for batch in batches:
        if batch.num_rows:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            begin = begins(rows)
            if len(begin) > 1:  # the last group may go on in the next batch
                yield made(rows.slice(0, int(begin[-1])), begin[:-1])
            held = rows.slice(int(begin[-1]))
    if held is not None:
        yield made(held, begins(held))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, lengths, which of them each posting is of, codes, counts) of whole documents, from postings sorted by document."""
    for table in _whole_documents(batches):
        ids, lengths, codes, tf = (c.combine_chunks().to_numpy(zero_copy_only=False) for c in table.columns)
        fresh = np.concatenate([[True], ids[1:] != ids[:-1]])
        begin = np.flatnonzero(fresh)
        yield ids[begin], lengths[begin], np.cumsum(fresh) - 1, codes, tf


def _summed_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, from postings sorted by document: its codes, once each, and their summed counts."""
    for ids, lengths, at, codes, tf in _documents(batches):
        width = int(codes.max()) + 1
        cell, back = np.unique(at * width + codes, return_inverse=True)
        offsets = pa.array(np.searchsorted(cell, np.arange(len(ids) + 1) * width).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((cell % width).astype(np.int32), np.bincount(back, weights=tf))]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lengths), *lists], names=["doc_id", "length", "code", "tf"])


def _phrase_hits(table: pa.Table, phrases: list[tuple], n_codes: int, of_field: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the phrase, a row of its document, weighted count) of all phrases, ((offset, code), ...) each with the
    numbers that it has, in whole documents (doc_id, length, field, code, positions)."""
    ids, _, field, code = (table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(4))
    lists = table.column(4).combine_chunks()
    begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    doc = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ids))))
    size, pos = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    # Places of the fields of all documents in one row, with room between them for the longest phrase.
    width = int(pos.max(initial=0)) + max(o for p, _ in phrases for o, _ in p) + 2
    place = np.repeat((doc * len(of_field) + field) * width, size) + pos
    code = np.repeat(code, size)
    order = np.lexsort((place, code))
    place, ends = place[order], np.searchsorted(code[order], np.arange(n_codes + 1))
    found = []
    for parts, numbers in phrases:
        of = sorted(((place[ends[c] : ends[c + 1]], o) for o, c in parts), key=lambda x: len(x[0]))
        start = of[0][0] - of[0][1]
        for there, offset in of[1:]:
            if not len(start):
                break
            near = np.searchsorted(there, start + offset)
            start = start[there[np.minimum(near, len(there) - 1)] == start + offset]
        if len(start):
            at, n = np.unique(start // width, return_counts=True)
            docs, back = np.unique(at // len(of_field), return_inverse=True)
            tf = np.bincount(back, weights=n * of_field[at % len(of_field)])
            found += [(np.full(len(docs), k), begin[docs], tf) for k in numbers]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by document, whose first column names it, in tables that hold whole documents."""
    held: list[pa.RecordBatch] = []

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= AT_ONCE:
            table = pa.Table.from_batches(held)
            ids = table.column(0).combine_chunks().to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))[-1])  # it may go on in the next batch
            if last:
                yield table.slice(0, last)
                held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)


class _Scorer:
    """Scores of documents, which come in the order of their ids, against all queries of a batch; with ``k`` the first
    ``k`` of each query are held back until the end."""

    def __init__(self, queries: list[tuple], times: np.ndarray, df: np.ndarray, n: int, mean: float, k: int | None):
        self.queries, self.times, self.mean, self.k = queries, times, mean, k
        self.n_terms = np.array([t for _, t in queries])
        idf = np.log((n - df + 0.5) / (df + 0.5))
        self.idf = np.where(idf > 0, idf, R.LEAST_IDF)
        self.names = np.array([q for q, _ in queries], dtype=object)
        self.best = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0), np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0)]
        self.whole, self.kth = np.zeros(len(queries), bool), np.full(len(queries), np.inf)

    def add(self, ids: np.ndarray, lengths: np.ndarray, at: np.ndarray, codes: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
        width = len(self.times)
        step = max(1, CELLS // max(self.times.shape))
        for lo in range(0, len(ids), step):
            hi = min(lo + step, len(ids))
            mine = slice(*np.searchsorted(at, [lo, hi]))
            cell = (at[mine] - lo) * width + codes[mine]
            there = np.bincount(cell, minlength=(hi - lo) * width).reshape(-1, width) > 0
            sums = np.bincount(cell, weights=tf[mine], minlength=(hi - lo) * width).reshape(-1, width)
            part = self.idf * sums * (R.K1 + 1.0) / (sums + R.K1 * (1.0 - R.B0 + R.B0 * lengths[lo:hi, None] / self.mean))
            n_hit, b = np.rint(there.astype(np.float64) @ self.times).astype(np.int64), -(part @ self.times)
            whole, near, some = n_hit == self.n_terms, np.round(b, 9), n_hit > 0
            if self.k is not None:  # a tie loses to the documents before it
                some &= (whole & ~self.whole) | ((whole == self.whole) & (near < self.kth))
            d, q = np.nonzero(some)
            rows = [q, whole[d, q], near[d, q], ids[lo:hi][d].astype(object), n_hit[d, q], b[d, q]]
            if self.k is None:
                yield self._batch(rows)
            elif len(d):
                self._merge(rows)

    def _merge(self, rows: list[np.ndarray]) -> None:
        rows = [np.concatenate(x) for x in zip(self.best, rows)]
        order = np.lexsort((np.arange(len(rows[0])), rows[2], ~rows[1], rows[0]))  # earlier rows have lesser ids
        begin = np.searchsorted(rows[0][order], np.arange(len(self.queries)))
        no = np.arange(len(order)) - begin[rows[0][order]]
        self.best = [x[order[no < self.k]] for x in rows]
        last = order[no == self.k - 1]
        self.whole[rows[0][last]], self.kth[rows[0][last]] = rows[1][last], rows[2][last]

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.k is not None:
            yield self._batch(self.best)

    def _batch(self, rows: list[np.ndarray]) -> pa.RecordBatch:
        q, _, _, ids, n_hit, b = rows
        columns = [self.names[q].tolist(), self.n_terms[q].astype(np.int32), ids.tolist(), n_hit, b]
        return pa.RecordBatch.from_pydict(dict(zip(("query_id", "n_terms", "doc_id", "n_hit", "b"), columns)))


_built: dict[tuple, PostingsIndex] = {}


def kept(spark: SparkSession, source: str, fields: list[str], id_column: str = "doc_id") -> PostingsIndex:
    """The index over a Parquet table, built at its first use and read from then on, by later applications too.

    It lies in the shared folder, under a name made of the table's files, their sizes and times, so a table that has
    changed is indexed anew. Of several applications that build it at once one commits, the others read that.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(conf)
    found = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in (fs.listStatus(path) if fs.getFileStatus(path).isDirectory() else [fs.getFileStatus(path)]))
    name = hashlib.sha256(repr((LAYOUT, fs.makeQualified(path).toString(), tuple(fields), id_column, found)).encode()).hexdigest()[:32]
    key = (spark.sparkContext.applicationId, name)
    if key not in _built:
        index = PostingsIndex(spark, f"{shared_folder(spark)}/larkfield-postings/{name}", fields, id_column)
        if not index.live.meta():
            try:
                index.add(spark.read.parquet(source).select(id_column, *fields))
            except Conflict:
                if not index.live.meta():
                    raise
        _built[key] = index
    return _built[key]


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="larkfield-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")
