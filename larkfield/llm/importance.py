"""Target-distribution importance resampling: documents are drawn by how much likelier their words are in a target.

Features are all runs of 1 to ``longest`` consecutive words, hashed into buckets by CRC-32. Each partition builds a trie of
words: a node is a run, its CRC state goes on from its parent's (CRC-32 of a run continues with a blank and the next word),
and it counts how often the run occurs. Nodes are added up by bucket when the partition ends or the trie reaches
``NODES`` nodes, so memory is bounded and counts stay exact; the buckets of all partitions are then summed. The gain of a
bucket is the floored log ratio of its smoothed shares in target and corpus, in thousandths. The second pass walks the runs
of each document through a trie whose nodes hold the gains, and floors their mean: the weight. Gumbel noise derived from
the id turns weights into a draw without replacement: the highest scores are drawn.

Ranks come without a global sort in one task: counts by score (scores are whole numbers of a narrow range) give the score
from which on rows can be drawn; only those rows are dealt by ranges of (score, id), sorted and numbered range by range.

Defined results: null and empty texts have no features and the weight 0; a null id is hashed as empty and comes last of
equal scores; repeated rows count and are drawn one by one, equal ones in any order; an empty table stays empty, an empty
target gives gains from smoothing alone. Only id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.llm.common import ASCII_LOWER, Stored, small_batches
from larkfield.llm.packing import line

#: Digits, lower-case ASCII letters and all that is not ASCII; A-Z are lower-cased before.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS, LONGEST, SEED, MIN_WORDS, PERCENT = 10_000, 1, "2024", 20, 10
#: Nodes of a trie beyond which a new one is begun, and words looked up between two looks at their number.
NODES, STRETCH = 400_000, 50_000
#: Rows of a range that one task numbers, about.
RANGE_ROWS = 500_000


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return WORDS.findall(text.lower() if text.isascii() else text.translate(ASCII_LOWER))


class Children(dict):
    """The nodes below one node, by word; a node is made when it is first asked for."""

    def __init__(self, trie: Trie, node: int):
        super().__init__()
        self.trie, self.node = trie, node

    def __missing__(self, word: str) -> int:
        found = self[word] = self.trie.made(self.node, word)
        return found


class Trie:
    """Runs of words as nodes. Node 0 is the empty run; a node has its children, its CRC state and a value."""

    def __init__(self, value_of: Callable[[int], int] = lambda state: 0):
        self.children: list[Children | None] = [Children(self, 0)]
        self.crc, self.value, self.value_of = [0], [0], value_of

    def made(self, node: int, word: str) -> int:
        data = word.encode()
        state = zlib.crc32(b" " + data if node else data, self.crc[node])
        self.crc.append(state)
        self.value.append(self.value_of(state))
        self.children.append(None)
        return len(self.crc) - 1

    def below(self, node: int) -> Children:
        if self.children[node] is None:
            self.children[node] = Children(self, node)
        return self.children[node]

    def nodes(self, words: list[str], first: int, last: int, longest: int) -> Iterator[list[int]]:
        """The nodes of the runs that begin at the words ``first`` to ``last`` - 1: those of one word, of two, and so on."""
        root = self.children[0]
        level = [root[w] for w in words[first:last]]
        yield level
        for n in range(1, longest):
            level = [self.below(node)[word] for node, word in zip(level, words[first + n : last + n])]
            yield level


def walked(trie: Trie, words: list[str], longest: int, full: Callable[[Trie], Trie]) -> Iterator[tuple[Trie, list[int]]]:
    """The trie and the nodes of all runs of a text, some at a time. A trie of ``NODES`` nodes is handed to ``full``, which
    gives the next one; no run is lost, as a run belongs to the stretch in which it begins."""
    for first in range(0, len(words), STRETCH):
        if len(trie.crc) > NODES:
            trie = full(trie)
        for level in trie.nodes(words, first, min(first + STRETCH, len(words)), longest):
            yield trie, level


def bucket_totals(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text_column: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; buckets without one are left out."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)

        def added(trie: Trie) -> Trie:
            np.add.at(total, np.asarray(trie.crc, np.int64) % buckets, np.asarray(trie.value, np.int64))
            return Trie()

        trie = Trie()
        for batch in batches:
            for text in batch.column(0):
                for trie, nodes in walked(trie, words_of(text.as_py()), longest, added):
                    value = trie.value
                    for node in nodes:
                        value[node] += 1
        added(trie)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    found = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket from the bucket totals of corpus and target (``buckets`` numbers, whatever the data)."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    rows = both.select("bucket", "s", "t").toArrow().sort_by("bucket")
    s, t = (rows.column(c).to_numpy().astype(np.float64) for c in ("s", "t"))
    return np.floor(1_000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(id_column: str, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths from the first eight hex digits of the SHA-256 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every document."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([base.schema["id"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])
    gain_of = gain.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty(_: Trie | None = None) -> Trie:
            return Trie(lambda state: gain_of[state % len(gain_of)])

        trie = empty()
        for batch in batches:
            found = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                n = total = 0
                for trie, nodes in walked(trie, words, longest, empty):
                    value = trie.value
                    n += len(nodes)
                    total += sum([value[node] for node in nodes])
                found.append((len(words), n, total // n if n else 0))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "n_words", "n_features", "weight"])

    return base.mapInArrow(run, schema)


def ranked(rows: DataFrame, drawn: int, order: Sequence[Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3, ... by ``order``), null beyond ``drawn``: sorted and numbered range by range."""
    ranges = max(1, -(-rows.count() // range_rows))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            extra = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "at"])
            at += n

    placed, _ = line(Stored(dealt.mapInArrow(number, schema)).df, F.lit(1))
    return placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("part", "at", "place")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; those with a rank are drawn: ``percent`` of the
    documents of ``min_words`` words or more. ``target`` has its texts in a column of the same name."""
    gain = gains(bucket_totals(docs, buckets, longest, text_column), bucket_totals(target, buckets, longest, text_column), buckets)
    weighed = weigh(docs, gain, longest, id_column, text_column)
    # Stored: the noise of a row and its number among equals must not change when a task is run again.
    rows = Stored(weighed.withColumns({"score": F.col("weight") + noise("id", seed), "__row": F.monotonically_increasing_id()})).df
    fit = rows.where(F.col("n_words") >= min_words)
    # Scores are whole thousandths of logarithms: a hundred thousand different ones at most, whatever the data.
    counts = sorted(((r["score"], r["count"]) for r in fit.groupBy("score").count().collect()), reverse=True)
    drawn, least, seen = percent * sum(n for _, n in counts) // 100, None, 0
    for score, n in counts:
        if seen >= drawn:
            break
        least, seen = score, seen + n
    near = (F.col("n_words") >= min_words) & (F.col("score") >= least) if least is not None else F.lit(False)
    top = ranked(rows.where(near), drawn, [F.desc("score"), F.asc_nulls_last("id"), F.asc("__row")])
    rest = rows.where(~near).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).drop("__row").withColumnRenamed("id", id_column)


def oracle() -> str:
    """DuckDB SQL for the query over ``documents`` and ``benchmark``: unigrams, CRC-32 of each distinct word by table."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
d AS MATERIALIZED (SELECT doc_id, {words} AS words FROM documents),
w AS MATERIALIZED (SELECT doc_id, unnest(words) AS word FROM d),
b AS MATERIALIZED (SELECT unnest({words}) AS word FROM benchmark),
hexed AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM w UNION SELECT word FROM b)),
bytes AS (SELECT word, list_transform(range(length(x) // 2), lambda i: CAST(('0x' || x[2 * i + 1 : 2 * i + 2]) AS BIGINT)) AS v FROM hexed),
k AS MATERIALIZED (SELECT word, xor(list_reduce(v, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM w JOIN k USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY 1),
g AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + {BUCKETS})
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + {BUCKETS})))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM w JOIN k USING (word) JOIN g USING (bucket) GROUP BY 1),
a AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
    CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN f ON f.doc_id = d.doc_id),
c AS MATERIALIZED (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score FROM a),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= {MIN_WORDS})
SELECT c.doc_id, c.n_features, CAST(c.weight AS BIGINT) AS weight, CAST(c.score AS BIGINT) AS score, CAST(r.rank AS BIGINT) AS rank FROM c LEFT JOIN r
    ON r.doc_id = c.doc_id AND r.rank <= {PERCENT} * (SELECT count(*) FROM r) // 100"""
