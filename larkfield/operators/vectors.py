"""Exact nearest vectors by cosine, in blocks of queries, with a bounded number of rows for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _matrix(values: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions, and unit vectors as rows. Vectors that are null, empty, zero or hold nulls are left out."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v and all(x is not None for x in v):
            by.setdefault(len(v), []).append(i)
    out = {}
    for n, at in by.items():
        rows = np.array([values[i] for i in at], dtype=np.float64)
        size = np.sqrt((rows * rows).sum(1))
        good = size > 0
        out[n] = np.array(at)[good], rows[good] / size[good, None]
    return out


def nearest(names: pa.Array, ids: pa.Array, who: np.ndarray, at: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """(query_id, id, score): the best ``k`` rows of a matrix of scores for each of its columns, ties by the id.

    ``at`` are the places of the rows in ``ids``, ``who`` those of the columns in ``names``.
    """
    rank = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object), kind="stable")) if ids.null_count == 0 else np.arange(len(ids))
    winners, columns, values = [], [], []
    for c in range(len(who)):
        s = scores[:, c]
        near = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        near = near[np.lexsort((rank[at[near]], -s[near]))][:k]
        winners.append(at[near])
        columns.append(np.full(len(near), who[c]))
        values.append(s[near])
    chosen = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (columns, winners)]
    return pa.RecordBatch.from_arrays([names.take(pa.array(chosen[0])), ids.take(pa.array(chosen[1])), pa.array(np.concatenate(values) if values else [], pa.float64())], names=["query_id", "id", "score"])


#: Scores that are held at once.
SCORES = 4_000_000


def scored(names: pa.Array, ids: pa.Array, who: np.ndarray, at: np.ndarray, units: np.ndarray, wanted: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """``nearest`` for unit vectors and the unit vectors of queries, so many queries at a time that their scores stay few."""
    step = max(1, SCORES // max(1, len(units)))
    for q in range(0, len(who), step):
        yield nearest(names, ids, who[q : q + step], at, np.round(units @ wanted[q : q + step].T, 12), k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", block: int = 4_096) -> DataFrame:
    """(query_id, id, score, rank): a stated set of queries against all vectors.

    Queries go out in broadcast blocks of ``block`` rows, dealt by hash, and each block is one scan of the vectors, in
    which batches are scored as matrices and give at most ``k`` rows a query. Scores that agree to twelve places are ties
    and end by the id. Zero vectors and other lengths have no score.
    """
    spark = vectors.sparkSession
    asked = queries.select("query_id", F.col(vector).alias("__q"))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("__v"))
    blocks = max(1, -(-asked.count() // block))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        listed = part.toArrow()
        shipped = spark.sparkContext.broadcast((listed.column(0).combine_chunks(), _matrix(listed.column(1).to_pylist())))

        def score(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            names, wanted = shipped.value
            for batch in batches:
                for n, (at, units) in _matrix(batch.column(1).to_pylist()).items():
                    if n in wanted:
                        who, q = wanted[n]
                        yield from scored(names, batch.column(0), who, at, units, q, k)

        found = rows.mapInArrow(score, schema)
        best = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def upsert_vectors(store: DataFrame, new: DataFrame, key: str = "hash") -> DataFrame:
    return store.join(new.select(key), key, "left_anti").unionByName(new)
