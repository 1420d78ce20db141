"""Nearest vectors by cosine through cells: vectors lie with the centre they are nearest to, and most cells are not read.

Centres are learnt from a bounded sample (k-means on the unit sphere); every vector is then assigned, with its angle to the
centre, and each cell knows the range of these angles. By the triangle inequality a vector of a cell is no nearer to a query
than the query's angle to the centre differs from that range. A search scores the nearest cells first and then those
whose bound still reaches the k-th score, so its rows are those of ``vectors.top_k`` over all vectors.

Defined results: as ``vectors.top_k``; vectors of another length than most of the sample have a cell of their own (-1) that
is always read; an empty table gives an empty index. Each call of ``build`` writes a whole index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkfield.operators.vectors import _matrix, scored

#: Vectors that centres are learnt from, cells at most, steps of learning, and cells looked at first.
SAMPLE, CELLS, STEPS, FIRST = 16_384, 1_024, 12, 2
#: What rounding may take off a bound.
SLACK = 1e-9


def learn(units: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres of unit vectors; a centre that loses its vectors starts again from the one that is worst off."""
    rng = np.random.default_rng(seed)
    centres = units[rng.choice(len(units), cells, replace=False)]
    for _ in range(STEPS):
        scores = units @ centres.T
        own, best = scores.argmax(1), scores.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        for c in np.flatnonzero(np.bincount(own, minlength=cells) == 0):
            worst = int(best.argmin())
            sums[c], best[worst] = units[worst], 2.0
        size = np.sqrt((sums * sums).sum(1))
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


class CellIndex:
    """An index below ``root``: vectors/cell=C, and centres with the number of vectors and the range of angles of each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.scored = self.all = 0  # pairs that the last search scored, and pairs there are
        self.schema: str | None = None  # of the vectors; told by the files of an index that was built before

    def build(self, vectors: DataFrame, cells: int | None = None, id_column: str = "vec_id", vector: str = "embedding") -> None:
        rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v"))
        n = rows.count()
        cells = min(CELLS, max(1, math.isqrt(n))) if cells is None else cells
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column(1).to_pylist()
        by_size = _matrix(sample)
        size, units = max(((len(at), n, u) for n, (at, u) in by_size.items()), key=lambda x: x[:2], default=(0, 0, np.zeros((0, 0))))[1:]
        centres = learn(units, min(cells, len(units))) if len(units) else np.zeros((0, 0))
        shipped = self.spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
                found = _matrix(batch.column(1).to_pylist()).get(size)
                if found is not None and len(shipped.value):
                    at, own = found
                    scores = own @ shipped.value.T
                    cell[at] = scores.argmax(1)
                    angle[at] = np.arccos(np.clip(scores.max(1), -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(cell)], names=["id", "v", "angle", "cell"])

        kind, element = rows.schema["id"].dataType.simpleString(), rows.schema["v"].dataType.simpleString()
        self.schema = f"id {kind}, v {element}, angle double, cell int"
        assigned = rows.mapInArrow(assign, self.schema)
        # A cell may be large: it is dealt to several tasks.
        assigned.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/vectors")
        told = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        seen = self._vectors().groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
        seen.join(told, "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centres")

    def _vectors(self) -> DataFrame:
        read = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return read.parquet(f"{self.root}/vectors")

    def top_k(self, queries: DataFrame, k: int, vector: str = "embedding", block: int = 4_096) -> DataFrame:
        """(query_id, id, score, rank) for a stated set of queries(query_id, embedding), a block of them at a time."""
        asked = queries.select("query_id", F.col(vector).alias("q"))
        cells = self.spark.read.parquet(f"{self.root}/centres").orderBy("cell").collect()  # a row a cell
        self.scored = self.all = 0
        if not cells:
            empty = asked.limit(0).crossJoin(self._vectors().select("id") if self.schema else self.spark.range(0))
            return empty.select("query_id", "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        blocks, out = max(1, -(-asked.count() // block)), None
        for b in range(blocks):
            part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
            found = self._block(part.column(0).combine_chunks(), part.column(1).to_pylist(), cells, k)
            out = found if out is None else out.unionByName(found)
        return out

    def _block(self, names: pa.Array, values: list, cells: list, k: int) -> DataFrame:
        counts = np.array([c.n for c in cells], dtype=np.int64)
        named = [i for i, c in enumerate(cells) if c.centre is not None]
        size = len(cells[named[0]].centre) if named else 0
        wanted = np.zeros((len(values), len(cells)), bool)
        wanted[:, [i for i in range(len(cells)) if i not in named]] = True  # the cell of other lengths
        bounds = np.full((len(values), len(cells)), -np.inf)
        matrices = _matrix(values)
        if size in matrices:
            at, units = matrices[size]
            angles = np.arccos(np.clip(units @ np.array([cells[i].centre for i in named]).T, -1, 1))
            least, most = (np.array([getattr(cells[i], name) for i in named]) for name in ("least", "most"))
            far = np.maximum(0, np.maximum(angles - most, least - angles))
            bounds[np.ix_(at, named)] = np.cos(np.minimum(far, np.pi))
            order = np.argsort(angles, axis=1, kind="stable")
            reached = np.cumsum(counts[named][order], axis=1)
            for row, q in enumerate(at):  # the nearest cells, until they hold k vectors
                enough = max(FIRST, int(np.searchsorted(reached[row], k)) + 1)
                wanted[q, np.array(named)[order[row][:enough]]] = True
        first = self._aside(self._scan(names, matrices, wanted, cells, k))
        kth = {r.query_id: r.score for r in first.where(F.col("rank") == k).select("query_id", "score").collect()}
        reach = np.array([kth.get(q, -np.inf) for q in names.to_pylist()])
        more = ~wanted & np.isfinite(bounds) & (bounds >= reach[:, None] - SLACK)
        self.scored += int((wanted @ counts).sum() + (more @ counts).sum())
        self.all += len(values) * int(counts.sum())
        found = first.drop("rank").unionByName(self._scan(names, matrices, more, cells, k).drop("rank")) if more.any() else first.drop("rank")
        return _ranked(found, k)

    def _scan(self, names: pa.Array, matrices: dict, wanted: np.ndarray, cells: list, k: int) -> DataFrame:
        """The best ``k`` of the wanted cells for each query."""
        read = [c.cell for i, c in enumerate(cells) if wanted[:, i].any()]
        of_cell = {c.cell: wanted[:, i] for i, c in enumerate(cells)}
        shipped = self.spark.sparkContext.broadcast((names, matrices, of_cell))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrices, of_cell = shipped.value
            for batch in batches:
                own = np.array(batch.column(2).to_pylist())
                for cell in np.unique(own):
                    part = batch.filter(pa.array(own == cell))
                    for n, (at, units) in _matrix(part.column(1).to_pylist()).items():
                        if n in matrices:
                            who, q = matrices[n]
                            mine = of_cell[int(cell)][who]
                            if mine.any():
                                yield from scored(names, part.column(0), who[mine], at, units, q[mine], k)

        rows = self._vectors().where(F.col("cell").isin(read)).select("id", "v", "cell")
        schema = self.spark.createDataFrame([], f"query_id {_simple(names.type)}, id {rows.schema['id'].dataType.simpleString()}, score double").schema
        return _ranked(rows.mapInArrow(score, schema), k)

    def _aside(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/first-{self.spark.sparkContext.applicationId}-{id(df)}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _simple(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
