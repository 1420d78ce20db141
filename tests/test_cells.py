"""Cells against the scan of all vectors."""

import numpy as np
import pyarrow as pa

from larkfield.operators import vectors
from larkfield.operators.cells import CellIndex, learn

SCHEMA = "vec_id long, embedding array<float>"


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 10)) for r in df.collect())


def made(rng, n, size=12, groups=9):
    centres = rng.normal(size=(groups, size))
    return [(i, [float(x) for x in centres[rng.integers(groups)] + rng.normal(scale=0.25, size=size)]) for i in range(n)]


def test_cells_give_the_rows_of_a_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = made(rng, 600) + [(600, None), (601, []), (602, [0.0] * 12), (603, [1.0, 2.0]), (604, [2.0, 4.0]), (605, None)]
    data += [(700 + i, data[5][1]) for i in range(9)]  # ties
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    asked = spark.createDataFrame([(i, v) for i, v in data[:40] + [(900, [1.0, 2.0]), (901, [0.0] * 12), (902, None), (903, [float(x) for x in rng.normal(size=12)])]], "query_id long, embedding array<float>")
    index = CellIndex(spark, f"{tmp_path}/i")
    index.build(frame)
    for k, block in ((1, 4_096), (7, 16), (700, 4_096)):
        assert rows(index.top_k(asked, k, block=block)) == rows(vectors.top_k(frame, asked, k))
        if k == 7:
            assert index.scored < index.all / 2
    none = CellIndex(spark, f"{tmp_path}/none")
    none.build(frame.limit(0))
    assert rows(none.top_k(asked, 3)) == []


def test_every_centre_keeps_vectors():
    units = np.eye(6)[[0, 0, 0, 0, 1, 2, 3]]
    centres = learn(units, 4)
    assert len(np.unique((units @ centres.T).argmax(1))) == 4


def test_scores_are_held_for_a_few_queries_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    units, asked = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(300, 8)), rng.normal(size=(50, 8))))
    names, ids = pa.array(range(50)), pa.array(range(1000, 1300))
    called = []
    nearest = vectors.nearest
    monkeypatch.setattr(vectors, "nearest", lambda *x: called.append(x[4].size) or nearest(*x))
    monkeypatch.setattr(vectors, "SCORES", 2_000)
    rows = [r for b in vectors.scored(names, ids, np.arange(50), np.arange(300), units, asked, 4) for r in b.to_pylist()]
    assert max(called) <= 2_000 and len(called) == 9
    scores = asked @ units.T
    assert [(r["query_id"], r["id"]) for r in rows] == [(q, 1000 + i) for q in range(50) for i in np.argsort(-scores[q], kind="stable")[:4].tolist()]
