"""Quality classifier: byte n-gram indicators scaled by naive Bayes log-count ratios, under a linear hinge-loss model.

Features are the 2-, 3- and 4-grams of the UTF-8 bytes of the whole text, hashed to ``2 ** BITS`` indicators, and a
few indicators of immediately repeated words. The model is fitted by dual coordinate descent on at most ``SAMPLE``
labelled documents on the driver; margins become probabilities by a logistic fit on out-of-fold margins.

Defined results: null and empty texts have no features and get the score of the intercept; texts of any length are
read whole, in blocks; without labels of both classes the score is the smoothed share of label 1; repeated rows score
alike; an empty table stays empty; input columns of the names written are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from larkfield.llm import labelled
from larkfield.llm.common import append_columns

BITS, REPEATS = 18, 4
WIDTH = (1 << BITS) + REPEATS
#: At most so many labelled documents are used for fitting.
SAMPLE = 3_000
THRESHOLD = 0.3
_BLOCK = 1 << 20
_PRIMES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def features(text: str | None) -> np.ndarray:
    """The sorted indices of the indicators that a text has."""
    data = (text or "").encode("utf-8", "surrogatepass")
    seen = np.zeros(WIDTH, dtype=bool)
    for start in range(0, len(data), _BLOCK):
        b = np.frombuffer(data, dtype=np.uint8, count=min(_BLOCK + 3, len(data) - start), offset=start).astype(np.uint32)
        gram = b
        for n, prime in zip((2, 3, 4), _PRIMES):
            if len(b) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :]
            seen[(gram * prime) >> np.uint32(32 - BITS)] = True
    words = data.split()
    if len(words) > 1:
        same = sum(map(bytes.__eq__, words, words[1:])) / (len(words) - 1)
        seen[WIDTH - REPEATS :] = (same > 0.03, same > 0.1, same > 0.3, same > 0.6)
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class NbSvm:
    """Weights with the log-count ratios multiplied in; a and b turn margins into probabilities."""

    weights: np.ndarray
    intercept: float
    a: float
    b: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(1, len(found)))) + self.intercept

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(features(text)) + self.b, -30, 30))))


def _ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, WIDTH), alpha)
    for found, label in zip(rows, y):
        counts[int(label > 0), found] += 1
    share = counts / counts.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def _descend(rows: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss, classes weighted alike, on ratio-scaled rows."""
    ratio = _ratios(rows, y)
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    norms = [float(v @ v) + 1.0 for v in values]
    balance = {1.0: len(y) / (2 * max(1, (y > 0).sum())), -1.0: len(y) / (2 * max(1, (y < 0).sum()))}
    upper = [cost * balance[float(t)] for t in y]
    w, b, alpha = np.zeros(WIDTH), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(y)):
            r, v, t = rows[i], values[i], y[i]
            slope = t * (float(w[r] @ v) + b) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), upper[i])
            step = (new - alpha[i]) * t
            if step:
                w[r] += step * v
                b += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-4 * cost:
            break
    return w * ratio, b


def fit(rows: list[np.ndarray], labels: list[int], cost: float = 1.0, epochs: int = 12, folds: int = 4, seed: int = 3) -> NbSvm:
    """Fits on feature rows with labels 0 and 1."""
    y = np.where(np.array(labels, dtype=int) > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        share = ((y > 0).sum() + 0.5) / (len(y) + 1)
        return NbSvm(np.zeros(WIDTH), 0.0, 0.0, float(np.log(share / (1 - share))))
    part = np.random.default_rng(seed).permutation(len(y)) % folds
    margins = np.zeros(len(y))
    for k in range(folds):
        inside, out = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(set(y[inside].tolist())) < 2:
            continue
        w, b = _descend([rows[i] for i in inside], y[inside], cost, epochs, seed)
        margins[out] = [w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + b for i in out]
    a, c = platt(margins, y)
    return NbSvm(*_descend(rows, y, cost, epochs, seed), a, c)


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic fit with smoothed targets, by Newton steps with a weak prior."""
    positive, negative = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(y))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(theta[0])), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", limit: int = SAMPLE) -> NbSvm:
    """Features are made on the executors; the driver gets at most ``limit`` rows of them."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["id", "label", "found"])

    drawn = labelled.sample(docs, labels, label, learn, limit)
    kind = drawn.schema["id"].dataType.simpleString()
    rows = drawn.mapInArrow(extract, f"id {kind}, label int, found binary").collect()
    rows.sort(key=lambda r: (str(r.id), r.label, bytes(r.found)))
    return fit([np.frombuffer(bytes(r.found), dtype=np.int32) for r in rows], [r.label for r in rows])


def score_quality(docs: DataFrame, model: NbSvm, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from the threshold on)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def compute(texts: list) -> dict:
        scores = [shipped.value.score(t) for t in texts]
        return {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return append_columns(docs, text, fields, compute)
