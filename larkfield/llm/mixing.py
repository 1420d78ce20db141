"""Mixing to target weights: token counts are raked to source, language and topic marginals, then documents sampled.

Iterative proportional fitting works on the cells (source x language x topic), whose token sums are aggregated before
any shuffle. A cell's inclusion probability is the product of a weight for each of its values, at most one; sweeps
scale the weights, dimension by dimension, until the expected tokens of every value are its share of the budget.
Targets that no sample can reach are first made feasible (``feasible``): a value gives at most its own tokens, and what
it lacks is dealt to the others. Where marginals still contradict each other, the remaining gaps are what ``report``
gives, and gaps of over ``GAP`` of the budget raise a warning. Up to ``MAX_CELLS`` cells are fitted on the driver, more
in Spark tables, a sweep at a time. Each document is drawn by a hash of its id and the seed, so a draw can be repeated.

Topics, unless a column is given, are clusters of texts by their words (``TopicModel``): hashed word counts, less the
mean of the language, nearest of ``TOPICS`` centres. Means and centres are fitted on all texts: their counts are stored once
as whole numbers, each turn adds them up by centre in the tasks, and the sums are exact in whatever order they come.

Defined results: null or empty texts have no tokens, topic ``(none)``, and take their cell's probability; null sources
and languages form a value of their own (``(none)``); repeated ids share their fate; values without a target keep their
own share of what the targets leave; targets of absent values are dealt to the rest; a text equally near to two centres
takes the first; an empty table stays empty; input columns of the names written are replaced.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.llm.common import Stored, append_columns, without

DIMENSIONS = ("mix_source", "mix_lang", "mix_topic")
MAX_CELLS, SWEEPS, TOLERANCE, GAP = 100_000, 400, 1e-9, 0.01
#: Clusters of texts, turns of their fit, dimensions of the hashed word counts, and what a count of one is as a whole number.
TOPICS, TURNS, WIDTH, UNIT = 6, 25, 256, 32_767
#: Texts that a language must have for a mean of its own, and sums that a task holds before it sends them.
OWN_MEAN, HELD_SUMS = 20, 1_000
#: Shares of the default targets are token sums to these powers: large values are damped.
TEMPER = {"mix_source": 0.5, "mix_lang": 0.7, "mix_topic": 0.8}
WRITTEN = (*DIMENSIONS, "n_tokens", "probability", "sampled")


class _Codes(dict):
    """The dimension of each word met, so that a word is hashed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        return self.setdefault(word, zlib.crc32(word.encode("utf-8", "surrogatepass")) % WIDTH)


_known = _Codes()


def word_counts(text: str | None) -> np.ndarray:
    """Damped, normalised counts of the hashed words of a whole text; zero without words."""
    at = list(map(_known.__getitem__, (text or "").lower().split()))
    out = np.log1p(np.bincount(at, minlength=WIDTH)) if at else np.zeros(WIDTH)
    size = np.linalg.norm(out)
    return (out / size if size else out).astype(np.float32)


def n_words(text: str | None) -> int:
    """Runs of anything but ASCII white space, which is what bytes are split at."""
    return len((text or "").encode("utf-8", "surrogatepass").split())


@dataclass(frozen=True)
class TopicModel:
    """Means of languages and centres of clusters."""

    means: dict[str, np.ndarray]
    centres: np.ndarray

    def topics(self, texts: list, langs: list) -> list[str]:
        made = np.stack([word_counts(t) for t in texts]) if texts else np.zeros((0, WIDTH), dtype=np.float32)
        empty = ~made.any(axis=1)
        rest = self.means.get("", np.zeros(WIDTH, dtype=np.float32))
        made = made - np.stack([self.means.get(str(x), rest) for x in langs]) if texts else made
        near = (made @ self.centres.T - (self.centres**2).sum(1) / 2).argmax(1) if len(self.centres) else np.zeros(len(made), dtype=int)
        return ["(none)" if none or not len(self.centres) else f"topic{k}" for none, k in zip(empty, near)]


def fit_topics(docs: DataFrame, text: str = "text", lang: str = "lang", topics: int = TOPICS, seed: int = 5) -> TopicModel:
    """Fits on all texts with words, from the ``topics`` different ones of least hash on; the driver gets sums alone."""
    rows = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text, lang, F.lit(seed)).alias("h"), F.coalesce(F.col(lang).cast("string"), F.lit("(none)")).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.rint(word_counts(t) * UNIT).astype(np.int16) for t in batch.column(2).to_pylist()]
            some = pa.array([bool(x.any()) for x in made], pa.bool_())
            counts = pa.array([x.tobytes() for x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["h", "lang", "counts"]).filter(some)

    stored = Stored(rows.mapInArrow(count, "h long, lang string, counts binary"))
    first = [r.h for r in stored.df.select("h").distinct().orderBy("h").limit(topics).collect()]
    if not first:
        stored.drop()
        return TopicModel({}, np.zeros((0, WIDTH), dtype=np.float32))
    by_lang = _sums(stored.df, lambda langs, at, x: (langs, at, x))
    n, total = sum(n for n, _ in by_lang.values()), sum(x for _, x in by_lang.values())
    means = {k: np.rint(x / m).astype(np.int64) for k, (m, x) in by_lang.items() if m >= OWN_MEAN}
    means[""] = np.rint(total / n).astype(np.int64)
    del by_lang

    def centred(langs: list[str], at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x - np.stack([means.get(k, means[""]) for k in langs])[at]

    begun = stored.df.where(F.col("h").isin(first)).groupBy("h").agg(F.first("lang").alias("lang"), F.first("counts").alias("counts")).orderBy("h").collect()
    centres = centred([r.lang for r in begun], np.arange(len(begun)), np.stack([np.frombuffer(bytes(r.counts), dtype=np.int16) for r in begun])) / UNIT
    for _ in range(TURNS):

        def nearest(langs: list[str], at: np.ndarray, x: np.ndarray, centres: np.ndarray = centres) -> tuple[list[str], np.ndarray, np.ndarray]:
            x = centred(langs, at, x)
            return [str(k) for k in range(len(centres))], (x @ centres.T / UNIT - (centres**2).sum(1) / 2).argmax(1), x

        found = _sums(stored.df, nearest)
        moved = np.stack([found[str(k)][1] / (found[str(k)][0] * UNIT) if str(k) in found else c for k, c in enumerate(centres)])
        if (moved == centres).all():
            break
        centres = moved
    stored.drop()
    return TopicModel({k: (x / UNIT).astype(np.float32) for k, x in means.items()}, centres.astype(np.float32))


def _sums(rows: DataFrame, group: Callable[[list[str], np.ndarray, np.ndarray], tuple[list[str], np.ndarray, np.ndarray]]) -> dict[str, tuple[int, np.ndarray]]:
    """How many rows(h, lang, counts) each group has, and the sum of what ``group`` makes of the languages, the number of
    each row's language among them, and the counts: names, the number of each row's name, and whole numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def sent() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([x.tolist() for _, x in held.values()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["k", "n", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.int16).reshape(-1, WIDTH).astype(np.float64)
            langs = batch.column(1).dictionary_encode()
            names, at, x = group(langs.dictionary.to_pylist(), langs.indices.to_numpy(), x)
            mine = at == np.arange(len(names))[:, None]
            # Sums of whole numbers far below 2**53 are exact.
            for name, n, sums in zip(names, mine.sum(1).tolist(), (mine.astype(np.float64) @ x).astype(np.int64)):
                if n:
                    before = held.setdefault(name, [0, np.zeros(WIDTH, dtype=np.int64)])
                    before[0] += n
                    before[1] += sums
            if len(held) >= HELD_SUMS:
                yield sent()
                held = {}
        yield sent()

    made = rows.mapInArrow(add, "k string, n long, sums array<long>")
    added = made.select("k", "n", F.posexplode("sums")).groupBy("k", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("x"))
    out: dict[str, tuple[int, np.ndarray]] = {}
    for k, pos, n, x in added.collect():
        out.setdefault(k, (n, np.zeros(WIDTH, dtype=np.int64)))[1][pos] = x
    return out


def describe(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None) -> DataFrame:
    """``docs`` with the cell of each row and its tokens; topics are fitted unless a column is given."""
    docs = without(docs, WRITTEN)
    docs = docs.withColumns({name: F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for name, c in (("mix_source", source), ("mix_lang", lang))})
    if topic is not None:
        n_tokens = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
        return docs.withColumns({"n_tokens": n_tokens, "mix_topic": F.coalesce(topic, F.lit("(none)"))})
    shipped = docs.sparkSession.sparkContext.broadcast(fit_topics(docs, text, "mix_lang"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("mix_topic", T.StringType())]

    def made(texts: list, langs: list) -> dict[str, list]:
        return {"n_tokens": list(map(n_words, texts)), "mix_topic": shipped.value.topics(texts, langs)}

    return append_columns(docs, text, fields, made, also=("mix_lang",))


def shares(found: Mapping[str, float], wanted: Mapping[str, float] | None, power: float) -> dict[str, float]:
    """Target shares (summing to one) of the values found in one dimension."""
    total = sum(found.values())
    if wanted is None:
        raw = {k: v**power for k, v in found.items()}
    else:
        given = {k: wanted[k] for k in found if k in wanted}
        rest = {k: v for k, v in found.items() if k not in wanted}
        left = max(0.0, 1.0 - sum(given.values())) if rest else 0.0
        mass = sum(rest.values())
        raw = given | {k: (left * v / mass if mass else 0.0) for k, v in rest.items()}
    norm = sum(raw.values())
    return {k: (v / norm if norm else (found[k] / total if total else 0.0)) for k, v in raw.items()}


def feasible(wanted: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """``wanted`` with no value above its tokens; what is cut is dealt to the others by what they want."""
    out = wanted.astype(float).copy()
    for _ in range(len(out)):
        over = out > tokens
        lack = float((out - tokens)[over].sum())
        out = np.minimum(out, tokens)
        room = (out < tokens) & (out > 0)
        if lack <= 1e-12 * max(1.0, out.sum()) or not room.any():
            break
        out[room] += lack * out[room] / out[room].sum()
    return np.minimum(out, tokens)


def rake(codes: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], start: float) -> np.ndarray:
    """The probability of each cell; codes has a column for each dimension, targets the tokens wanted for each value."""
    weights = [np.ones(len(t)) for t in targets]
    order = np.lexsort(codes.T)  # the same sums, to the last bit, in whatever order the cells came
    codes, tokens = codes[order], tokens[order]

    def probabilities() -> np.ndarray:
        raw = np.full(len(tokens), start)
        for d, w in enumerate(weights):
            raw = raw * w[codes[:, d]]
        return np.minimum(1.0, raw)

    p = probabilities()
    for _ in range(SWEEPS):
        before = p
        for d, wanted in enumerate(targets):
            now = np.bincount(codes[:, d], weights=p * tokens, minlength=len(wanted))
            factor = np.divide(wanted, now, out=np.ones(len(wanted)), where=now > 0)
            weights[d] = np.clip(weights[d] * factor, 0, 1e12)
            p = probabilities()
        if np.abs(p - before).max(initial=0.0) < TOLERANCE:
            break
    out = np.empty(len(p))
    out[order] = p
    return out


def _rake_tables(cells: DataFrame, wanted: dict[str, DataFrame], start: float) -> DataFrame:
    """The same for more cells than the driver should hold; a sweep is written before the next one reads it."""
    state = Stored(cells.withColumn("raw", F.lit(start)))
    for _ in range(SWEEPS):
        df = state.df.withColumn("__before", F.col("raw"))
        for d in DIMENSIONS:
            now = df.groupBy(d).agg(F.sum(F.least(F.lit(1.0), F.col("raw")) * F.col("tokens")).alias("__now"))
            factor = now.join(wanted[d], d).select(d, F.coalesce(F.try_divide("wanted", "__now"), F.lit(1.0)).alias("__f"))
            df = df.join(factor, d).withColumn("raw", F.least(F.lit(1e12), F.col("raw") * F.col("__f"))).drop("__f")
        after = Stored(df)
        moved = after.df.agg(F.max(F.abs(F.least(F.lit(1.0), F.col("raw")) - F.least(F.lit(1.0), F.col("__before"))))).first()[0] or 0.0
        state.drop()
        state = Stored(after.df.drop("__before"))
        after.drop()
        if moved < 1e-7:
            break
    return state.df.withColumn("probability", F.least(F.lit(1.0), F.col("raw")))


def _feasible_table(sums: DataFrame, rounds: int = 50) -> DataFrame:
    """``feasible`` for a frame (value, t, wanted) of any size."""
    for _ in range(rounds):
        lack, room = sums.agg(F.sum(F.greatest(F.lit(0.0), F.col("wanted") - F.col("t"))), F.sum(F.when((F.col("wanted") < F.col("t")) & (F.col("wanted") > 0), F.col("wanted")))).first()
        if not lack or lack < 1e-9 or not room:
            break
        grown = F.when((F.col("wanted") < F.col("t")) & (F.col("wanted") > 0), F.col("wanted") * F.lit(1.0 + lack / room)).otherwise(F.least("wanted", "t"))
        sums = Stored(sums.withColumn("wanted", grown)).df
    return sums.withColumn("wanted", F.least("wanted", "t"))


def cell_probabilities(described: DataFrame, fraction: float, targets: Mapping[str, Mapping[str, float]] | None = None, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool]:
    """(the dimensions, probability) for each cell, and whether they are few enough to broadcast."""
    spark = described.sparkSession
    cells = described.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens"))
    rows = sorted(cells.limit(max_cells + 1).collect())
    if len(rows) > max_cells:
        stored = Stored(cells).df
        budget = fraction * stored.agg(F.sum("tokens")).first()[0]
        wanted = {}
        for d in DIMENSIONS:
            sums = stored.groupBy(d).agg(F.sum("tokens").alias("t"))
            raw = F.pow("t", F.lit(TEMPER[d]))
            if targets and d in targets:
                given = spark.createDataFrame(list(targets[d].items()), f"{d} string, g double")
                sums = sums.join(given, d, "left")
                fixed, mass = sums.agg(F.sum("g"), F.sum(F.when(F.col("g").isNull(), F.col("t")))).first()
                left = max(0.0, 1.0 - (fixed or 0.0))
                raw = F.coalesce("g", F.lit(left) * F.col("t") / F.lit(mass or 1.0))
            total = sums.agg(F.sum(raw)).first()[0]
            asked = Stored(sums.select(d, "t", (raw / F.lit(total) * F.lit(budget)).alias("wanted"))).df
            wanted[d] = _feasible_table(asked).select(d, "wanted")
        return _rake_tables(stored, wanted, fraction).select(*DIMENSIONS, "probability"), False
    tokens = np.array([r.tokens for r in rows], dtype=float)
    codes, wanted = np.zeros((len(rows), 3), dtype=np.int64), []
    for d, name in enumerate(DIMENSIONS):
        values = sorted({r[name] for r in rows})
        at = {v: i for i, v in enumerate(values)}
        codes[:, d] = [at[r[name]] for r in rows]
        sums = dict(zip(values, np.bincount(codes[:, d], weights=tokens, minlength=len(values)).tolist()))
        share = shares(sums, (targets or {}).get(name), TEMPER[name])
        wanted.append(feasible(np.array([share[v] for v in values]) * fraction * tokens.sum(), np.array([sums[v] for v in values])))
    p = rake(codes, tokens, wanted, fraction)
    for d, name in enumerate(DIMENSIONS):
        gap = np.abs(np.bincount(codes[:, d], weights=p * tokens, minlength=len(wanted[d])) - wanted[d]).max(initial=0.0)
        if gap > GAP * fraction * tokens.sum():
            warnings.warn(f"{name}: the marginals contradict each other; a value misses its target by {gap:.0f} tokens (see report)", stacklevel=2)
    made = [(r[0], r[1], r[2], float(x)) for r, x in zip(rows, p)]
    return spark.createDataFrame(made, ", ".join(f"{d} string" for d in DIMENSIONS) + ", probability double"), True


def report(drawn: DataFrame, fraction: float, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(dimension, value, tokens, wanted, expected) for rows of ``mix`` or ``draw``: what was asked for and what will come.

    ``wanted`` is the target before it was made feasible; ``expected`` the tokens times their probabilities.
    """
    out = None
    for d in DIMENSIONS:
        sums = drawn.groupBy(F.col(d).alias("value")).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"))
        given = {k: float(v) for k, v in ((targets or {}).get(d) or {}).items()}
        everything = sums.agg(F.sum("tokens").alias("all"), F.sum(F.pow("tokens", F.lit(TEMPER[d]))).alias("damped"), F.sum(F.when(~F.col("value").isin(list(given)), F.col("tokens"))).alias("rest"))
        share = F.pow("tokens", F.lit(TEMPER[d])) / F.col("damped")
        if given:
            left = max(0.0, 1.0 - sum(given.values()))
            share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col("value")), F.lit(left) * F.col("tokens") / F.col("rest"))
        part = sums.join(F.broadcast(everything)).select(F.lit(d).alias("dimension"), "value", "tokens", (share * F.col("all") * F.lit(fraction)).alias("wanted"), "expected")
        out = part if out is None else out.unionByName(part)
    return out


def mix(
    docs: DataFrame, fraction: float = 0.7, targets: Mapping[str, Mapping[str, float]] | None = None, id_column: str = "doc_id",
    text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, seed: int = 17, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """``docs`` with its cell, token count, inclusion probability and whether the draw takes it (``sampled``)."""
    return draw(Stored(describe(docs, text, source, lang, topic)).df, fraction, targets, id_column, seed, max_cells)


def draw(
    described: DataFrame, fraction: float = 0.7, targets: Mapping[str, Mapping[str, float]] | None = None, id_column: str = "doc_id",
    seed: int = 17, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """The same for rows of ``describe``; they are read twice, so a caller without need of texts stores them first."""
    cells, few = cell_probabilities(described, fraction, targets, max_cells)
    uniform = F.shiftrightunsigned(F.xxhash64(F.col(id_column), F.lit(seed)), 11) / F.lit(2.0**53)
    joined = described.join(F.broadcast(cells) if few else cells, list(DIMENSIONS), "left")
    out = joined.withColumn("probability", F.coalesce("probability", F.lit(0.0))).withColumn("sampled", uniform < F.col("probability"))
    return out.select(*[F.col(f"`{c}`") for c in described.columns], "probability", "sampled")
