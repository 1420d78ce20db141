"""Benchmark decontamination by spaced seeds: masks ignore fixed token positions, so that hits survive substitutions.

Benchmark items become hashes of the tokens at the kept positions of each mask; the windows of every document are
joined with them, as are consecutive stretches of each item, one more than the substitutions that ``IDENTITY``
allows, so that one of them is always whole, and short seeds at every place of an item, of which every run that counts
holds one. Every hit is verified along its diagonal over the whole item. A document is contaminated by an item if, at one
alignment, ``IDENTITY`` of all item tokens agree, or ``IDENTITY`` of a run of ``RUN`` tokens or more that begins and ends
with agreeing ones. An item of fewer than ``LEAST`` tokens matches documents that consist of its tokens and nothing else.

The index of one block of items is sorted arrays (about 60 bytes a token), sent to all executors, and a block holds at
most ``BLOCK_CHARS`` characters of items; a larger benchmark is scanned in further blocks, each against all documents.
Documents are never shuffled.

Defined results: null and empty texts have no tokens and never match, nor do items without tokens; repeated documents
are reported once each row, rows of an item that repeat count once; of alignments with equally many agreeing tokens the first
in the document is reported; null ids are carried along; other columns of the documents, whatever their names, are
left out by ``overlaps`` and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from larkfield.llm.common import append_columns, small_batches

TOKEN = re.compile(r"\w+")
MASKS = ("110110101011", "101110010111", "11101001110")
#: Every run that counts has four agreeing tokens in a row; the one exception, threes with three other tokens between, has
#: two threes one token apart.
RUN_MASKS = ("1111", "1110111")
LEAST, RUN, IDENTITY = 5, 13, 0.8
BLOCK_CHARS = 4_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def token_hashes(ts: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((known[t] if t in known else known.setdefault(t, digest(t.encode("utf-8", "surrogatepass"))) for t in ts), dtype=np.uint64, count=len(ts))


def _hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each window of the mask, of the tokens at its kept positions."""
    n = len(ids) - len(mask) + 1
    out = np.full(max(0, n), len(mask), dtype=np.uint64)
    for i, c in enumerate(mask):
        if c == "1" and n > 0:
            out = (out + ids[i : i + n]) * _MULTIPLIER
            out ^= out >> np.uint64(29)
    return out


def _stretches(n: int) -> list[tuple[int, int]]:
    """An item of ``n`` tokens in one more part than it may have tokens that differ: one part agrees in full."""
    parts = n - math.ceil(IDENTITY * n) + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


class SeedIndex:
    """Token hashes and sorted seed hashes of a block of benchmark items."""

    def __init__(self, items: list[tuple]):
        self.ids, self.short = [], {}
        parts, stretches = [], {}
        end = 0
        for item, text in items:
            ts = tokens(text)
            if len(ts) < LEAST:
                if ts:
                    self.short.setdefault(tuple(ts), []).append(len(self.ids))
                    self.ids.append(item)
                    parts.append(np.zeros(0, dtype=np.uint64))
                continue
            for lo, hi in _stretches(len(ts)):
                stretches.setdefault("1" * (hi - lo), []).append(end + lo)
            if len(ts) >= RUN:
                for mask in RUN_MASKS:
                    stretches.setdefault(mask, []).extend(range(end, end + len(ts) - len(mask) + 1))
            self.ids.append(item)
            parts.append(token_hashes(ts))
            end += len(ts)
        self.flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.seeds: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for mask in (*MASKS, *sorted(stretches)):
            hs = _hashes(self.flat, mask)
            if mask in stretches:
                at = np.unique(np.array(stretches[mask], dtype=np.int64))
            else:
                at = np.arange(len(hs))
                at = at[at + len(mask) <= self.ends[self._item(at)]] if len(at) else at
            if len(at):
                order = np.argsort(hs[at], kind="stable")
                self.seeds[mask] = (hs[at][order], at[order])
        bits = max(12, *((8 * len(h)).bit_length() for h, _ in self.seeds.values()), 0)
        self.shift = np.uint64(64 - bits)
        self.present = {m: np.zeros(1 << bits, dtype=bool) for m in self.seeds}
        for m, (h, _) in self.seeds.items():
            self.present[m][h >> self.shift] = True

    def _item(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def _diagonals(self, ids: np.ndarray) -> np.ndarray:
        """Distinct (item, place in the document where the item would begin) of all seeds that document and items share."""
        found = []
        for mask, (h, at) in self.seeds.items():
            hs = _hashes(ids, mask)
            pos = np.flatnonzero(self.present[mask][hs >> self.shift])
            if not len(pos):
                continue
            lo, hi = np.searchsorted(h, hs[pos], side="left"), np.searchsorted(h, hs[pos], side="right")
            n = hi - lo
            total = int(n.sum())
            if total:
                where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                item = self._item(at[where])
                found.append(np.stack([item, np.repeat(pos, n) - (at[where] - self.starts[item])], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)

    def overlaps(self, text: str | None) -> list[tuple]:
        """(item, agreeing tokens, item tokens, first token in the document) for each item found, the best alignment."""
        ts = tokens(text)
        if not ts:
            return []
        out = [(self.ids[at], len(ts), len(ts), 0) for at in self.short.get(tuple(ts), ())] if len(ts) < LEAST else []
        if not self.seeds:
            return out
        ids = token_hashes(ts)
        best: dict[int, tuple] = {}
        for at, diagonal in self._diagonals(ids).tolist():
            item = self.flat[self.starts[at] : self.ends[at]]
            lo, hi = max(0, -diagonal), min(len(item), len(ids) - diagonal)
            same = item[lo:hi] == ids[lo + diagonal : hi + diagonal]
            agree = int(same.sum())
            if (agree >= IDENTITY * len(item) or _run(same)) and agree > best.get(at, (0,))[0]:
                best[at] = (agree, diagonal + lo)
        return out + [(self.ids[at], agree, int(self.ends[at] - self.starts[at]), start) for at, (agree, start) in best.items()]


def _run(same: np.ndarray) -> bool:
    """Whether any stretch of RUN tokens or more, from one agreeing token to another, agrees in IDENTITY of them.

    With so much for an agreeing token and so much off for another that IDENTITY sums to nought, such a stretch is two
    prefix sums, RUN places or more apart, of which the second is not less: the least earlier one is carried along.
    """
    if len(same) < RUN or np.count_nonzero(same) < RUN * IDENTITY:
        return False
    gain, cost = round(100 * (1 - IDENTITY)), round(100 * IDENTITY)
    sums = np.concatenate([[0], np.cumsum(np.where(same, gain, -cost))])
    begins = np.minimum.accumulate(np.where(same, sums[:-1], np.iinfo(np.int64).max))[: len(same) - RUN + 1]
    return bool(np.any(same[RUN - 1 :] & (sums[RUN:] >= begins)))


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[SeedIndex]:
    chars = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(1, -(-int(chars) // BLOCK_CHARS))
    rows = benchmark.select(item, text).where(F.col(text).isNotNull()).distinct()
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == k) if n > 1 else rows
        yield SeedIndex([tuple(r) for r in own.collect()])


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(id, item, n_agree, n_item, identity, start_token): each document row with each item that it contains."""
    spark, out = docs.sparkSession, None
    small_batches(spark)
    kind = benchmark.schema[item].dataType
    schema = T.StructType([
        docs.schema[id_column], T.StructField(item, kind), T.StructField("n_agree", T.LongType()),
        T.StructField("n_item", T.LongType()), T.StructField("start_token", T.LongType()),
    ])
    for index in _blocks(benchmark, item, item_text):
        shipped = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for hit in shipped.value.overlaps(t):
                        rows.append(i)
                        found.append(hit)
                columns = [list(c) for c in zip(*found)] if found else [[]] * 4
                ids = batch.column(0).take(pa.array(rows, type=pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(c, t) for c, t in zip(columns, [to_arrow_type(kind), pa.int64(), pa.int64(), pa.int64()])]], names=schema.names
                )

        part = docs.select(id_column, text).mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("identity", F.col("n_agree") / F.col("n_item"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that contain an item."""
    columns = docs.columns
    for index in _blocks(benchmark, item, item_text):
        shipped = docs.sparkSession.sparkContext.broadcast(index)
        flag = T.StructField("__contaminated", T.BooleanType())
        marked = append_columns(docs, text, [flag], lambda texts, s=shipped: {flag.name: [bool(s.value.overlaps(t)) for t in texts]})
        docs = marked.where("not __contaminated").select(*[F.col(f"`{c}`") for c in columns])
    return docs
