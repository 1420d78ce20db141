"""Packing of tokenised documents into sequences of fixed length: concatenate and cut.

All documents, each ended by ``end_id``, form one line of tokens that is cut every ``length`` tokens. The first pass
tokenises each partition once and stores, with the ids, the place of every document within its partition. The totals of
the partitions (one number for each task of a stage, which the driver schedules anyway) give each partition its place on
the line; the second pass adds the two and cuts. No window spans more than its own tokens, so no sort and no shuffle of
ids is needed: ``pieces`` tells where every document lies, and ``sequences`` makes the sequences, whole windows inside a
task and those that cross tasks from boundary records, which alone are shuffled.

The tables are stored before their totals are read: a task that is run again writes its own file anew, and no place
depends on anything but what lies in the files. Texts meet in the order of the table's files.

Defined results: null texts count as empty and give the end id alone; every row is packed, so a repeated row or id gives
pieces of its own, and null ids travel; an empty table gives no sequence; only the last sequence can be short: it is padded
to ``length`` unless its number of tokens is a power of two (``padding`` tells how much). Only the id and the text are
read, so other columns may have any names. Long texts are tokenised whole, a bounded number of words at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.llm.common import Stored, small_batches

LENGTH, END_ID = 2_048, 1
#: Words kept with their ids by a worker before the half that was not met again is forgotten, the longest such word, and
#: words encoded at once.
CACHE_WORDS, CACHE_CHARS, ENCODE_WORDS = 300_000, 40, 20_000
#: Bytes of ids in a batch that goes back to Spark.
BATCH_BYTES = 8_000_000


#: Words of Latin letters, with at most one sign behind them: the tokenizer parts these two and lower-cases the word.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([,.;:!?]?)")


class WordEncoder:
    """Ids of texts as little-endian 32-bit numbers, word by word: blanks and line ends part words for the tokenizer, so
    the ids of a text are those of its words. Words met before are looked up, plain new ones are encoded as one line and
    told apart by the mark that the tokenizer's vocabulary has at the ends of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {"": b""}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, words: list[str]) -> None:
        """Encodes ``words`` into ``known``."""
        known, older, split, plain, rest = self.known, self.older, {}, {}, []
        for word in words:
            if word in older:
                known[word] = older[word]
                continue
            found = PLAIN_WORD.fullmatch(word)
            if found:
                core = found[1].lower()
                split[word] = core, found[2]
                if core in older:
                    known[core] = older[core]
                elif core not in known:
                    plain[core] = None
                if found[2] not in known:
                    known[found[2]] = self._encode([found[2]])[0]
            else:
                rest.append(word)
        cores = list(plain)
        for at in range(0, len(cores), ENCODE_WORDS):
            part = cores[at : at + ENCODE_WORDS]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(part):  # a vocabulary without such marks
                known.update(zip(part, self._encode(part)))
                continue
            line_of, start = ids.tobytes(), 0
            for core, stop in zip(part, stops.tolist()):
                known[core], start = line_of[start:stop], stop
        for word, (core, sign) in split.items():
            known[word] = known[core] + known[sign]
        for at in range(0, len(rest), ENCODE_WORDS):
            part = rest[at : at + ENCODE_WORDS]
            known.update(zip(part, self._encode(part)))

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def ids(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        if len(self.known) > CACHE_WORDS:  # words that are met again move on from the older half
            self.older, self.known = self.known, {"": b""}
        new = set(words).difference(self.known)
        if new:
            self._learn(list(new))
        known = self.known
        out = b"".join([known[w] for w in words])
        for word in new:
            if len(word) > CACHE_CHARS:
                del known[word]
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process, so that tasks find the words of earlier ones."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> Stored:
    """(id, part, at, n_tokens, ids): the ids of each document with its end, and its place in its partition; stored."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([
        base.schema["id"], T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ])
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(tokenizer).ids, TaskContext.get().partitionId(), 0

        def made(keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal at
            sizes = [len(x) // 4 for x in ids]
            places = [at, *accumulate(sizes, initial=at)][1:-1]
            at += sum(sizes)
            arrays = [keys, pa.array([part] * len(ids), pa.int32()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "part", "at", "n_tokens", "ids"])

        for batch in batches:
            first, size, ids = 0, 0, []
            for k, text in enumerate(batch.column(1)):
                ids.append(encode(text.as_py() or "") + end)
                size += len(ids[-1])
                if size > BATCH_BYTES:
                    yield made(batch.column(0).slice(first, len(ids)), ids)
                    first, size, ids = k + 1, 0, []
            if ids:
                yield made(batch.column(0).slice(first, len(ids)), ids)

    return Stored(base.mapInArrow(run, schema))


def line(rows: DataFrame, size: Column | str = "n_tokens") -> tuple[DataFrame, int]:
    """``rows`` (part, at, ...) with ``place``, their place on the whole line, and how long the line is.

    Totals of partitions are one row for each task that wrote, so they are broadcast whatever the data.
    """
    totals = sorted(rows.groupBy("part").agg(F.sum(size).alias("n")).collect())
    before = list(accumulate((r.n for r in totals), initial=0))
    starts = rows.sparkSession.createDataFrame([(r.part, b) for r, b in zip(totals, before)], "part int, __before long")
    return rows.join(F.broadcast(starts), "part").withColumn("place", F.col("at") + F.col("__before")).drop("__before"), before[-1]


def padding(sequence: Column, total: int, length: int = LENGTH) -> Column:
    """How many places of a sequence stay empty: only the last is short, and a power of two is not padded."""
    rest = total % length
    short = length - rest if rest and rest & (rest - 1) else 0
    return F.when(sequence == total // length, F.lit(short)).otherwise(F.lit(0)).cast("long")


def pieces(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding): where the tokens of each document lie.

    ``rows`` are those of ``tokenised``. A piece is what one document has in one sequence.
    """
    placed, total = line(rows)
    window = f"""transform(sequence(place div {length}, (place + n_tokens - 1) div {length}), w -> named_struct(
        'start', greatest(w * {length} - place, 0L), 'length', least((w + 1) * {length} - place, n_tokens) - greatest(w * {length} - place, 0L),
        'sequence_id', w, 'offset', greatest(place - w * {length}, 0L)))"""
    hashed = "transform(cuts, c -> named_struct('cut', c, 'crc', crc32(substring(ids, int(c.start * 4 + 1), int(c.length * 4)))))"
    each = placed.withColumn("cuts", F.expr(window)).select("id", "n_tokens", F.expr(hashed).alias("cuts"))
    out = each.select("id", F.col("n_tokens").alias("doc_tokens"), F.explode("cuts").alias("c"))
    return out.select(
        "id", "c.cut.start", "c.cut.length", F.col("c.crc").alias("ids_crc32"), "doc_tokens", "c.cut.sequence_id", "c.cut.offset",
        padding(F.col("c.cut.sequence_id"), total, length).alias("padding"),
    )


def sequences(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, n_tokens, padding, ids): the sequences themselves, ids as little-endian 32-bit numbers.

    A task cuts whole windows out of each run of neighbouring documents that it reads. What is left at both ends of a run
    are boundary records; those of one window, of ``length`` tokens at most together, are joined by a shuffle.
    """
    placed, total = line(rows)
    schema = "sequence_id long, offset long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], 0  # tokens not given out yet, and the place behind them

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal held
            line_of = b"".join(held)
            place, out = at - len(line_of) // 4, []
            while line_of and (last or place // length != at // length):
                window, offset = divmod(place, length)
                take = min(length - offset, len(line_of) // 4)
                out.append((window, offset, line_of[: take * 4]))
                line_of, place = line_of[take * 4 :], place + take
            held = [line_of] if line_of else []
            columns = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["sequence_id", "offset", "ids"])

        for batch in batches:
            for place, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and place != at:
                    yield cut(True)
                held.append(ids.as_py())
                at = place + len(held[-1]) // 4
                if sum(map(len, held)) > BATCH_BYTES:
                    yield cut(False)
            if held:
                yield cut(False)
        if held:
            yield cut(True)

    cuts = placed.select("place", "ids").mapInArrow(run, schema).withColumn("n_tokens", F.expr("octet_length(ids) div 4").cast("long"))
    whole = cuts.where(F.col("n_tokens") == length).select("sequence_id", "n_tokens", "ids")
    parts = cuts.where(F.col("n_tokens") < length).groupBy("sequence_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    out = whole.unionByName(parts.select("sequence_id", "n_tokens", joined.alias("ids")))
    return out.select("sequence_id", "n_tokens", padding(F.col("sequence_id"), total, length).alias("padding"), "ids")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces of all documents, with the id under its own name."""
    return pieces(tokenised(docs, tokenizer, end_id, id_column, text_column).df, length).withColumnRenamed("id", id_column)
