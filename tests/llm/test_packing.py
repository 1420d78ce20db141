"""Packing against a plain concatenation, resampling against a plain computation and its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larkfield.llm import importance, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"Word{i % 900}" for i in range(9_000))
TEXTS = [
    (1, "Plain words of a text, don't they?"), (1, "Plain words of a text, don't they?"), (2, None), (3, ""), (None, "no id"), (4, LONG), (5, " \n\t\x85\x1c "),
    (6, "é é  İ Σας <|endoftext|>x a\x1cb 12,34"), (7, "x" * 5_000), *((i, f"text {i} " * (i % 90)) for i in range(8, 120)),
]
SCHEMA = "doc_id long, text string"


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, packing.END_ID]


@pytest.mark.parametrize("length", [64, 2_048])
def test_pieces_and_sequences_give_every_token_back(spark, length):
    docs = spark.createDataFrame(TEXTS, SCHEMA).repartition(5)
    rows = packing.tokenised(docs, PATH).df
    pieces, made = packing.pieces(rows, length).collect(), packing.sequences(rows, length).collect()
    at = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in made}
    assert sorted(at) == list(range(len(made))) and all(len(at[k]) == length for k in range(len(made) - 1))
    whole = Counter((i, tuple(plain_ids(t))) for i, t in TEXTS)
    total = sum(len(k[1]) * n for k, n in whole.items())
    assert sum(map(len, at.values())) == total
    inside = defaultdict(list)
    for p in pieces:
        ids = at[p.sequence_id][p.offset : p.offset + p.length]
        assert len(ids) == p.length > 0 and zlib.crc32(np.asarray(ids, "<u4").tobytes()) == p.ids_crc32
        inside[p.sequence_id].append((p.offset, p.length))
    for spans in inside.values():  # gapless from 0
        spans.sort()
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]]
    # Pieces follow one another along the line, so documents can be read off it.
    found, current = Counter(), []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.start == len(current)
        current += at[p.sequence_id][p.offset : p.offset + p.length]
        if len(current) == p.doc_tokens:
            found[p.id, tuple(current)] += 1
            current = []
    assert found == whole and not current
    rest = total % length
    short = length - rest if rest and rest & (rest - 1) else 0
    assert {p.padding for p in pieces if p.sequence_id == len(made) - 1} == {short} and all(p.padding == 0 for p in pieces if p.sequence_id < len(made) - 1)


def test_padding_stops_at_powers_of_two(spark):
    show = lambda total: spark.range(1).select(packing.padding(F.lit(total // 64).cast("long"), total, 64)).first()[0]
    assert [show(n) for n in (64 * 3 + 1, 64 * 3 + 32, 64 * 3 + 33, 64 * 3 + 3, 64 * 3)] == [0, 0, 31, 61, 0]


def test_packing_of_empty_tables_and_clashing_columns(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    docs = spark.createDataFrame(TEXTS[:3], SCHEMA).withColumns({c: F.lit("x") for c in "id part at n_tokens ids place start length sequence_id offset cuts".split()})
    assert packing.pack(docs, PATH).columns[0] == "doc_id" and packing.pack(docs, PATH).count() == 3


def test_cache_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 10)
    encoder = packing.WordEncoder(PATH)
    for _, text in TEXTS:
        assert encoder.ids(text or "") == np.asarray(plain_ids(text)[:-1], "<u4").tobytes()
        assert len(encoder.known) <= 10 + 2 * len(set((text or "").split())) + 8  # words, their cores, signs


# ---- resampling ----------------------------------------------------------------------------------


def plain_resample(docs, target, longest=1, buckets=10_000, min_words=20, percent=10):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [" ".join(words[i : i + n]) for i in range(len(words)) for n in range(1, longest + 1) if i + n <= len(words)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = fit[: percent * len(fit) // 100]
    return Counter((*r, k + 1) for k, r in enumerate(drawn)), Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("longest, nodes", [(1, 400_000), (3, 400_000), (3, 12), (1, 5)])
def test_resampling_equals_a_plain_computation(spark, monkeypatch, longest, nodes):
    monkeypatch.setattr(importance, "NODES", nodes)
    monkeypatch.setattr(importance, "STRETCH", 400_000 if nodes > 100 else 4)
    monkeypatch.setattr(importance, "RANGE_ROWS", 7)
    docs = [*TEXTS[:6], *TEXTS[7:], *((i, f"alpha{i % 7} beta Gamma{i % 3} grün 12 " * (i % 11)) for i in range(200, 500)), *[(999, "one hot id " * 9)] * 60]
    target = ["alpha1 beta gamma2", "beta beta grün", None, ""]
    out = importance.resample(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame([(x,) for x in target], "text string"), percent=30, longest=longest)
    got = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()]
    drawn, rows = plain_resample(docs, target, longest, percent=30)
    assert Counter(g[:5] for g in got) == rows and Counter(g for g in got if g[5]) == drawn
    assert sorted(g[5] for g in got if g[5]) == list(range(1, sum(drawn.values()) + 1))


def test_resampling_of_odd_tables(spark):
    docs, none = spark.createDataFrame(TEXTS[:5], SCHEMA), spark.createDataFrame([], "text string")
    assert {(r.n_features, r.weight, r["rank"]) for r in importance.resample(docs.where("text is null or text = ''"), none).collect()} == {(0, 0, None)}
    assert importance.resample(docs.limit(0), none).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in "id bucket n n_words n_features weight score rank part at place".split()})
    assert importance.resample(clash, none).count() == 5
    equal = importance.resample(spark.createDataFrame([(3, "w " * 30)] * 40, SCHEMA), none, percent=50).collect()
    assert sorted(r["rank"] or 0 for r in equal) == [0] * 20 + list(range(1, 21))
