"""Quality rules: a linear-chain CRF marks each line as content or boilerplate; the content share decides.

The model is trained once a driver process on lines from a seeded generator (``training_lines``), so it needs no
table. Documents are read whole. A null text counts as an empty one: no words, ``base_failed`` true, not kept.
Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkfield.llm import crf
from larkfield.llm.common import WORD, append_columns

SYMBOLS = "#*$%&|<>"
#: Words of notices and page furniture.
NOTICE_WORDS = frozenset(
    "copyright license licensed licence rights reserved cookie cookies privacy subscribe newsletter login signup "
    "sign register terms conditions click download advertisement sponsored share tweet menu home contact sitemap "
    "lizenz licencia derechos reservados datenschutz impressum mentions légales warranty apache mit gpl".split()
)
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT, MIN_SHARE = 8, 20, 30, 0.5
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("content_share", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def line_quality(docs: DataFrame, text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` with the counts, the content share of the decoded lines and the verdict ``kept``."""
    model = line_model()

    def compute(texts: list) -> dict:
        rows = [judge(t or "", model, min_share) for t in texts]
        return {f.name: [r[i] for r in rows] for i, f in enumerate(FIELDS)}

    return append_columns(docs, text, FIELDS, compute)


def judge(text: str, model: crf.Crf, min_share: float = MIN_SHARE) -> tuple:
    lines = [(line, words) for line in text.split("\n") if (words := WORD.findall(line))]
    words = [w for _, ws in lines for w in ws]
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    seen: set[str] = set()
    copies = []
    for line, _ in lines:
        copies.append(line in seen)
        seen.add(line)
    chars = [sum(map(len, ws)) for _, ws in lines]
    labels = model.decode(line_features(lines, copies))
    total = sum(chars)
    share = sum(c for c, k in zip(chars, labels) if k) / total if total else 0.0
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), total, symbols, sum(copies), repeats, failed, share, not failed and share >= min_share


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words (a power of two) that the text has twice or more.

    Windows get equal numbers if and only if they are equal: the numbers of halves are paired and renumbered.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    width = 1
    while width < window:
        pairs = ids[:-width] * (len(words) + 1) + ids[width:]
        ids = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def line_features(lines: list[tuple[str, list[str]]], copies: list[bool]) -> np.ndarray:
    out = np.zeros((len(lines), 23))
    for row, (line, words), copy in zip(out, lines, copies):
        n, size = len(words), sum(map(len, words))
        symbols = sum(map(line.count, SYMBOLS)) / size
        letters = sum(map(str.isalpha, line))
        upper = sum(map(str.isupper, line)) / letters if letters else 0.0
        digits = sum(map(str.isdigit, line)) / size
        other = 1 - letters / size - digits
        notice = sum(w.strip(".,:;!?()").lower() in NOTICE_WORDS for w in words) / n
        mean = size / n
        distinct = len(set(words)) / n
        same = sum(map(str.__eq__, words, words[1:])) / n
        last = words[-1][-1]
        row[:] = (
            1, n <= 3, 3 < n <= 8, 8 < n <= 25, n > 25, symbols > 0.02, symbols > 0.1, upper > 0.3, upper > 0.7,
            digits > 0.1, digits > 0.4, other > 0.15, other > 0.3, notice > 0, notice >= 0.25, mean > 14, mean < 2,
            n >= 8 and distinct < 0.5, last in ".!?…\"'»”:;,)", line.count("!!") >= 2 or "|" in line, copy,
            0.1 < same <= 0.4, same > 0.4,
        )
    return out


def training_lines(documents: int = 400, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Generated documents as lines with labels (1 content, 0 boilerplate)."""
    rng = random.Random(seed)
    alphabets = ["etaoinshrdlu", "enisratdhulä", "esaitnruléèç", "eaosrnidlcóñ", "абвгдежзиклм", "αβγδεζηθικλμ"]
    notices = sorted(NOTICE_WORDS)

    def word(letters: str) -> str:
        return "".join(rng.choice(letters) for _ in range(min(rng.randint(1, 7) + rng.randint(0, 6), 14)))

    def prose(letters: str) -> str:
        sentences = []
        for _ in range(rng.randint(1, 6)):
            ws = [word(letters) for _ in range(rng.choice([2, 4, 6, 9, 14, 22]))]
            if rng.random() < 0.1:
                ws[-1] = str(rng.randint(0, 9999))
            if rng.random() < 0.3:
                ws[len(ws) // 2] += ","
            sentences.append(" ".join([ws[0].capitalize(), *ws[1:]]) + rng.choice([".", ".", ".", "!", "?", "", ":"]))
        return " ".join(sentences)

    def junk(letters: str, kind: int) -> str:
        ws = [word(letters) for _ in range(rng.randint(1, 30))]
        if kind == 0:
            return " ".join(w + rng.choice(["###", "***", "$$$", "%%%", "&&&", "<<", ">>"]) for w in ws)
        if kind == 1:
            return " ".join(w.upper() + "!!" for w in ws)
        if kind == 2:
            return " | ".join(ws)
        if kind == 3:
            return " ".join(rng.sample(notices, rng.randint(1, 4)) + ws[: rng.randint(0, 3)]).capitalize()
        if kind == 4:
            return " ".join("".join(rng.choice("0123456789-/.:") for _ in range(rng.randint(3, 12))) for _ in ws[:6])
        if kind == 5:
            return rng.choice("-=*_#~") * rng.randint(3, 40)
        if kind == 6:
            return " ".join([ws[0].upper()] * rng.randint(3, 12))
        if kind == 8:
            return " ".join(w for w in ws[:8] for _ in range(rng.choice([2, 4, 7]))).capitalize() + "."
        return " ".join(f"{w}=" + "".join(rng.choice("<>{}[]();&|$#") for _ in range(5)) for w in ws)

    out = []
    for _ in range(documents):
        letters, kind = rng.choice(alphabets), rng.randint(0, 8)
        bad, lines, labels = rng.choice([0.0, 0.05, 0.2, 0.6, 0.95, 1.0]), [], []
        state = rng.random() < bad
        for _ in range(rng.randint(1, 16)):
            state = (rng.random() < bad) if rng.random() < 0.4 else state
            kind = rng.randint(0, 8) if rng.random() < 0.3 else kind
            lines.append(junk(letters, kind) if state else prose(letters))
            labels.append(int(not state))
            if state and rng.random() < 0.15:
                lines.append(lines[-1])
                labels.append(0)
        out.append((lines, labels))
    return out


def encode(lines: list[str]) -> np.ndarray:
    pairs = [(line, WORD.findall(line)) for line in lines]
    return line_features(pairs, [line in lines[:i] for i, line in enumerate(lines)])


@lru_cache(maxsize=1)
def line_model() -> crf.Crf:
    return crf.fit([(encode(lines), labels) for lines, labels in training_lines()])
