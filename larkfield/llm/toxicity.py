"""Toxicity: Levenshtein automata intersected with a lexicon trie find terms and misspellings; context decides.

The lexicon is a fixed list of insults with terms and stems mined from labelled documents: words and prefixes that
toxic documents have and clean ones lack. Words run through one deterministic automaton, built lazily: its states are
sets of (trie node, edits), which is the product of the trie with the Levenshtein automata of all its terms; two
letters that changed places are one edit. Any letter may differ, the first too. Digits and symbols that look like
letters are read as these (``LOOKS``), a star as any vowel, and terms spelled out by hyphens, dots or spaces as one
word; misspellings that clean labelled documents contain are excepted. Hits inside quotation marks, or after reporting
words, count as quotation, the others as abuse; a logistic model on the counts, fitted on labelled documents that
mining did not see, gives the score.

Defined results: null and empty texts have no hits and get the score of the intercept; texts are read whole; without
labels of both classes the fixed lexicon and fixed weights are used; repeated rows score alike; of terms equally close
to a word any stands for the hit, since only the edits count; an empty table stays empty; input columns of the names
written are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.llm import labelled
from larkfield.llm.common import append_columns

#: Insults of the starting lexicon, and the words that announce quotation or address a person.
INSULTS = (
    "idiot moron stupid loser trash scum clown pathetic worthless disgusting imbecile retard bastard bitch whore slut "
    "asshole dickhead scumbag dumbass filth vermin cretin dimwit shithead fucker fuck fucking shit piss cunt douchebag"
).split()
REPORTING = frozenset(
    "said says say called calls quoted quote quotes wrote writes word words term terms phrase slur insult insults "
    "sagte nannte wort zitat dit appelé mot terme dijo llamó palabra término".split()
)
ADDRESS = frozenset("you your you're youre du dein dich tu ton toi vous tú usted te".split())
#: At most so many labelled documents are used for mining and fitting.
SAMPLE = 8_000
THRESHOLD, WINDOW = 0.7, 4
#: Tasks that read the stored sample or its words at most, as each task builds the automaton anew.
TASKS = 8
WORD = re.compile(r"[^\W\d_]+")
JOINED = re.compile(r"[\d@$!]*[^\W\d_]+(?:[\d_@$*!]+[^\W\d_]+)*")
SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:[-._* ][^\W\d_]){3,}(?![^\W_])")
#: The letters of ``WORD`` for Spark's regular expressions.
LETTERS = "([\\p{L}\\p{Nl}\\p{No}]+)"
#: Letters that digits and symbols stand for.
LOOKS = str.maketrans("0134578@$!", "oieastbasi")
OPENING, CLOSING = frozenset("\"“«„‹"), frozenset("\"”»“›")
MARK = re.compile(r"[\"“«„‹”»›\n]")
_DEAD, _PLACES = -1, 1 << 40


def edits_allowed(term: str, stem: bool) -> int:
    if stem:
        return 0
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """The automaton of all words within the allowed edits of a term, or that begin with a stem."""

    def __init__(self, terms: list[tuple[str, bool]], excepted: frozenset[str] = frozenset()):
        self.terms, self.excepted = sorted(set(terms)), excepted
        self._build()

    def __reduce__(self):
        return Matcher, (self.terms, self.excepted)

    def _build(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.final: list[int] = [_DEAD]  # edits allowed at the end of a term
        self.stem: list[bool] = [False]
        self.budget: list[int] = [0]  # the most that a term below allows
        for term, stem in self.terms:
            node, allowed = 0, edits_allowed(term, stem)
            for c in term:
                self.budget[node] = max(self.budget[node], allowed)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.final.append(_DEAD)
                    self.stem.append(False)
                    self.budget.append(0)
                node = self.children[node][c]
            self.budget[node] = max(self.budget[node], allowed)
            self.final[node] = max(self.final[node], allowed)
            self.stem[node] = self.stem[node] or stem
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accept: list[int] = []
        self.known: dict[str, int] = {}
        self.clear: set[str] = set()
        self.start = self._state({0: 0}, None)

    def _state(self, nodes: dict[int, int], absorbed: int | None) -> int:
        """A node above ``_PLACES`` waits for the first of two letters that changed places."""
        todo = [x for x in nodes.items() if x[0] < _PLACES]
        while todo:
            node, e = todo.pop()
            if nodes[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and nodes.get(child, 9) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        for node, e in nodes.items():
            if node < _PLACES and self.stem[node] and (absorbed is None or e < absorbed):
                absorbed = e
        key = (tuple(sorted(nodes.items())), absorbed)
        if key in self.states:
            return self.states[key]
        at = self.states[key] = len(self.sets)
        ends = [e for node, e in nodes.items() if node < _PLACES and self.final[node] >= e and not self.stem[node]]
        ends += [] if absorbed is None else [absorbed]
        self.sets.append(key)
        self.moves.append({})
        self.accept.append(min(ends, default=_DEAD))
        return at

    def _move(self, state: int, c: str) -> int:
        pairs, absorbed = self.sets[state]
        nodes: dict[int, int] = {}
        for node, e in pairs:
            if node >= _PLACES:
                options = [(node % _PLACES, e)] if ord(c) == node // _PLACES else []
            else:
                options = [(node, e + 1), *((child, e + (letter != c)) for letter, child in self.children[node].items())]
                for letter, child in self.children[node].items():
                    to = self.children[child].get(c) if letter != c else None
                    if to is not None and e + 1 <= self.budget[to]:
                        key = to + _PLACES * ord(letter)
                        nodes[key] = min(e + 1, nodes.get(key, 9))
            for to, cost in options:
                if cost <= self.budget[to] and cost < nodes.get(to, 9):
                    nodes[to] = cost
        out = _DEAD if not nodes and absorbed is None else self._state(nodes, absorbed)
        self.moves[state][c] = out
        return out

    def edits(self, word: str) -> int:
        """The edits of the closest term, or -1; excepted misspellings match nothing."""
        found = self.known.get(word)
        if found is None:
            state = self.start
            for c in word:
                nxt = self.moves[state].get(c)
                state = self._move(state, c) if nxt is None else nxt
                if state == _DEAD:
                    break
            found = _DEAD if state == _DEAD else self.accept[state]
            if found > 0 and word in self.excepted:
                found = _DEAD
            if len(self.known) > 400_000:
                self.known.clear()
            self.known[word] = found
        return found

    def disguised(self, word: str) -> int:
        """The edits of a word that holds digits or symbols, read as the letters that they look like."""
        plain = word.translate(LOOKS)
        forms = {plain, word.replace("1", "l").translate(LOOKS)}
        if "*" in word:
            forms = {f.replace("*", vowel) for f in forms for vowel in "aeiou"}
        found = [e for f in forms if f.isalpha() and (e := self.edits(f)) >= 0]
        return max(1, min(found)) if found else self.edits(word)

    def counts(self, text: str | None) -> tuple[int, int, int, int]:
        """(exact abuse, misspelled abuse, quoted hits, abuse near a word of address)."""
        lower = (text or "").lower()
        edits = self.edits
        lower = SPELLED.sub(lambda m: w if edits(w := "".join(WORD.findall(m[0]))) == 0 else m[0], lower)
        words = JOINED.findall(lower)
        hits: dict[str, int] = {}
        mixed: set[str] = set()
        none: set[str] = set()  # words of letters that are no hits, which later texts skip at once
        for w in set(words).difference(self.clear):
            if w.isalpha():
                e = edits(w)
                if e < 0:
                    none.add(w)
            else:
                e = self.disguised(w)
                if e < 0:
                    mixed.add(w)
            if e >= 0:
                hits[w] = e
        if len(self.clear) > 400_000:
            self.clear.clear()
        self.clear |= none
        # A word with digits or symbols that is no hit is read as its parts.
        hits |= {p: e for w in mixed for p in WORD.findall(w) if (e := edits(p)) >= 0}
        if not hits:
            return 0, 0, 0, 0
        spans = quotations(lower)
        begins: list[int] = []
        if spans or mixed:
            listed = list(_words(lower, mixed))
            words, begins = [w for w, _ in listed], [b for _, b in listed]
        places = [i for i, w in enumerate(words) if w in hits]
        exact = misspelled = quoted = aimed = at = 0
        ahead = 0  # words of the window after an abusive hit that may still hold an address
        for i, following in zip(places, [*places[1:], len(words)]):
            recent = words[max(0, i - WINDOW) : i]
            while at < len(spans) and spans[at][1] <= begins[i]:
                at += 1
            if (at < len(spans) and spans[at][0] <= begins[i]) or REPORTING.intersection(recent):
                quoted += 1
            else:
                edited = hits[words[i]] > 0
                exact += not edited
                misspelled += edited
                aimed += bool(ADDRESS.intersection(recent))
                ahead = WINDOW
            for word in words[i + 1 : min(following, i + 1 + ahead)]:
                ahead -= 1
                if word in ADDRESS:
                    aimed, ahead = aimed + 1, 0
                    break
        return exact, misspelled, quoted, aimed


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans from an opening mark to the next closing one in its line, in one pass."""
    spans, begin = [], None
    for m in MARK.finditer(text):
        if m[0] == "\n":
            begin = None
        elif begin is None:
            begin = m.start() if m[0] in OPENING else None
        elif m[0] in CLOSING:
            spans.append((begin, m.end()))
            begin = None
    return spans


def _words(text: str, mixed: set[str]) -> Iterator[tuple[str, int]]:
    for m in JOINED.finditer(text):
        if m[0] in mixed:
            yield from ((p[0], m.start() + p.start()) for p in WORD.finditer(m[0]))
        else:
            yield m[0], m.start()


@dataclass(frozen=True)
class ToxicityModel:
    matcher: Matcher
    weights: tuple[float, ...] = field(default=(-3.5, 3.5, 1.0, 1.5, 0.6, 0.4, 0.4))

    def score(self, text: str | None) -> float:
        z = float(np.dot(design(self.matcher.counts(text)), self.weights))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def design(counts: tuple[int, int, int, int]) -> list[float]:
    exact, misspelled, quoted, aimed = counts
    return [1.0, float(exact > 0), np.log1p(exact), float(misspelled > 0), np.log1p(misspelled), np.log1p(quoted), np.log1p(aimed)]


def _fit_weights(rows: list[list[float]], y: list[int], prior: tuple[float, ...], strength: float = 0.5) -> tuple[float, ...]:
    x, t, start = np.array(rows), np.array(y, dtype=float), np.array(prior)
    w = start.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (p - t) + strength * (w - start))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def mine(drawn: DataFrame) -> tuple[list[tuple[str, bool]], DataFrame]:
    """Terms and stems of a labelled sample, and its words with the numbers of toxic and clean documents."""
    words = drawn.select("id", "label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), 1))).alias("word"))
    counted = words.where("length(word) >= 3").groupBy("word").agg(
        F.count(F.when(F.col("label") > 0, 1)).alias("toxic"), F.count(F.when(F.col("label") <= 0, 1)).alias("clean")
    )
    telling = counted.where("toxic >= 5 and clean * 40 <= toxic")
    terms = [(r.word, False) for r in telling.select("word").collect()]  # bounded by the words of the sample
    # Stems are counted over the words of toxic documents only; clean words count against their prefixes.
    prefixes = counted.where("length(word) >= 4").select("toxic", "clean", F.explode(F.expr("transform(sequence(4, least(8, length(word))), n -> substring(word, 1, n))")).alias("stem"))
    stems = prefixes.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.when(F.col("toxic") > 0, 1)).alias("forms"))
    kept = stems.where("toxic >= 8 and forms >= 3 and clean * 40 <= toxic")
    found = sorted(r.stem for r in kept.collect())
    known = set(found)
    shortest = [s for s in found if not any(s[:n] in known for n in range(4, len(s)))]
    return terms + [(s, True) for s in shortest], counted


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", limit: int = SAMPLE) -> ToxicityModel:
    """Mines on 7 of 10 sampled documents, fits the weights on the others, then mines again on all of them."""
    drawn = labelled.sample(docs, labels, label, learn, limit).persist()
    try:
        part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(10))
        first = _matcher(drawn.where(part < 7))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [first.counts(t) for t in batch.column(1).to_pylist()]
                arrays = [batch.column(2), *[pa.array([m[i] for m in made], pa.int64()) for i in range(4)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["label", "a", "b", "c", "d"])

        seen = drawn.where(part >= 7).coalesce(TASKS).mapInArrow(count, "label int, a long, b long, c long, d long").collect()
        seen.sort()
        prior = ToxicityModel.__dataclass_fields__["weights"].default
        weights = _fit_weights([design(tuple(r[1:])) for r in seen], [r.label for r in seen], prior) if len({r.label for r in seen}) > 1 else prior
        return ToxicityModel(_matcher(drawn), weights)
    finally:
        drawn.unpersist()


def _matcher(drawn: DataFrame) -> Matcher:
    terms, counted = mine(drawn)
    counted = counted.persist()
    try:
        fixed = [(t, False) for t in INSULTS]
        bad = {r.word for r in counted.where(F.col("word").isin(INSULTS) & (F.col("clean") > F.col("toxic"))).collect()}
        base = Matcher([t for t in fixed if t[0] not in bad] + terms)

        def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [w for w in batch.column(0).to_pylist() if base.edits(w) > 0]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

        # Clean words within the edits of a term: bounded by the terms, as each has a bounded number of variants.
        clean = counted.where("clean > 0 and clean * 4 >= toxic").select("word").coalesce(TASKS).mapInArrow(variants, "word string")
        return Matcher(base.terms, frozenset(r.word for r in clean.collect()))
    finally:
        counted.unpersist()


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from the threshold on) and the four counts behind them."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = ["abuse", "misspelled", "quoted", "aimed"]
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in names]

    def compute(texts: list) -> dict:
        model = shipped.value
        found = [model.matcher.counts(t) for t in texts]
        z = [float(np.dot(design(c), model.weights)) for c in found]
        scores = [float(1 / (1 + np.exp(-np.clip(v, -30, 30)))) for v in z]
        out = {"score": scores, "predicted": [int(s >= threshold) for s in scores]}
        return out | {n: [c[i] for c in found] for i, n in enumerate(names)}

    return append_columns(docs, text, fields, compute)
