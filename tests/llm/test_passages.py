"""Passages against brute force over all pairs of texts: edits, templates, several passages, hot groups, repeated rows."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from larkfield.llm import substring_dedup as sub

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return [f"w{rng.randrange(6000)}x{rng.randrange(9)}" for _ in range(n)]


def edited(rng, passage, edits):
    out = list(passage)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [f"new{rng.randrange(10**6)}"]
    return out


def brute(texts):
    """Pairs of texts that have a passage, by all shifts at which they share a shingle."""
    hashes = {i: sub.shingle_hashes(sub.words_of(t)) for i, t in texts.items()}
    found = {}
    for a, b in itertools.combinations(sorted(hashes), 2):
        at = defaultdict(list)
        for j, s in enumerate(hashes[b].tolist()):
            at[s].append(j)
        shifts = {j - i for i, s in enumerate(hashes[a].tolist()) for j in at.get(s, ())}
        rows = sub._passages(hashes[a], hashes[b], sorted(shifts)) if shifts else []
        if rows:
            found[a, b] = rows
    return found


def run(spark, rows):
    out = sub.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = {i: t.split() for i, t in rows if t}
    classes = defaultdict(set)
    for r in out:
        x, y = texts[r.doc_id][r.start_word : r.end_word], texts[r.partner_id][r.partner_start : r.partner_end]
        left, right = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (x, y))
        assert len(x) >= 50 and len(y) >= 50 and len(left & right) >= 0.8 * len(left | right)
        if r.passage_id is not None:
            classes[r.passage_id].add(r.doc_id)
    return out, classes


def lost(pairs, classes):
    linked = {p for c in classes.values() for p in itertools.combinations(sorted(c), 2)}
    return set(pairs) - linked


@pytest.fixture(scope="module")
def corpus():
    """Exact and edited passages (up to 1 edit in 50 words), templates of two passages round other middles, a frequent line."""
    rng = random.Random(5)
    line, passages = words(rng, 20), [words(rng, n) for n in (51, 55, 60, 80, 140)]
    p, q = words(rng, 60), words(rng, 70)
    rows = []
    for d in range(150):
        text = words(rng, rng.randint(20, 160))
        if d % 3 == 0:
            text[len(text) // 2 : len(text) // 2] = line
        if d % 4 == 1:
            passage = rng.choice(passages)
            at = rng.randrange(len(text))
            text[at:at] = edited(rng, passage, rng.randrange(1 + len(passage) // 50) if d % 8 == 1 else 0)
        if d % 10 == 0:
            text = p + words(rng, rng.randint(20, 120)) + q + words(rng, 10)
        rows.append((d, " ".join(text)))
    return rows


def test_every_pair_is_in_one_class(spark, corpus):
    pairs = brute(dict(corpus))
    out, classes = run(spark, corpus)
    assert len(pairs) > 200 and not lost(pairs, classes)
    assert {r.doc_id for r in out} == {d for pair in pairs for d in pair}


def test_both_passages_of_a_template_are_reported(spark, corpus):
    out, _ = run(spark, [r for r in corpus if r[0] in (0, 10)])
    n = {d: len(t.split()) for d, t in corpus}
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in out) == sorted((d, *s) for d in (0, 10) for s in ((0, 60), (n[d] - 80, n[d] - 10)))


@pytest.mark.parametrize("block", [8, 4096])
def test_hot_passages_lose_no_text_and_no_longer_passage(spark, monkeypatch, block):
    rng = random.Random(21)
    hot, own, line = words(rng, 60), words(rng, 70), words(rng, 24)
    rows = []
    for d in range(90):
        body = edited(rng, hot, 1) if d % 9 == 4 else hot
        tail = own if d in (7, 61) else line if d % 2 else []
        rows.append((d, " ".join(words(rng, 40) + (body if d < 70 else []) + tail + words(rng, 40))))
    rows += [(100 + d, " ".join(words(rng, 10) + line + words(rng, 60))) for d in range(40)]
    monkeypatch.setattr(sub, "BLOCK", block)
    monkeypatch.setattr(sub, "TEXTS", 16)
    out, classes = run(spark, rows)
    pairs = brute(dict(rows))
    assert not lost(pairs, classes) and {r.doc_id for r in out} == {d for pair in pairs for d in pair}
    assert len(out) < (10 * 70 if block > 90 else 69 * 70)
    assert 130 in {r.n_words for r in out if (r.doc_id, r.partner_id) == (7, 61)}


def test_large_groups_link_all_windows_that_agree(spark, monkeypatch):
    """All places that an edited pair has in line with an anchor are those of a line that many other texts have."""
    rng, line = random.Random(5), words(random.Random(2), 30)
    rows = []
    for d in range(0, 240, 2):
        left = words(rng, 29)
        rows += [(d, " ".join(words(rng, 20) + left + line + words(rng, 20))), (d + 1, " ".join(words(rng, 25) + left + words(rng, 1) + line + words(rng, 9)))]
    shingles = sub.shingle_hashes([w.encode() for w in line])
    anchors = [int(h) for fn in range(sub.FUNCTIONS) for h in (np.maximum(sub.hashed(shingles, fn), np.uint64(1)) ^ sub._SEEDS[fn]).view(np.int64)]
    made, seen = sub._with_sketches, []

    def in_the_line(windows, texts):
        seen.append(made(windows.where(windows.h.isin(anchors)), texts).persist())
        return seen[-1]

    monkeypatch.setattr(sub, "BLOCK", 16)
    monkeypatch.setattr(sub, "_with_sketches", in_the_line)
    links = sub.window_links(spark.createDataFrame(rows, "text_key long, text string")).collect()
    root = list(range(240))
    for r in links:
        x, y = sub._root(root, r.a), sub._root(root, r.b)
        root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for r in (r for df in seen for r in df.collect()):
        groups[r.h].append((r.text_key, np.frombuffer(bytes(r.sketch), dtype=np.uint8)))
    agree = {(a, b) for g in groups.values() for a, x in g for b, y in g if a // 2 == b // 2 and a < b and sub._agree(x, y[None])[0]}
    assert len(agree) > 40 and all(sub._root(root, a) == sub._root(root, b) for a, b in agree)


def test_recall_of_edited_passages_at_the_limit():
    """Lone pairs: the share of passages at 0.8 or more that some window links."""
    rng, hit, n = random.Random(8), 0, 0
    for _ in range(400):
        passage = words(rng, rng.randint(50, 110))
        a = words(rng, 40) + passage + words(rng, 40)
        b = words(rng, 60) + edited(rng, passage, max(1, len(passage) // 50)) + words(rng, 30)
        ha, hb = (sub.shingle_hashes([w.encode() for w in t]) for t in (a, b))
        at = {s: i for i, s in enumerate(ha.tolist())}
        shifts = sorted({j - at[s] for j, s in enumerate(hb.tolist()) if s in at})
        if not sub._passages(ha, hb, shifts):
            continue
        n += 1
        made = []
        for h in (ha, hb):
            own = {}
            for fn in range(sub.FUNCTIONS):
                values = sub.hashed(h, fn)
                c, lo, hi = sub.compact_windows(values, sub.SPAN, sub.ARM)
                sketch = sub.sketches(h, c, (c - lo) * 64 + (hi - c))
                own |= {(fn, int(values[k])): s for k, s in zip(c, sketch)}
            made.append(own)
        hit += any(sub._agree(s, made[1][k][None])[0] for k, s in made[0].items() if k in made[1])
    assert n > 250 and hit >= 0.99 * n


def test_word_hashes_tell_words_apart_wherever_they_stand(monkeypatch):
    rng = random.Random(1)
    data = b"".join(rng.choice([b" ", b"\n\t", b"  "]) + bytes(rng.randrange(33, 256) for _ in range(rng.randint(0, 9))) for _ in range(3000))
    words = data.split()
    for stretch in (1 << 21, 64):
        monkeypatch.setattr(sub, "STRETCH", stretch)
        places, values = sub.word_hashes(data)
        assert [data[p : p + len(w)] for p, w in zip(places, words)] == words and len(places) == len(words)
        assert len(set(words)) == len(set(values.tolist())) == len(set(zip(words, values.tolist())))
    assert [len(x) for x in sub.word_hashes(b"")] == [0, 0] == [len(x) for x in sub.word_hashes(b" \n")]
    texts = [b"a b c d e f", b"", b"g h", b"i j k l m"]
    made = sub.Together(texts)
    assert made.inside.sum() == 3 and made.starts.tolist() == [0, 6, 6, 8]


def test_repeated_rows(spark):
    rng = random.Random(3)
    x, y, z = (" ".join(words(rng, 80)) for _ in range(3))
    out, _ = run(spark, [(1, x), (1, x), (2, y), (3, y), (3, y), (4, z), (5, None), (6, ""), (7, "short one"), (8, "short one")])
    assert sorted((r.doc_id, r.partner_id, r.n_words) for r in out) == [(1, 1, 80), (3, 2, 80)]
    assert len(sub.repeated_passages(spark.createDataFrame([(None, x), (9, x), (None, x)], SCHEMA)).collect()) == 1


def test_periodic_texts(spark):
    rng = random.Random(4)
    unit = words(rng, 3)
    rows = [(1, " ".join(unit * 60)), (2, " ".join(words(rng, 30) + unit * 40)), (3, " ".join(["same"] * 200)), (4, " ".join(["same"] * 90 + words(rng, 9)))]
    _, classes = run(spark, rows)
    assert sorted(map(sorted, classes.values())) == [[1, 2], [3, 4]]


def group_of(texts, anchor):
    """Sketches of one window of each text, at the shingle that begins with the word ``anchor``, as far as texts and ``ARM`` reach."""
    out = []
    for t in texts:
        h = sub.shingle_hashes([w.encode() for w in t])
        c = np.array([t.index(anchor)])
        out.append(sub.sketches(h, c, np.minimum(c, sub.ARM) * 64 + np.minimum(len(h) - 1 - c, sub.ARM))[0])
    return np.stack(out)


def compared(monkeypatch):
    made, counts = sub._agree, []
    monkeypatch.setattr(sub, "_agree", lambda mine, others: (counts.append(len(others)), made(mine, others))[1])
    return counts


def trees(n, links):
    root = list(range(n))
    for x, y in links:
        a, b = sub._root(root, x), sub._root(root, y)
        root[max(a, b)] = min(a, b)
    return [sub._root(root, x) for x in range(n)]


def test_a_frequent_line_in_unlike_texts_is_not_compared_pair_by_pair(monkeypatch):
    rng, n = random.Random(31), 1500
    line = words(rng, 20)
    texts = [words(rng, 40) + line + words(rng, 40) for _ in range(n)]
    for k in range(0, 60, 3):  # some go on alike behind a word more, or before one that is another
        texts[k + 1] = words(rng, 40) + line + words(rng, 1) + texts[k][60:]
        texts[k + 2] = texts[k][:35] + words(rng, 1) + texts[k][36:60] + words(rng, 40)
    sketch = group_of(texts, line[8])
    agree = {(a, b) for k in range(0, 60, 3) for a, b in itertools.combinations((k, k + 1, k + 2), 2) if sub._agree(sketch[a], sketch[b][None])[0]}
    counts = compared(monkeypatch)
    root = trees(n, sub.linked_windows(sketch, np.arange(n), np.full(n, -1)))
    assert len(agree) >= 20 and all(root[a] == root[b] for a, b in agree)
    assert sum(counts) < 40 * n  # all pairs are over 700 * n


@pytest.mark.parametrize("blocks", [1, 2])
def test_edited_copies_of_passages_end_in_the_trees_of_all_pairs(monkeypatch, blocks):
    """Two passages round a line, copies with edits and copies of those, some cut off, against all pairs of windows."""
    rng, n = random.Random(32), 400
    line = words(rng, 20)
    passages = [words(rng, 45) + line + words(rng, 45) for _ in range(2)]
    texts = []
    for d in range(n):
        source = texts[rng.randrange(d)] if d % 5 == 4 else passages[d % 2]
        copy = edited(rng, source, rng.randrange(6)) if d % 7 else words(rng, 45) + line + words(rng, 45)
        if line[8] not in copy:
            copy = list(source)
        at = copy.index(line[8])
        texts.append(copy[max(0, at - rng.randint(5, 60)) : at + rng.randint(10, 65)] + words(rng, 5))
    sketch, text = group_of(texts, line[8]), np.arange(n) % 390
    pairs = [(a, b) for a in range(n) for b in np.flatnonzero(sub._agree(sketch[a], sketch)).tolist() if text[a] != text[b]]
    monkeypatch.setattr(sub, "SMALL", 8)
    monkeypatch.setattr(sub, "FREQUENT", 16)
    monkeypatch.setattr(sub, "LEADERS", 8)
    own = np.arange(n) % blocks
    links = [(x, y) for x, y in sub.linked_windows(sketch, text, own) if blocks == 1 or own[x] != own[y]]
    for b in range(blocks) if blocks > 1 else ():
        mine = np.flatnonzero(own == b)
        links += [(mine[x], mine[y]) for x, y in sub.linked_windows(sketch[mine], text[mine])]
    assert all(text[x] != text[y] for x, y in links) and len(set(trees(n, pairs))) > 5
    assert trees(n, links) == trees(n, pairs)
