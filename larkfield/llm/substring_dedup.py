"""Near-duplicate passages across documents by compact windows over min-hashes of word shingles.

A text is a sequence of five-word shingles. For each hash function, the Cartesian tree over the hashed shingles yields
its compact windows (l, c, r): the shingle at c is the least in [l, r], so that all subsequences of [l, r] that hold c
share one min-hash. Only windows of ``LEAST`` words or more are made, about 2n/(t+1) a function. Windows with the same
function and shingle meet, aligned at the shared shingle, and are compared over the interval that both have: a stretch
of ``SPAN`` shingles or more that holds the anchor and agrees in 8 of 9 places links them (``linked_windows``; a word
more or less on one side is allowed for). The passages of linked texts are then verified word by word.

Links of a group of windows form trees, so that two texts with a common passage are always in one class. Windows of a
group of over ``SMALL`` are not compared pair by pair: those that agree place by place meet by hashes of the stretch, and
those that agree round an edit by what they share and a centre of the group has not, or by both being near a centre
(``_Group``; bytes of sketches that are alike by chance alone may stay apart). Windows whose surroundings agree further with
another window than with their partners in the tree are linked to that too, so that longer passages of some texts of a
class are not lost. ``passage_id`` names the class: the passages of a text that overlap are one, and classes are the
connected components of verified links. Equal texts are one class of texts and searched once.

Large groups: what is left of a group of over ``BLOCK`` windows, equal surroundings aside, is dealt by the eight shingles
before the anchor and by the eight behind it, one of which all windows that agree have in common, and groups that are still
larger are linked in pairs of blocks, so that no task holds a whole group and none is left out.

Defined results: null, empty and short texts (under 50 words) have no passages; passages repeated within one text are
not reported; every id of a text that other rows equal has a row over the whole text, once, however many rows it has
(the id that stands for the class only if it has two rows or more itself); null ids are carried; an empty table stays
empty; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkfield.llm.common import Stored, release, small_batches
from larkfield.llm.graph import components

SHINGLE, LEAST, SIMILARITY, FUNCTIONS, SLACK = 5, 50, 0.8, 4, 48
SPAN = LEAST - SHINGLE + 1
#: Shingles to each side of an anchor that travel with its window; more are never needed to tell a stretch of ``SPAN``.
ARM = SPAN - 1
#: A shingle that differs must be paid for by so many that agree: 0.8 of the union is 8 of 9 places.
PENALTY = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = [np.uint64(xxhash.xxh64_intdigest(b"window", i)) for i in range(FUNCTIONS + 1)]
#: Places round the anchor that must agree one by one before edits are allowed for. One edit leaves a passage two parts, and
#: the anchors of four functions all lie in one of fewer places with a chance of 0.02 at most.
ROUND = 17
#: Distances from the anchor of the shingles that deal out a large group. Windows that ``_agree`` have ``ROUND`` places in a row
#: that hold the anchor, so eight before it or eight behind it, whatever is edited elsewhere.
SIDES = (tuple(range(-(ROUND // 2), 0)), tuple(range(1, ROUND // 2 + 1)))
#: Windows that are compared in one task.
BLOCK = 32_768
#: Texts that are verified in one task against the text that leads them.
TEXTS = 512
#: At most so many rows of a few numbers are broadcast, counted before; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = np.array([xxhash.xxh64_intdigest(b"byte", i) for i in range(256)], dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that are hashed at once; a longer text goes in stretches that end behind a word.
STRETCH = 1 << 21
_POWERS, _INVERSE = (
    np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(STRETCH, x, dtype=np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))
)


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def words_of(text: str | None) -> list[bytes]:
    return _bytes_of(text).split()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The byte at which each word begins, and a 64-bit hash of the word: a polynomial over its bytes, mixed."""
    found, at = [], 0
    while at < len(data) or not found:
        end = min(len(data), at + STRETCH)
        if end < len(data):
            behind = np.flatnonzero(_SPACE[np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)])
            end = at + int(behind[-1]) + 1 if len(behind) else end
        b = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        gap = np.concatenate([[True], _SPACE[b], [True]])
        first, last = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[b] * _POWERS[: len(b)], dtype=np.uint64)])
        value = (sums[last] - sums[first]) * _INVERSE[first] ^ (last - first).astype(np.uint64) * _MULTIPLIER
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        found.append((first + at, value))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))


def _shingled(values: np.ndarray) -> np.ndarray:
    n = len(values) - SHINGLE + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    if n > 0:
        for i in range(SHINGLE):
            out = (out ^ values[i : i + n]) * _MULTIPLIER
            out ^= out >> np.uint64(31)
    return out


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the shingles, from hashes of the words."""
    return _shingled(word_hashes(b" ".join(words))[1])


class Together:
    """The shingles of several texts in one array; ``inside`` is false for shingles that begin in one and end in another."""

    def __init__(self, texts: list[bytes]):
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        places, values = word_hashes(b"\n".join(texts))
        sizes = np.diff(np.searchsorted(places, begin)) if len(texts) else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        self.shingles = _shingled(values)
        n = len(self.shingles)
        self.text = np.repeat(np.arange(len(texts)), sizes)[:n]
        self.inside = np.arange(n) + SHINGLE <= ends[self.text]


def _portions(rows: Iterator[tuple], size: int = 600_000) -> Iterator[list[tuple]]:
    """Rows (key, bytes, ...) in lists of about so many bytes; a longer text is a list of its own."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def hashed(shingles: np.ndarray, fn: int) -> np.ndarray:
    out = (shingles ^ _SEEDS[fn]) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(30)
    return out * np.uint64(0x94D049BB133111EB)


def _sliding(values: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` (minimum or maximum) over each run of ``width`` values, by running results from both ends of blocks."""
    runs = len(values) - width + 1
    blocks = np.concatenate([values, np.full(-len(values) % width, fill, dtype=values.dtype)]).reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:runs], ahead[width - 1 : width - 1 + runs])


def compact_windows(values: np.ndarray, span: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r), bounds included, of all compact windows of ``span`` values or more, cut ``reach`` from the anchor c.

    An anchor is the least of some run of ``span`` values, and its window ends before the nearest smaller value on either
    side; ties of a least value share a window.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(values) < span:
        return none, none, none
    edge = np.zeros(span - 1, dtype=values.dtype)
    least = _sliding(values, span, np.minimum, np.iinfo(values.dtype).max)
    c = np.flatnonzero(values == _sliding(np.concatenate([edge, least, edge]), span, np.maximum, 0))
    beyond = np.zeros(reach + 1, dtype=values.dtype)
    padded = np.concatenate([beyond, values, beyond])
    left, right = np.zeros(len(c), dtype=np.int64), np.zeros(len(c), dtype=np.int64)
    for k in range(0, len(c), 8_192):
        at = c[k : k + 8_192]
        near = padded[at[:, None] + np.arange(1, 2 * reach + 2)]
        smaller = near < values[at][:, None]
        left[k : k + 8_192] = np.where(smaller[:, :reach].any(1), smaller[:, reach - 1 :: -1].argmax(1), reach)
        right[k : k + 8_192] = np.where(smaller[:, reach + 1 :].any(1), smaller[:, reach + 1 :].argmax(1), reach)
    return c, np.maximum(c - left, 0), np.minimum(c + right, len(values) - 1)


def _thinned(c: np.ndarray, h: np.ndarray, made: Together) -> np.ndarray:
    """Which windows to keep: of anchors that repeat within ``SPAN`` in like surroundings (periodic text), the ends."""
    text = made.text[c]
    keep = np.ones(len(c), dtype=bool)
    order = np.lexsort((c, h, text))
    twin = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    if not twin.any():
        return keep
    again = np.zeros(len(c), dtype=bool)
    again[order[1:][twin]] = again[order[:-1][twin]] = True
    some = np.flatnonzero(again)
    at, last = c[some], len(made.shingles) - 1
    near = []
    for d in (-16, -8, 8, 16):
        place = np.clip(at + d, 0, last)
        near.append(np.where((made.text[place] == made.text[at]) & (place == at + d), made.shingles[place], np.uint64(0)))
    order = np.lexsort((at, *near, h[some], made.text[at]))
    same = np.diff(at[order]) < SPAN
    for x in (h[some], made.text[at], *near):
        same &= x[order][1:] == x[order][:-1]
    inner = np.zeros(len(some), dtype=bool)
    inner[1:-1] = same[1:] & same[:-1]
    keep[some[order[inner]]] = False
    return keep


WINDOW_SCHEMA = "h long, text_key long, c int, arms int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each text: key of function and shingle, anchor, and how far it reaches to both sides (``ARM`` at most)."""
    for batch in batches:
        for part in _portions((key, _bytes_of(text)) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            made = Together([data for _, data in part])
            keys = np.array([key for key, _ in part], dtype=np.int64)
            for fn in range(FUNCTIONS):
                # What lies between texts is smaller than all shingles, so that no window reaches over it.
                values = np.where(made.inside, np.maximum(hashed(made.shingles, fn), np.uint64(1)), np.uint64(0))
                c, lo, hi = compact_windows(values, SPAN, ARM)
                real = made.inside[c]
                c, lo, hi = c[real], lo[real], hi[real]
                # The function is mixed into the key, so that equal shingles of two functions do not meet.
                h = (values[c] ^ _SEEDS[fn]).view(np.int64)
                arms = (c - lo) * 64 + (hi - c)
                kept = _thinned(c, h, made)
                c, h, arms = c[kept], h[kept], arms[kept]
                text = made.text[c]
                columns = [h, keys[text], (c - made.starts[text]).astype(np.int32), arms.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "text_key", "c", "arms"])


def sketches(shingles: np.ndarray, c: np.ndarray, arms: np.ndarray) -> np.ndarray:
    """8 bits of each shingle within ``ARM`` of the anchors; 0 beyond the window."""
    local = np.maximum(hashed(shingles, FUNCTIONS) >> np.uint64(56), np.uint64(1)).astype(np.uint8)
    edge = np.zeros(ARM, dtype=np.uint8)
    padded = np.concatenate([edge, local, edge])
    offsets = np.arange(-ARM, ARM + 1)
    out = padded[c[:, None] + ARM + offsets]
    out[(offsets < -(arms // 64)[:, None]) | (offsets > (arms % 64)[:, None])] = 0
    return out


SKETCH_SCHEMA = "h long, text_key long, c int, sketch binary"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = 2 * ARM + 1
    for batch in batches:
        found = batch.column(2)
        offsets = found.offsets.to_numpy()
        h, c, arms = (x.to_numpy(zero_copy_only=False) for x in found.values.flatten())
        rows = zip(batch.column(0).to_pylist(), map(_bytes_of, batch.column(1).to_pylist()), offsets[:-1].tolist(), offsets[1:].tolist())
        for part in _portions(rows):
            made = Together([r[1] for r in part])
            at = np.concatenate([np.arange(r[2], r[3]) for r in part])
            n = np.array([r[3] - r[2] for r in part])
            sketch = sketches(made.shingles, c[at].astype(np.int64) + np.repeat(made.starts, n), arms[at].astype(np.int64))
            places = pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * width)
            columns = [pa.array(h[at]), pa.array(np.repeat(np.array([r[0] for r in part], dtype=np.int64), n)), pa.array(c[at])]
            packed = pa.Array.from_buffers(pa.binary(), len(at), [None, places, pa.py_buffer(np.ascontiguousarray(sketch))])
            yield pa.RecordBatch.from_arrays([*columns, packed], names=["h", "text_key", "c", "sketch"])


def _agree(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which sketches have a stretch of ``SPAN`` places or more with ``mine`` (one sketch, or one for each of them) that
    holds the anchor, 8 of 9 alike."""
    out = np.zeros(len(others), dtype=bool)
    same = (others == mine) & (others != 0)
    tried = np.flatnonzero(np.count_nonzero(same, axis=1) >= ROUND)
    if len(tried):
        same, others = same[tried], others[tried]
        mine = mine[tried] if mine.ndim == 2 else mine
        start, end = ARM - same[:, ARM - 1 :: -1].argmin(1), ARM + 1 + same[:, ARM + 1 :].argmin(1)
        start[same[:, :ARM].all(1)], end[same[:, ARM + 1 :].all(1)] = 0, 2 * ARM + 1
        exact = end - start >= SPAN  # most that agree do so place by place
        out[tried[exact]] = True
        rest = np.flatnonzero(~exact & (end - start >= ROUND))
        if len(rest):
            mine = mine[rest] if mine.ndim == 2 else mine
            kept = np.flatnonzero(np.count_nonzero((others[rest] != 0) & (mine != 0), axis=1) >= SPAN)  # both reach over a stretch
            if len(kept):
                rest = rest[kept]
                out[tried[rest]] = _agree_edited(mine[kept] if mine.ndim == 2 else mine, others[rest], same[rest])
    return out


def _agree_edited(mine: np.ndarray, others: np.ndarray, same: np.ndarray) -> np.ndarray:
    near, inside = same.copy(), mine != 0
    for d in (1, 2):  # behind a word more or less, shingles agree one place further
        near[:, d:] |= (others[:, :-d] == mine[..., d:]) & inside[..., d:]
        near[:, :-d] |= (others[:, d:] == mine[..., :-d]) & inside[..., :-d]
    gain = np.where(near, np.int16(1), np.int16(-PENALTY))
    zero = np.zeros((len(others), 1), dtype=np.int16)
    right = np.concatenate([zero, np.cumsum(gain[:, ARM + 1 :], axis=1, dtype=np.int16)], axis=1)
    left = np.concatenate([zero, np.cumsum(gain[:, ARM - 1 :: -1], axis=1, dtype=np.int16)], axis=1)
    right = np.maximum.accumulate(right[:, ::-1], axis=1)  # at i: the best of ARM - i places or more
    return (left + right).max(1) >= -1


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far sketches agree to the left and to the right of the anchor, row by row."""
    differ = np.pad((a != b) | (a == 0), ((0, 0), (1, 1)), constant_values=True)
    return differ[:, ARM::-1].argmax(1), differ[:, ARM + 2 :].argmax(1)


class _Forest:
    """Trees over windows; ``made`` has the pairs that joined two of them."""

    def __init__(self, n: int):
        self.root, self.made = np.arange(n), []

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.root[x], self.root[y]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            below, at = np.unique(np.maximum(a, b), return_index=True)
            self.root[below] = np.minimum(a, b)[at]
            self.made.append((x[at], y[at]))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip((none, none), *self.made))


class _Group:
    """Windows of one anchor, to be linked: a pair that agrees and is of different texts ends in one tree.

    Pairs that agree place by place share a stretch of ``SPAN`` places at one of ``SPAN`` distances, and meet by its hash.
    What then still lies in different trees can only agree round an edit. Such pairs are found by centres, sketches made of the most
    frequent byte at each place: where a pair has three places in a row alike of which one is not the centre's, it meets by these;
    a pair that has none agrees only where both agree with the centre, so that both must come near enough to it.
    """

    def __init__(self, sketch: np.ndarray, text: np.ndarray):
        self.sketch, self.text, self.forest = sketch, text, _Forest(len(text))
        inside = sketch != 0
        self.low, self.high = inside.argmax(1), 2 * ARM + 1 - inside[:, ::-1].argmax(1)
        near = ROUND // 2
        self.sides = [np.ascontiguousarray(sketch[:, x : x + near]).view(np.uint64).ravel() for x in (ARM - near, ARM + 1)]

    def neighbours(self, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, length) of windows of one ``tree`` that follow each other in the order of what lies on either side, and agree place by place."""
        found = []
        for part in (self.sketch[:, ARM:], self.sketch[:, ARM::-1]):
            order = np.lexsort((np.argsort(np.argsort(np.ascontiguousarray(part).view(f"V{ARM + 1}").ravel(), kind="stable")), tree))
            x, y = order[:-1], order[1:]
            fit = (self.text[x] != self.text[y]) & (tree[x] == tree[y])
            x, y = x[fit], y[fit]
            length = np.add(*_common(self.sketch[x], self.sketch[y])) if len(x) else x
            fit = length >= SPAN - 1
            found.append((x[fit], y[fit], length[fit]))
        return tuple(np.concatenate(z) for z in zip(*found))

    def join_alike(self, part: np.ndarray) -> None:
        """Joins the windows of equal numbers ``part`` that agree place by place; the longest agreements of neighbours come first."""
        x, y, length = self.neighbours(part)
        order = np.argsort(-length, kind="stable")
        self.forest.join(x[order], y[order])
        column = np.ascontiguousarray(self.sketch.T)
        value = [_BYTES[column[p]] * _POWERS[p] for p in range(2 * ARM + 1)]
        total = hashed(part.astype(np.uint64), 0) + np.sum(value[:SPAN], axis=0, dtype=np.uint64)
        for p in range(SPAN):
            if p:
                total += value[p + SPAN - 1] - value[p - 1]
            fit = np.flatnonzero((self.low <= p) & (self.high >= p + SPAN))
            order = np.argsort(total[fit], kind="stable")
            key, at = total[fit][order], fit[order]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            if fresh.all():
                continue
            begin, place = np.flatnonzero(fresh), np.arange(len(at))
            group = np.cumsum(fresh) - 1
            first = at[begin][group]
            other = self.text[at] != self.text[first]
            second = np.minimum.reduceat(np.where(other, place, len(at)), begin)[group]  # the first one of another text
            fit = other | ((second < len(at)) & ~fresh)
            self.forest.join(np.where(other, first, at[np.minimum(second, len(at) - 1)])[fit], at[fit])

    def join_edited(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins those of the pairs that agree, whichever of both is edited."""
        root = self.forest.root
        fit = (root[x] != root[y]) & (self.text[x] != self.text[y])
        fit &= np.minimum(self.high[x], self.high[y]) - np.maximum(self.low[x], self.low[y]) >= SPAN
        x, y = x[fit], y[fit]
        fit = (self.sides[0][x] == self.sides[0][y]) | (self.sides[1][x] == self.sides[1][y])
        x, y = x[fit], y[fit]
        for k in range(0, len(x), AT_ONCE):
            a, b = x[k : k + AT_ONCE], y[k : k + AT_ONCE]
            hit = _agree(self.sketch[a], self.sketch[b])
            rest = np.flatnonzero(~hit)
            hit[rest] = _agree(self.sketch[b[rest]], self.sketch[a[rest]])
            self.forest.join(a[hit], b[hit])

    def centres(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Centres, and the number of the centre that each window has most places of. They bear on the time only, not on the result."""
        chosen, home, most = np.arange(len(self.text)), np.zeros(len(self.text), dtype=np.int64), np.full(len(self.text), -1)
        out: list[np.ndarray] = []
        while len(out) < CENTRES:
            counts = np.stack([np.bincount(self.sketch[chosen, p], minlength=256) for p in range(2 * ARM + 1)])
            counts[:, 0] = 0
            out.append(np.where(counts.max(1) >= min(FREQUENT, len(chosen)), counts.argmax(1), 0).astype(np.uint8))
            near = _near(self.sketch, out[-1], 2).sum(1)
            home[near > most] = len(out) - 1
            most = np.maximum(most, near)
            step = -(-len(self.text) // (4 * PORTION))
            gram, row, place = self.strange(np.arange(0, len(self.text), step), out, home)
            values, n = np.unique(gram[::7] * 128 + place[::7], return_counts=True)
            if not len(n) or n.max() * 7 * step < FREQUENT:
                break
            frequent = gram * 128 + place == values[n.argmax()]
            chosen = row[frequent]
        return out, home

    def strange(self, rows: np.ndarray, centres: list[np.ndarray], home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(three bytes, window, place) wherever one of three places in a row is not that of the window's centre, or of one nearby."""
        found = []
        for k, centre in enumerate(centres):
            own = rows[home[rows] == k]
            found += [self.grams(x, ~_near(self.sketch[x], centre, 2)) for x in np.split(own, range(PORTION, len(own), PORTION))]
        return tuple(np.concatenate(x) for x in zip(*found))

    def grams(self, rows: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(three bytes, window, place) of three places in a row that have a marked one."""
        own = self.sketch[rows]
        whole = own != 0
        fit = whole[:, :-2] & whole[:, 1:-1] & whole[:, 2:] & (marked[:, :-2] | marked[:, 1:-1] | marked[:, 2:])
        at, place = np.nonzero(fit)
        gram = own[at, place].astype(np.int32) << 16 | own[at, place + 1].astype(np.int32) << 8 | own[at, place + 2]
        return gram, rows[at].astype(np.int32), place.astype(np.int16)

    def join_near_centres(self, centres: list[np.ndarray], home: np.ndarray) -> None:
        """Joins what agrees wherever it agrees with the centres of both. One of two has its places within two of a centre's, the other within four."""
        rows = np.arange(len(home))
        near = np.stack([_near(self.sketch, centre, 2) for centre in centres])
        tight = np.stack([_stretches(x, 2) for x in near])
        loose = np.stack([_stretches(_near(self.sketch, centre, 4), 4) for centre in centres])
        near, own_tight, own_loose = near[home, rows], tight[home, rows], loose[home, rows]
        some = np.flatnonzero(own_tight | own_loose)
        some = some[np.argsort(-near[some].sum(1), kind="stable")]
        some = some[self.foremost(np.where(near[some], self.sketch[some], np.uint8(0)), some)]
        values, n = np.unique(self.forest.root[some], return_counts=True)
        for y in some[self.forest.root[some] != values[n.argmax()]].tolist() if len(some) else []:
            x = some[self.forest.root[some] != self.forest.root[y]]
            x = x[((tight[home[y], x] & own_loose[y]) | (loose[home[y], x] & own_tight[y])) != 0]
            x = x[((own_tight[x] & loose[home[x], y]) | (own_loose[x] & tight[home[x], y])) != 0]
            n = 64
            while len(x):
                self.join_edited(x[:n], np.full(len(x[:n]), y))
                x, n = x[n:], n * 8
                x = x[self.forest.root[x] != self.forest.root[y]]

    def foremost(self, held: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which windows to compare: not those of which two others of the tree, of two texts, have all that is ``held``."""
        out = np.ones(len(rows), dtype=bool)
        order = np.argsort(self.forest.root[rows], kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(self.forest.root[rows][order])) + 1):
            tried = 0
            first = np.full(len(own), -1)  # a window that has all that these have
            while tried < len(own) > LEADERS:
                lead = own[0]
                text = self.text[rows[lead]]
                less = ((held[own] == held[lead]) | (held[own] == 0)).all(1)
                less[0] = False
                again = less & (first >= 0)
                again[again] = self.text[rows[first[again]]] != text
                out[own[again]] = False
                first[less & (first < 0)] = lead
                own, first, tried = own[~again][1:], first[~again][1:], tried + 1
                if tried >= LEADERS:
                    break
        return out

    def join_strange(self, centres: list[np.ndarray], home: np.ndarray) -> None:
        """Joins what shares three places in a row that the centre of one of both has not."""
        rows = np.arange(len(self.text))
        values, n = np.unique(self.forest.root, return_counts=True)
        large = self.forest.root == values[n.argmax()]
        for k, centre in enumerate(centres):
            gram, row, place = self.strange(rows[home == k], centres, home)
            key = gram * np.int32(128) + place
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            apart = ~large[row]
            for portion, own, keys, partner in (
                (x, own, *met) for own, met in ((~large, (key, row)), (large, (key[apart], row[apart]))) for x in np.split(rows, range(PORTION, len(rows), PORTION))
            ):
                portion = portion[own[portion]]
                asked, asking, at = self.grams(portion, self.sketch[portion] != centre)
                asked = asked * np.int32(128) + at
                mine = np.argsort(asked, kind="stable")
                begin, end = np.searchsorted(keys, asked[mine] - 2), np.searchsorted(keys, asked[mine] + 2, "right")
                alone = (end - begin == 1) & (partner[np.minimum(begin, len(partner) - 1)] == asking[mine]) if len(partner) else end == begin
                mine, begin, end = (x[(end > begin) & ~alone] for x in (mine, begin, end))
                by_row = np.argsort(asking[mine], kind="stable")
                y, begin, size = asking[mine][by_row], begin[by_row], (end - begin)[by_row]
                ends = np.cumsum(size)
                cut = 0
                while cut < len(y):
                    upto = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + EXPANDED, "right")))
                    n = size[cut:upto]
                    a = np.repeat(y[cut:upto], n).astype(np.int64)
                    b = partner[np.repeat(begin[cut:upto] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    differ = self.forest.root[a] != self.forest.root[b]
                    pairs = np.unique(a[differ] * len(rows) + b[differ])
                    self.join_edited(pairs // len(rows), pairs % len(rows))
                    cut = upto

    def link(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that make up the trees. Those of one number of ``part`` are linked elsewhere too."""
        if (part != part[0]).any():
            self.join_alike(part)
        self.join_alike(np.zeros(len(part), dtype=np.int64))
        if len(part) <= SMALL:
            x, y = np.triu_indices(len(part), 1)
            self.join_edited(x, y)
        elif (self.forest.root != self.forest.root[0]).any():
            centres, home = self.centres()
            self.join_near_centres(centres, home)
            self.join_strange(centres, home)
        x, y = self.forest.pairs()
        # Longer agreements of neighbours in a tree.
        best = np.zeros(len(part), dtype=np.int64)
        if len(x):
            length = np.add(*_common(self.sketch[x], self.sketch[y]))
            np.maximum.at(best, x, length)
            np.maximum.at(best, y, length)
        a, b, length = self.neighbours(self.forest.root)
        more = (length > best[a] + SHINGLE) | (length > best[b] + SHINGLE)
        return np.concatenate([x, a[more]]), np.concatenate([y, b[more]])


def _near(sketch: np.ndarray, centre: np.ndarray, reach: int) -> np.ndarray:
    """Which places of sketches have a byte that the centre has there, or, two in a row, up to ``reach`` places before or behind."""
    held = np.pad(centre, reach)
    out = sketch == centre
    for d in range(2 * reach + 1):
        if d != reach:
            same = sketch == held[d : d + 2 * ARM + 1]
            two = same[:, 1:] & same[:, :-1]
            out[:, 1:] |= two
            out[:, :-1] |= two
    return out & (sketch != 0)


def _stretches(near: np.ndarray, forgiven: int) -> np.ndarray:
    """For each row a bit for the places before the anchor from which a stretch may begin that agrees with a centre. Ends may move
    by two places, as two windows and the centre are laid on each other with shifts, and some places that differ are forgiven."""
    gain = np.where(near, np.int16(1), np.int16(-PENALTY))
    zero = np.zeros((len(near), 1), dtype=np.int16)
    right = np.concatenate([zero, np.cumsum(gain[:, ARM + 1 :], axis=1, dtype=np.int16)], axis=1)
    left = np.concatenate([zero, np.cumsum(gain[:, ARM - 1 :: -1], axis=1, dtype=np.int16)], axis=1)
    right = np.maximum.accumulate(right[:, ::-1], axis=1)[:, np.minimum(np.arange(ARM + 1) + 2, ARM)]
    can = left + right >= -1 - forgiven * (PENALTY + 1)
    bits = (can * (np.uint64(1) << np.arange(8, ARM + 9, dtype=np.uint64))).sum(1, dtype=np.uint64)
    return bits | bits << np.uint64(1) | bits << np.uint64(2) | bits >> np.uint64(1) | bits >> np.uint64(2)


def linked_windows(sketch: np.ndarray, text: np.ndarray, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of windows of different texts that agree: trees over all that do, and longer agreements of neighbours.

    Of several ``part``, those within one may be missing, as long as they are in a tree of that part alone.
    """
    if len(text) < 2:
        return []
    x, y = _Group(sketch, text).link(np.zeros(len(text), dtype=np.int64) if part is None else part)
    return list(zip(x.tolist(), y.tolist()))


EDGE_SCHEMA = "a long, b long, a_c int, b_c int, left int, right int"


def _edge_batch(keys: np.ndarray, places: np.ndarray, sketch: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(edges, dtype=np.int64).reshape(-1, 2)
    swap = keys[at[:, 0]] > keys[at[:, 1]]
    a, b = np.where(swap, at[:, 1], at[:, 0]), np.where(swap, at[:, 0], at[:, 1])
    both = (sketch[a] != 0) & (sketch[b] != 0)
    columns = [keys[a], keys[b], places[a], places[b], both[:, :ARM].sum(1), both[:, ARM + 1 :].sum(1)]
    types = [np.int64, np.int64, np.int32, np.int32, np.int32, np.int32]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(t, copy=False)) for x, t in zip(columns, types)], names=[f.split()[0] for f in EDGE_SCHEMA.split(", ")])


#: Windows of a group that are compared pair by pair, and pairs that are compared at once.
SMALL, AT_ONCE = 256, 16_384
#: Larger groups: pairs and windows that are worked off at once, centres at most, how many windows are worth one, and leaders of a tree.
EXPANDED, PORTION, CENTRES, FREQUENT, LEADERS = 400_000, 8_192, 8, 64, 128


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, i, j, own, text_key, c, sketch) sorted by task, i, j, text: one block, or two that are held in turn."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        numbers = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)], axis=1)
        held.append((numbers, np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint8).reshape(len(numbers), 2 * ARM + 1)))
        rows += len(numbers)
        if rows >= AT_ONCE:
            numbers, sketch = (np.concatenate(x) for x in zip(*held))
            last = len(numbers) - 1
            while last > 0 and (numbers[last - 1, :3] == numbers[-1, :3]).all():
                last -= 1
            yield from _link_groups(numbers[:last], sketch[:last])  # the last group may go on in the next batch
            held = [(numbers[last:], sketch[last:])]
            rows = len(numbers) - last if len(numbers) - last < AT_ONCE // 2 else 0
    if held:
        yield from _link_groups(*(np.concatenate(x) for x in zip(*held)))


def _link_groups(numbers: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(numbers):
        return
    own, keys, places = numbers[:, 3], numbers[:, 4], numbers[:, 5]
    begin = np.flatnonzero(np.concatenate([[True], (numbers[1:, :3] != numbers[:-1, :3]).any(1)]))
    size = np.diff(np.append(begin, len(numbers)))
    group = np.repeat(np.arange(len(begin)), size)
    cross = numbers[begin, 1] != numbers[begin, 2]
    edges: list[tuple[int, int]] = []
    for g in np.flatnonzero(cross).tolist():
        mine = slice(begin[g], begin[g] + size[g])
        edges += [(x + begin[g], y + begin[g]) for x, y in _across(sketch[mine], keys[mine], own[mine])]
    # Equal sketches of a group: the first stands for the others.
    mixed = (sketch.astype(np.uint64) * _WEIGHTS).sum(1)
    order = np.lexsort((np.arange(len(mixed)), mixed, group))
    order = order[~cross[group[order]]]
    if len(order):
        fresh = np.concatenate([[True], (mixed[order][1:] != mixed[order][:-1]) | (group[order][1:] != group[order][:-1])])
        stand = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        star = keys[stand] != keys[order]
        edges += list(zip(stand[star].tolist(), order[star].tolist()))
        reps = np.sort(order[fresh])
        first = np.flatnonzero(np.concatenate([[True], group[reps][1:] != group[reps][:-1]]))
        count = np.diff(np.append(first, len(reps)))
        for n in np.unique(count).tolist():
            at = first[count == n]
            if n > SMALL:
                for k in at.tolist():
                    mine = reps[k : k + n]
                    edges += [(int(mine[x]), int(mine[y])) for x, y in linked_windows(sketch[mine], keys[mine])]
            elif n > 1:
                edges += _small_groups(sketch, keys, reps[at[:, None] + np.arange(n)])
    if edges:
        yield _edge_batch(keys, places, sketch, edges)


_WEIGHTS = np.array([xxhash.xxh64_intdigest(b"sketch", i) | 1 for i in range(2 * ARM + 1)], dtype=np.uint64)


def _small_groups(sketch: np.ndarray, keys: np.ndarray, members: np.ndarray) -> list[tuple[int, int]]:
    """Links of groups of equally many windows, a row each: of those that agree, trees of the longest agreements."""
    n = members.shape[1]
    x, y = np.triu_indices(n, 1)
    a, b = members[:, x].ravel(), members[:, y].ravel()
    owner = np.repeat(np.arange(len(members)), len(x))
    differ = keys[a] != keys[b]
    a, b, owner = a[differ], b[differ], owner[differ]
    hit = np.concatenate([_agree(sketch[a[k : k + AT_ONCE]], sketch[b[k : k + AT_ONCE]]) for k in range(0, len(a), AT_ONCE)]) if len(a) else np.zeros(0, dtype=bool)
    a, b, owner = a[hit], b[hit], owner[hit]
    if n == 2 or not len(a):
        return list(zip(a.tolist(), b.tolist()))
    left, right = _common(sketch[a], sketch[b])
    order = np.lexsort((b, a, -(left + right), owner))
    out, root = [], {}
    for p, q in zip(a[order].tolist(), b[order].tolist()):
        r, t = p, q
        while (up := root.get(r, r)) != r:
            r = up
        while (up := root.get(t, t)) != t:
            t = up
        if r != t:
            root[max(r, t)] = min(r, t)
            out.append((p, q))
    return out


def _across(sketch: np.ndarray, keys: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """Links between two blocks. What a block links within itself comes from its own task."""
    return [(x, y) for x, y in linked_windows(sketch, keys, own) if own[x] != own[y]]


def _root(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows with the blocks (i, j) that they meet in: groups of over ``BLOCK`` rows, which only dealt ones can have, have several."""
    if key == "h":
        rows = rows.withColumn("k", F.lit(1))
    else:
        size = rows.groupBy(key).count().where("count > 1")
        rows = rows.join(_sized(Stored(size.select(key, F.ceil(F.col("count") / BLOCK).cast("int").alias("k"))).df), key)
    own = F.pmod(F.xxhash64("text_key", "c"), F.col("k")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return dealt.select(
        F.col(key).alias("task"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "text_key", "c", "sketch",
    )


def _dealt_by(places: tuple[tuple[int, ...], ...]) -> Column:
    """Keys of the shingles at some places of a sketch, where all lie inside it."""
    made = []
    for at in places:
        parts = [F.substring("sketch", ARM + x + 1, 1) for x in at]
        beyond = F.array_contains(F.array(*[F.hex(x) for x in parts]), "00")
        made.append(F.when(~beyond, F.xxhash64("h", F.lit(at[0]), *parts)))
    return F.explode(F.array_compact(F.array(*made)))


def window_links(texts: DataFrame) -> DataFrame:
    """(a, b, a_c, b_c, left, right): linked texts (a < b), their anchors and the common interval beside these."""
    # One shuffle brings together the windows of a key; those of one text alone go no further, and none are stored before.
    key = W.partitionBy("h")
    met = texts.mapInArrow(_windows, WINDOW_SCHEMA).select("*", F.min("text_key").over(key).alias("t0"), F.max("text_key").over(key).alias("t1"), F.count("*").over(key).alias("n"))
    shared = Stored(met.where("t0 != t1").select("h", "text_key", "c", "arms", "n"))
    release(texts.sparkSession)
    large = Stored(shared.df.where(F.col("n") > BLOCK).select("h").distinct()).df
    n_large = large.count()
    cold = shared.df.join(_sized(large), "h", "left_anti") if n_large else shared.df
    tasks = _tasks(_blocks(_with_sketches(cold, texts), "h"))
    links = Stored(tasks.mapInArrow(_link, EDGE_SCHEMA))
    out, temporary = links.df, [shared]
    if n_large:
        release(texts.sparkSession)
        found = Stored(_with_sketches(shared.df.join(_sized(large), "h", "left_semi"), texts).withColumn("sig", F.xxhash64("sketch")))
        # Equal surroundings: one window stands for all, and the others are linked to it.
        first = Stored(found.df.groupBy("h", "sig").agg(F.min(F.struct("text_key", "c")).alias("first")).select("h", "sig", F.col("first.text_key").alias("a"), F.col("first.c").alias("a_c")))
        equal = found.df.join(_sized(first.df), ["h", "sig"])
        stands = (F.col("text_key") == F.col("a")) & (F.col("c") == F.col("a_c"))
        alone = equal.where(stands)
        dealt = _tasks(_blocks(alone.select(_dealt_by(SIDES).alias("key"), "text_key", "c", "sketch"), "key"))
        arm = F.lit(ARM)
        stars = equal.where("a < text_key").select("a", F.col("text_key").alias("b"), "a_c", F.col("c").alias("b_c"), arm.alias("left"), arm.alias("right"))
        out = Stored(out.unionByName(dealt.mapInArrow(_link, EDGE_SCHEMA)).unionByName(stars)).df
        temporary += [links, found, first]
    for t in temporary:
        t.drop()
    release(texts.sparkSession)
    return out


def _with_sketches(windows: DataFrame, texts: DataFrame) -> DataFrame:
    by_text = windows.groupBy("text_key").agg(F.collect_list(F.struct("h", "c", "arms")).alias("found"))
    return texts.join(by_text, "text_key").select("text_key", "text", "found").mapInArrow(_sketched, SKETCH_SCHEMA)


def _tasks(rows: DataFrame) -> DataFrame:
    return rows.repartition("task", "i", "j").sortWithinPartitions("task", "i", "j", "text_key", "c")


def longest_stretch(same: np.ndarray, penalty: int) -> tuple[int, int]:
    """The longest [i, j) in which agreements pay for disagreements at ``penalty`` each."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -penalty))])
    best = (0, 0)
    lowest = np.minimum.accumulate(sums)  # falls from left to right: the first place at or below a sum is sought
    starts = np.searchsorted(-lowest, -sums, side="left")
    lengths = np.arange(len(sums)) - starts
    j = int(lengths.argmax())
    if lengths[j] > 0:
        best = (int(starts[j]), j)
    return best


def passages(a: list[bytes], b: list[bytes], shifts: list[int]) -> list[tuple[int, int, int, int, float]]:
    """(a_start, a_end, b_start, b_end, similarity) of near-duplicate passages, all that each cluster of shifts has."""
    return _passages(shingle_hashes(a), shingle_hashes(b), shifts)


def _passages(ha: np.ndarray, hb: np.ndarray, shifts: list[int]) -> list[tuple[int, int, int, int, float]]:
    least = int(2 * SPAN * SIMILARITY / (1 + SIMILARITY))  # places of shared shingles in passages of the least length
    if len(ha) < SPAN or len(hb) < SPAN or np.isin(ha, hb).sum() < least:
        return []
    sa, sb = ha.tolist(), hb.tolist()
    places: dict[int, list[int]] = {}
    for j, s in enumerate(sb):
        places.setdefault(s, []).append(j)
    clusters: list[int] = []
    for shift in sorted(shifts):
        if not clusters or shift > clusters[-1] + SLACK:
            clusters.append(shift)
    out = []
    for shift in clusters:
        partner = np.full(len(sa), -1)
        for i, s in enumerate(sa):
            near = places.get(s)
            if near:
                # Positions rise, so the closest to the expected place is a neighbour of the insertion point.
                want = i + shift
                j = near[0]
                if len(near) > 1:
                    k = bisect_left(near, want)
                    j = near[-1] if k == len(near) else near[k]
                    j = near[k - 1] if k and want - near[k - 1] <= abs(j - want) else j
                if abs(j - want) <= 2 * SLACK:
                    partner[i] = j
        same = partner >= 0
        todo = [(0, len(sa))]
        while todo:
            begin, end = todo.pop()
            if np.count_nonzero(same[begin:end]) < least:
                continue
            for penalty in (8, 16, len(sa) + 1):
                i, j = (begin + x for x in longest_stretch(same[begin:end], penalty))
                while i < j and not same[i]:
                    i += 1
                while i < j and not same[j - 1]:
                    j -= 1
                hit = partner[i:j][same[i:j]]
                lo, hi = int(hit.min()), int(hit.max()) + 1
                left, right = set(sa[i:j]), set(sb[lo:hi])
                similarity = len(left & right) / len(left | right)
                if similarity >= SIMILARITY and j - i >= SPAN and hi - lo >= SPAN:
                    out.append((i, j + SHINGLE - 1, lo, hi + SHINGLE - 1, similarity))
                    break
            todo += [(begin, i), (j, end)]  # whether it was accepted or not
    return sorted(set(out))


PASSAGE_SCHEMA = "a long, b long, a_start int, a_end int, b_start int, b_end int, similarity double"


def _reach(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """How many shingles before (i, j) and from it on agree one by one."""
    n, m = min(i, j), min(len(a) - i, len(b) - j)
    before = a[i - n : i][::-1] != b[j - n : j][::-1]
    after = a[i : i + m] != b[j : j + m]
    return (int(before.argmax()) if before.any() else n), (int(after.argmax()) if after.any() else m)


def verified(a: np.ndarray, b: np.ndarray, links: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """Passages of two texts (their shingles) near the linked intervals (a_c, b_c, left, right) and on while they agree."""
    (al, ah), (bl, bh) = (len(a), 0), (len(b), 0)
    shifts, run = set(), None
    for i, j, left, right in sorted(links):
        shifts.add(j - i)
        if run and run[2] == j - i and run[0] <= i < run[1]:
            continue  # in the stretch that agrees round an anchor before
        before, after = _reach(a, b, i, j)
        run = (i - before, i + after, j - i)
        lo, hi = max(left, before), max(right + 1, after)
        al, ah, bl, bh = min(al, i - lo), max(ah, i + hi), min(bl, j - lo), max(bh, j + hi)
    s, e, t, u = max(0, al - LEAST), min(len(a), ah + LEAST), max(0, bl - LEAST), min(len(b), bh + LEAST)
    if len(shifts) == 1 and run[1] - run[0] >= SPAN and np.isin(a[s:e], b[t:u]).sum() == run[1] - run[0]:
        i, j, shift = run  # nothing is shared but one stretch, place by place
        return [(i, j + SHINGLE - 1, i + shift, j + shift + SHINGLE - 1, 1.0)]
    return [(i + s, j + s, k + t, m + t, similarity) for i, j, k, m, similarity in _passages(a[s:e], b[t:u], sorted(x - t + s for x in shifts))]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, a, b, a_c, b_c, left, right, body) sorted by task, texts first: the texts of one task are held."""
    task, held = None, {}
    pair, links = None, []
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    names = ["a", "b", "a_start", "a_end", "b_start", "b_end", "similarity"]

    def rows() -> list[tuple]:
        return [] if pair is None else [(*pair, *p) for p in verified(held[pair[0]], held[pair[1]], links)]

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        out: list[tuple] = []
        for at, a, b, *link, body in zip(*(batch.column(k).to_pylist() for k in range(8))):
            if at != task or body is not None or (a, b) != pair:
                out += rows()
                pair, links = None, []
                if at != task:
                    task, held = at, {}
            if body is not None:
                held[a] = _shingled(word_hashes(_bytes_of(body))[1])
            else:
                pair = (a, b)
                links.append(tuple(link))
        yield made(out)
    yield made(rows())


def verified_passages(links: DataFrame, texts: DataFrame) -> DataFrame:
    """The passages of all linked texts. A text travels once to each text that leads it, a leader once to ``TEXTS``."""
    degree = links.groupBy("a").agg(F.count_distinct("b").alias("n")).where(F.col("n") > TEXTS).select("a", F.ceil(F.col("n") / TEXTS).alias("parts"))
    spread = links.join(_sized(Stored(degree).df), "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    tasks = Stored(spread.select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("task"), *links.columns))
    needed = tasks.df.select("task", F.col("a").alias("text_key")).union(tasks.df.select("task", "b")).distinct()
    none = F.lit(None)
    rest = [none.cast("int").alias(c) for c in ("a_c", "b_c", "left", "right")]
    bodies = needed.join(texts, "text_key").select("task", F.col("text_key").alias("a"), none.cast("long").alias("b"), *rest, F.col("text").alias("body"))
    asked = bodies.unionByName(tasks.df.select("*", none.cast("string").alias("body")))
    found = Stored(asked.repartition("task").sortWithinPartitions("task", F.expr("body is null"), "a", "b").mapInArrow(_verify, PASSAGE_SCHEMA)).df
    tasks.drop()
    return found


def with_classes(found: DataFrame) -> DataFrame:
    """``found`` with passage_id: overlapping passages of a text are one, and linked ones are of one class."""
    ends = found.select(F.col("a").alias("t"), F.col("a_start").alias("s"), F.col("a_end").alias("e")).union(found.select("b", "b_start", "b_end")).distinct()
    order = W.partitionBy("t").orderBy("s", "e")
    fresh = F.coalesce(F.col("s") >= F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    begun = ends.withColumn("begin", F.when(fresh, F.col("s")))
    begun = begun.withColumn("begin", F.last("begin", True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    node = Stored(begun.select("t", "s", "e", F.xxhash64("t", "begin").alias("node"))).df
    for side in ("a", "b"):
        found = found.join(node.toDF(side, f"{side}_start", f"{side}_end", f"{side}_node"), [side, f"{side}_start", f"{side}_end"])
    found = Stored(found).df
    named = components(found.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    return found.join(_sized(named.select(F.col("node").alias("a_node"), F.col("component").alias("passage_id"))), "a_node")


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start_word, end_word, partner_id, partner_start, partner_end, n_words, similarity, passage_id).

    A verified passage of two linked texts gives a row in each direction between the ids that stand for their classes
    (the least of equal texts); every other copy of a text has one row with that id as partner, over the whole text and
    without passage_id. Two texts share a passage if they have a passage_id in common, directly or by their class.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key")).where(F.col(text).isNotNull())
    by_id = keyed.groupBy("text_key", "id").agg(F.count("*").alias("rows"))
    first = by_id.groupBy("text_key").agg(F.min(F.struct(F.col("id").isNull(), "id", "rows")).alias("first"), F.sum("rows").alias("n"))
    first = Stored(first.select("text_key", F.col("first.id").alias("first_id"), F.col("first.rows").alias("first_rows"), "n")).df
    many = first.where("n > 1")
    # Later copies are left out before any window is made; ids of copies are few against the texts.
    extra = keyed.join(_sized(many), "text_key", "left")
    # Rows of the first id may repeat: they are one again where keys of texts are grouped.
    texts = extra.where("n is null or (id <=> first_id and first_rows = 1)").select("text_key", "text")
    again = extra.where("id <=> first_id and first_rows > 1").groupBy("text_key").agg(F.first("text").alias("text"))
    texts = texts.unionByName(again)
    links = window_links(texts)
    found = with_classes(verified_passages(links, texts))
    ids = first.select("text_key", "first_id")
    named = found.join(ids.select(F.col("text_key").alias("a"), F.col("first_id").alias("a_id")), "a").join(ids.select(F.col("text_key").alias("b"), F.col("first_id").alias("b_id")), "b")

    def side(x: str, y: str) -> DataFrame:
        return named.select(
            F.col(f"{x}_id").alias(id_column), F.col(f"{x}_start").alias("start_word"), F.col(f"{x}_end").alias("end_word"),
            F.col(f"{y}_id").alias("partner_id"), F.col(f"{y}_start").alias("partner_start"), F.col(f"{y}_end").alias("partner_end"),
            F.expr(f"{x}_end - {x}_start").alias("n_words"), "similarity", "passage_id",
        )

    # The words of a class are counted once, however many copies it has.
    n_words = F.regexp_count(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+")).cast("int")
    sizes = texts.join(_sized(many.select("text_key")), "text_key", "left_semi").select("text_key", n_words.alias("n_words"))
    copies = by_id.join(_sized(many.select("text_key", "first_id", "first_rows")), "text_key").where("not id <=> first_id or first_rows > 1")
    # A condition on what is stored does not move before the join, where it would count the words of every text.
    copies = copies.join(_sized(Stored(sizes).df.where(F.col("n_words") >= LEAST)), "text_key")
    copies = copies.select(
        F.col("id").alias(id_column), F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), F.col("first_id").alias("partner_id"),
        F.lit(0).alias("partner_start"), F.col("n_words").alias("partner_end"), "n_words", F.lit(1.0).alias("similarity"), F.lit(None).cast("long").alias("passage_id"),
    )
    return side("a", "b").unionByName(side("b", "a")).unionByName(copies)


def _sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if counted to be at most ``rows``, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df
