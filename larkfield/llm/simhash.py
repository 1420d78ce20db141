"""SimHash near-duplicates: fingerprints are dealt to the leaves of a vantage-point tree and compared exactly there.

The tree is built on a bounded sample of distinct fingerprints (``SAMPLE``); every fingerprint is then indexed. For
links at ``radius`` differing bits, each fingerprint goes to all leaves that its ball of half that radius (rounded
up) touches, by the triangle bounds of the vantage points. Two linked fingerprints have a midpoint within half the
radius of both, and the leaf of the midpoint holds both, so no link is lost; the smaller ball keeps replication low.
A leaf over ``LEAF_LIMIT`` gets a tree of its own, built on the executors from at most ``SUB_SAMPLE`` of its
fingerprints, and so on while that splits it. What stays large, since its fingerprints lie close together, is compared in
pairs of blocks, so that no task holds an unbounded group.

Defined results: a null or empty text has fingerprint zero and links like any other; a null id takes part but never
names a component unless all ids of the component are null; repeated rows share a component; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.llm.common import Stored, append_columns, small_batches
from larkfield.llm.graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
SAMPLE, LEAF_TARGET, LEAF_LIMIT, BLOCK = 32_768, 2_048, 24_576, 8_192
#: Fingerprints of a large leaf that its own tree is built on at most, rows of it in a task, and levels of such trees.
SUB_SAMPLE, SUB_ROWS, LEVELS = 8_192, 500_000, 3
#: Leaves that a fingerprint of a large leaf goes to on average, at most.
COPIES = 2
#: At most so many ids to drop are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_SLICE = 32_768


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; one is set if it is set in over half the XXH64 values of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    total, counts = max(1, len(words) - shingle + 1), np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, _SLICE):
        size = min(_SLICE, total - start)
        values = np.fromiter((digest(g, SEED) for g, _ in zip(grams, range(size))), dtype=np.uint64, count=size)
        counts += np.unpackbits(values[:, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, name: str = "fingerprint_bits") -> DataFrame:
    field = T.StructField(name, T.LongType())
    return append_columns(docs, text, [field], lambda texts: {name: [simhash(t, shingle) for t in texts]})


@dataclass(frozen=True)
class VantageTree:
    """A complete tree in heap order: node i has children 2i+1 (within ``bound``) and 2i+2 (beyond it)."""

    points: np.ndarray
    bounds: np.ndarray
    depth: int

    def leaves(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """All (position, leaf) such that a ball of ``reach`` round the value touches the leaf."""
        at, node = np.arange(len(values)), np.zeros(len(values), dtype=np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(values[at] ^ self.points[node]).astype(np.int64)
            near, far = d - reach <= self.bounds[node], d + reach > self.bounds[node]
            at, node = np.concatenate([at[near], at[far]]), np.concatenate([2 * node[near] + 1, 2 * node[far] + 2])
        return at, node


def build_tree(sample: np.ndarray, depth: int, reach: int, seed: int = 7) -> VantageTree:
    """Of some candidate vantage points and bounds near the median, each node takes those that cut the fewest balls."""
    rng = np.random.default_rng(seed)
    n = 2**depth - 1
    points, bounds = np.zeros(n, dtype=np.uint64), np.full(n, 32, dtype=np.int64)
    members = {0: sample}
    for i in range(n):
        own = members.pop(i)
        if len(own) == 0:
            points[i] = rng.integers(0, 2**63, dtype=np.uint64)
        else:
            best = None
            for v in own[rng.integers(0, len(own), 6)]:
                d = np.bitwise_count(own ^ v)
                middle = int(np.median(d))
                for m in range(max(0, middle - 3), middle + 4):
                    inside = (d <= m).mean()
                    cut = ((d > m - reach) & (d <= m + reach)).mean()
                    cost = cut + 2 * abs(inside - 0.5)
                    if best is None or cost < best[0]:
                        best = (cost, v, m)
            points[i], bounds[i] = best[1], best[2]
        if 2 * i + 2 < n:
            inside = np.bitwise_count(own ^ points[i]).astype(np.int64) <= bounds[i]
            members[2 * i + 1], members[2 * i + 2] = own[inside], own[~inside]
    return VantageTree(points, bounds, depth)


def local_components(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, least value of its component) for components of two or more, by exact comparison.

    Each value is compared with those not yet reached, which it takes out, so dense groups never yield all pairs.
    """
    left = np.unique(values)
    found, root = [], []
    while len(left):
        group, left = [left[0]], left[1:]
        for x in group:
            hit = np.bitwise_count(left ^ x) <= radius
            if hit.any():
                group.extend(left[hit])
                left = left[~hit]
        if len(group) > 1:
            least = min(v.astype(np.int64) for v in group)
            found.extend(group)
            root.extend([least] * len(group))
    return np.array(found, dtype=np.uint64).view(np.int64), np.array(root, dtype=np.int64)


def linked_fingerprints(distinct: DataFrame, radius: int = RADIUS, column: str = "fingerprint_bits") -> DataFrame:
    """(node, component) for every distinct fingerprint that has another within ``radius`` bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64(column), column).limit(SAMPLE).collect()
    drawn = np.array([r[0] for r in sample], dtype=np.int64).view(np.uint64)
    depth = min(max(0, int(np.ceil(np.log2(max(1, n) / LEAF_TARGET)))), max(0, int(np.log2(max(1, len(drawn)) / 8))))
    reach = (radius + 1) // 2
    tree = spark.sparkContext.broadcast(build_tree(drawn, depth, reach))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(values), 4096):
                part = values[i : i + 4096]
                at, leaf = tree.value.leaves(part.view(np.uint64), reach)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(part[at])], names=["leaf", "value"])

    dealt = Stored(distinct.select(column).mapInArrow(deal, "leaf long, value long"))
    for _ in range(LEVELS):
        finer = _split_leaves(dealt.df, reach)
        if finer is None:
            break
        dealt.drop()
        dealt = finer
    large = dealt.df.groupBy("leaf").count().where(F.col("count") > LEAF_LIMIT)
    large = large.select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("k"))
    blocks = dealt.df.join(_few(large), "leaf", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("value"), F.col("k")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    tasks = blocks.withColumn("own", own).select("leaf", "value", "own", other.alias("other"))
    tasks = tasks.select("leaf", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found, root = local_components(pdf["value"].to_numpy().astype(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"a": found, "b": root})

    edges = tasks.groupBy("leaf", "i", "j").applyInPandas(search, "a long, b long")
    out = components(edges.where("a != b"))
    dealt.drop()
    return out


def _split_leaves(dealt: DataFrame, reach: int) -> Stored | None:
    """The rows (leaf, value) with large leaves dealt on by trees of their own; None if no leaf is large."""
    sizes = Stored(dealt.groupBy("leaf").count().where(F.col("count") > LEAF_LIMIT))
    if not sizes.df.limit(1).count():
        sizes.drop()
        return None
    large = dealt.join(_few(sizes.df), "leaf")
    share = F.ceil(F.col("count") / SUB_SAMPLE)
    drawn = large.where(F.pmod(F.xxhash64("value", F.lit(3)), share) == 0)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(pdf["value"].to_numpy().astype(np.int64)).view(np.uint64)[: 4 * SUB_SAMPLE]
        size = int(pdf["count"].iloc[0])
        depth = min(max(1, int(np.ceil(np.log2(size / LEAF_TARGET)))), max(1, int(np.log2(max(1, len(values)) / 8))))
        tree = build_tree(values, depth, reach)
        # Only as deep as balls are seldom cut: fingerprints close together would be copied to most leaves.
        while depth and len(VantageTree(tree.points, tree.bounds, depth).leaves(values, reach)[0]) > COPIES * len(values):
            depth -= 1
        tree = VantageTree(tree.points[: 2**depth - 1], tree.bounds[: 2**depth - 1], depth)
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[:1], "count": [size], "tree": [tree.points.tobytes() + tree.bounds.tobytes()]})

    trees = Stored(drawn.groupBy("leaf").applyInPandas(build, "leaf long, count long, tree binary"))
    parts = F.ceil(F.col("count") / SUB_ROWS).cast("int")
    # Each task of a leaf gets its tree first, then values.
    first = trees.df.select("leaf", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("long").alias("value"), "tree")
    rest = large.select("leaf", F.pmod(F.xxhash64("value"), parts).cast("int").alias("part"), "value", F.lit(None).cast("binary").alias("tree"))
    rows = first.unionByName(rest).repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.col("tree").isNull())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            packed, leaves = batch.column(3), batch.column(0).to_numpy()
            at = [*[i for i, x in enumerate(packed.is_valid().to_pylist()) if x], len(leaves)]
            for i, j in zip([0, *at] if at[0] else at, [*at] if at[0] else at[1:]):
                if packed[i].is_valid:
                    raw = np.frombuffer(packed[i].as_py(), dtype=np.uint64)
                    half = len(raw) // 2
                    tree = VantageTree(raw[:half], raw[half:].view(np.int64), int(np.log2(half + 1)))
                    i += 1
                if i < j:
                    values = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64)
                    found, leaf = tree.leaves(values.view(np.uint64), reach)
                    # Numbers of leaves are hashed; two that fell together would only be compared together.
                    fresh = np.array([xxhash.xxh64_intdigest(leaves[i].tobytes(), int(k)) for k in np.unique(leaf)], dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(fresh[np.searchsorted(np.unique(leaf), leaf)]), pa.array(values[found])], names=["leaf", "value"])

    finer = rows.mapInArrow(deal, "leaf long, value long")
    out = Stored(dealt.join(_few(sizes.df.select("leaf")), "leaf", "left_anti").unionByName(finer))
    trees.drop()
    sizes.drop()
    return out


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(id, fingerprint_bits, component_node, component_id) for each row of ``docs``."""
    rows = Stored(with_fingerprints(docs.select(F.col(id_column), F.col(text)), text, shingle).select(id_column, "fingerprint_bits")).df
    return group_fingerprints(rows, id_column, radius)


def group_fingerprints(rows: DataFrame, id_column: str, radius: int = RADIUS) -> DataFrame:
    groups = rows.groupBy("fingerprint_bits").agg(F.min(id_column).alias("first_id"), F.count("*").alias("n"))
    linked = linked_fingerprints(groups.select("fingerprint_bits"), radius)
    named = groups.join(linked, F.col("fingerprint_bits") == F.col("node"), "left").where("n > 1 or node is not null")
    named = named.select("fingerprint_bits", F.coalesce("component", "fingerprint_bits").alias("component_node"), "first_id")
    least = named.groupBy("component_node").agg(F.min("first_id").alias("component_id"))
    lookup = Stored(named.drop("first_id").join(least, "component_node")).df
    out = rows.join(lookup, "fingerprint_bits", "left")
    return out.select(
        id_column, "fingerprint_bits", F.coalesce("component_node", "fingerprint_bits").alias("component_node"),
        F.when(F.col("component_node").isNull(), F.col(id_column)).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, the least text first among rows of one id.

    Only ids of dropped rows travel; they are broadcast if counted to be few, else joined by a shuffle. Rows of an id
    that has several, some of which may stay, are told apart by their fingerprints.
    """
    groups = Stored(near_duplicates(docs, id_column, text, shingle, radius)).df
    stays = F.col(id_column).eqNullSafe(F.col("component_id"))
    ids = groups.groupBy(F.col(id_column).alias("__id")).agg(F.count("*").alias("n"), F.max(stays).alias("some"))
    ids = Stored(ids.where("n > 1 or not some").select("__id", "some")).df
    gone, several = ids.where("not some").select("__id"), ids.where("some").select("__id")
    same = F.col(id_column).eqNullSafe(F.col("__id"))
    kept = docs.join(_few(ids.select("__id")), same, "left_anti") if ids.limit(1).count() else docs
    if not several.limit(1).count():
        return kept
    names = {c.lower() for c in docs.columns}
    bits = next(n for n in ("__bits", "__bits_", "__bits__") if n not in names)
    extra = with_fingerprints(docs.join(_few(several), same, "left_semi"), text, shingle, bits)
    nodes = groups.where(stays).select(F.col(id_column).alias("__id"), F.col("fingerprint_bits").alias("__fp"), F.col("component_node").alias("__node")).distinct()
    extra = extra.join(_few(nodes.join(_few(several.toDF("__s")), F.col("__id").eqNullSafe(F.col("__s")), "left_semi")), same & (F.col(bits) == F.col("__fp")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    best = extra.groupBy("__id", "__node").agg(F.min_by(F.struct(*columns), F.struct(F.col(text), F.xxhash64(*columns))).alias("__row"))
    return kept.unionByName(best.select("__row.*"))


def _few(df: DataFrame) -> DataFrame:
    """Broadcast if counted to be at most ``BROADCAST_IDS`` narrow rows, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


#: For similarity, a text has ``VIEWS`` further fingerprints, each of its ``PICKED`` shingles that hash least for the view.
VIEWS, PICKED, WIDE_SHINGLE, SIMILARITY = 8, 3, 5, 0.8
#: Rows of a view's fingerprint that are compared in one task; least hashes of a text that travel with it for that, and those
#: by which pairs are looked up; pairs that are compared at once.
MEET, FINE, BINS, PAIRS = 8_192, 1_024, 128, 10_000
_VIEW_SCHEMA = "view int, bits long, text_key long, n int, bins binary"


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of the word shingles (of the whole text if it is shorter)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64))


def view_fingerprints(values: np.ndarray) -> list[int]:
    """A SimHash for each view, over the shingles that come first in the view's order."""
    out = []
    for view in range(VIEWS):
        mixed = (values ^ np.uint64(xxhash.xxh64_intdigest(b"view", view))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        first = values[np.argpartition(mixed, PICKED - 1)[:PICKED]] if len(values) > PICKED else values
        counts = np.unpackbits(first[:, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(first), bitorder="little").view(np.int64)[0]))
    return out


def least_bins(values: np.ndarray) -> np.ndarray:
    """16 bits of the least hash in each of ``FINE`` equal ranges of sorted hashes; 0 for an empty range."""
    out = np.zeros(FINE, dtype=np.uint16)
    bins, at = np.unique(values >> np.uint64(65 - FINE.bit_length()), return_index=True)
    out[bins.astype(np.int64)] = np.maximum(values[at] & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
    return out


def coarse_bins(fine: np.ndarray) -> np.ndarray:
    """The least hashes of ``BINS`` wider ranges: each holds that of its first fine range that is not empty."""
    parts = fine.reshape(len(fine), BINS, FINE // BINS)
    return np.take_along_axis(parts, (parts != 0).argmax(2)[:, :, None], axis=2)[:, :, 0]


def still_similar(mine: np.ndarray, others: np.ndarray, n_mine: np.ndarray, n_others: np.ndarray) -> np.ndarray:
    """As ``may_be_similar`` with ``FINE`` least hashes and the sizes of both texts.

    Each range shows one random shingle of both texts together, none twice. Of a text of a few hundred shingles nearly all
    are seen, so the number that differ strays less, by the share that is not seen.
    """
    used = ((others != 0) | (mine != 0)).sum(1)
    same = ((others == mine) & (mine != 0)).sum(1)
    unseen = np.clip(1 - used * (1 + SIMILARITY) / (n_mine + n_others), 0.02, 1)
    return used - same <= (1 - SIMILARITY) * used + 1 + 4 * np.sqrt(SIMILARITY * (1 - SIMILARITY) * used * unseen)


def _slack(used: np.ndarray) -> np.ndarray:
    """How many of ``used`` least hashes may differ between texts of ``SIMILARITY``, within four deviations."""
    return (1 - SIMILARITY) * used + 4 * np.sqrt(SIMILARITY * (1 - SIMILARITY) * used)


def may_be_similar(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether the number of different least hashes, row by row, allows the similarity."""
    used = ((others != 0) | (mine != 0)).sum(1)
    same = ((others == mine) & (mine != 0)).sum(1)
    return used - same <= _slack(used)


def likely_pairs(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rows whose least hashes allow the similarity, each pair once.

    Of the hashes of a row, more than may differ are looked up in the others: those that the fewest rows have. Rows that
    share no more than what very many have (a long common passage) are therefore never compared.
    """
    n = len(bins)
    count = np.zeros(bins.shape, dtype=np.int64)
    order = np.argsort(bins, axis=0, kind="stable")
    sizes = []  # for each range of hashes: where the run of a row's hash begins among the rows in order
    for lane in range(BINS):
        values = bins[order[:, lane], lane]
        begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        run = np.diff(np.append(begin, n))
        place = np.empty(n, dtype=np.int64)
        place[order[:, lane]] = np.repeat(begin, run)
        count[order[:, lane], lane] = np.repeat(run, run)
        sizes.append(place)
    count[bins == 0] = n + 1
    used = (bins != 0).sum(1)
    needed = np.minimum(used, np.floor(_slack(used)).astype(np.int64) + 1)
    rarest = np.argsort(count, axis=1, kind="stable")
    found = []
    for step in range(int(needed.max(initial=0))):
        rows = np.flatnonzero(needed > step)
        lanes = rarest[rows, step]
        shared = count[rows, lanes] > 1
        rows, lanes = rows[shared], lanes[shared]
        for lane in np.unique(lanes):
            mine = rows[lanes == lane]
            size, begin = count[mine, lane], sizes[lane][mine]
            for part in range(0, len(mine), 256):
                x, m, b = mine[part : part + 256], size[part : part + 256], begin[part : part + 256]
                left = np.repeat(x, m)
                at = np.repeat(b - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                right = order[at, lane]
                keep = left != right
                left, right = left[keep], right[keep]
                good = may_be_similar(bins[left], bins[right])
                found.append(np.minimum(left, right)[good] * n + np.maximum(left, right)[good])
        if len(found) > 64:
            found = [np.unique(np.concatenate(found))]
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return pairs // max(1, n), pairs % max(1, n)


def _view_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            values = shingle_set(text)
            if len(values):
                rows[0].extend(range(VIEWS))
                rows[1].extend(view_fingerprints(values))
                rows[2].extend([key] * VIEWS)
                rows[3].extend([len(values)] * VIEWS)
                rows[4].extend([least_bins(values).tobytes()] + [None] * (VIEWS - 1))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=["view", "bits", "text_key", "n", "bins"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, None)
    for batch in batches:
        keep = []
        for i, (a, left, right) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))):
            if last[0] != a:
                last = (a, shingle_set(left))
            other = shingle_set(right)
            shared = len(np.intersect1d(last[1], other, assume_unique=True))
            if shared >= SIMILARITY * (len(last[1]) + len(other) - shared):
                keep.append(i)
        picked = pa.array(keep, type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked)], names=["a", "b"])


def _open_groups(views: DataFrame) -> DataFrame:
    """The rows of views' fingerprints that texts of different components share, with the size of their group."""
    size = views.groupBy("view", "bits").agg(F.count("*").alias("size"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    size = Stored(size.where("c0 != c1").select("view", "bits", "size")).df
    return views.join(_few(size), ["view", "bits"])


def _meetings(views: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of different components that share a view's fingerprint and whose sizes allow the similarity.

    Groups of up to five meet in all pairs. In larger ones each text meets the first and its neighbour, by an order that
    changes with the view from the second turn on, so that pairs are linear in the rows; groups of over ``MEET`` are
    ordered in parts.
    """
    salt = F.lit(0) if turn == 0 else F.col("view") + 1_000 * turn
    part = F.pmod(F.xxhash64("text_key", F.lit(7)), F.ceil(F.col("size") / MEET))
    group = W.partitionBy("view", "bits", "part").orderBy(F.xxhash64("text_key", salt), "text_key")
    me = F.struct("text_key", "n", "component")
    opened = _open_groups(views)
    rows = opened.withColumn("part", part)
    close = [F.when(F.col("size") <= 5, F.col(f"l{i}")) for i in (2, 3, 4)]
    rows = rows.select("view", "bits", "size", me.alias("x"), F.first(me).over(group).alias("l0"), *[F.lag(me, i).over(group).alias(f"l{i}") for i in (1, 2, 3, 4)])
    met = rows.select("x", F.explode(F.array_distinct(F.array("l0", "l1", *close))).alias("y"))
    # In groups that are ordered in parts, each text meets the first of the whole group too.
    large = opened.where(F.col("size") > MEET)
    lead = large.groupBy("view", "bits").agg(F.min(me).alias("y"))
    met = met.unionByName(large.join(_few(lead), ["view", "bits"]).select(me.alias("x"), "y"))
    met = met.where("y is not null and x.component != y.component").where(F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * SIMILARITY)
    return met.select(F.least("x.text_key", "y.text_key").alias("a"), F.greatest("x.text_key", "y.text_key").alias("b")).distinct()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, i, j, own, text_key, n, component, bins) sorted by task: pairs of texts that may be similar."""
    task, rows = None, []

    def found() -> Iterator[pa.RecordBatch]:
        if len({r[3] for r in rows}) < 2:
            return
        own, keys, n, component = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
        fine = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint16).reshape(len(rows), FINE)
        x, y = likely_pairs(coarse_bins(fine))
        fits = (component[x] != component[y]) & (np.minimum(n[x], n[y]) >= SIMILARITY * np.maximum(n[x], n[y]))
        if task[1] != task[2]:  # what lies in one block meets in its own task
            fits &= own[x] != own[y]
        x, y = x[fits], y[fits]
        for at in range(0, len(x), PAIRS):
            i, j = x[at : at + PAIRS], y[at : at + PAIRS]
            good = still_similar(fine[i], fine[j], n[i], n[j])
            a, b = keys[i[good]], keys[j[good]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        for *at, own, key, n, component, bins in zip(*(batch.column(k).to_pylist() for k in range(8))):
            if at != task:
                yield from found()
                task, rows = at, []
            rows.append((own, key, n, component, bins))
    yield from found()


def _remaining(views: DataFrame, bins: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components that share a view's fingerprint and whose least hashes allow the
    similarity, for groups that turns met in part. Groups of over ``MEET`` rows are compared in pairs of blocks."""
    k = F.ceil(F.col("size") / MEET).cast("int")
    rows = _open_groups(views).where("size > 5").withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("text_key"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).join(bins, "text_key")
    tasks = rows.select(
        F.xxhash64("view", "bits").alias("task"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "text_key", "n", "component", "bins",
    )
    return tasks.repartition("task", "i", "j").sortWithinPartitions("task", "i", "j").mapInArrow(_compared, "a long, b long").distinct()


def similar_texts(docs: DataFrame, text: str = "text", turns: int = 1) -> DataFrame:
    """(node, component) of text keys: texts that share a view's fingerprint, verified at ``SIMILARITY`` of five-word sets.

    A turn merges most of a large group by few pairs; then every pair left of different components is compared by the
    least hashes of its texts, and verified where these allow the similarity.

    Two texts of similarity J share a view with probability about J ** 3, and one of eight at 0.8 with 0.997. Each
    turn lets texts meet again that share a view but no component yet; only their texts are read once more.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.xxhash64(text).alias("text_key"), F.col(text).alias("body")).where(F.col(text).isNotNull())
    made = Stored(keyed.mapInArrow(_view_rows, _VIEW_SCHEMA))
    single = Stored(made.df.select("view", "bits", "text_key", "n").distinct())
    views = single.df
    bins = made.df.where("bins is not null").groupBy("text_key").agg(F.first("bins").alias("bins"))
    temporary = [made, single]
    apart = views.withColumn("component", F.col("text_key"))
    done: DataFrame | None = None
    tried: DataFrame | None = None
    for turn in range(turns + 1):
        pairs = _meetings(apart, turn) if turn < turns else _remaining(apart, bins)
        pairs = Stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        keys = pairs.df.select(F.col("a").alias("text_key")).union(pairs.df.select("b")).distinct()
        # Without the broadcast, all texts would be shuffled to keep a few. Texts that repeat are verified once.
        wanted = keyed.join(_few(keys), "text_key", "left_semi").groupBy("text_key").agg(F.first("body").alias("body"))
        both = pairs.df.join(wanted.toDF("a", "left"), "a").join(wanted.toDF("b", "right"), "b").select("a", "b", "left", "right")
        fresh = Stored(both.mapInArrow(_similar, "a long, b long"))
        temporary += [pairs, fresh]
        done = fresh.df if done is None else done.unionByName(fresh.df)
        tried = pairs.df if tried is None else tried.unionByName(pairs.df)
        found = components(done)
        if turn < turns:
            at = found.select(F.col("node").alias("text_key"), "component")
            apart = views.join(_few(at), "text_key", "left").withColumn("component", F.coalesce("component", "text_key"))
    for table in temporary:  # the components are in a table of their own
        table.drop()
    return found


def keep_one_similar(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without texts that are similar (0.8 of five-word shingles) to one of a smaller id, through any chain.

    Equal texts are similar; rows equal in id and text stay or go together. Null texts stay.
    """
    found = similar_texts(docs, text)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.xxhash64(text).alias("node"))
    rows = Stored(rows.join(_few(found), "node", "left").withColumn("component", F.coalesce("component", "node"))).df
    best = rows.groupBy("component").agg(F.min(F.struct("id", "node")).alias("best"), F.count("*").alias("n")).where("n > 1")
    stays = F.struct("id", "node") == F.col("best")
    gone = Stored(rows.join(_few(best), "component").where(~stays).select(F.col("node").alias("__node"), F.col("id").alias("__id")).distinct()).df
    same = (F.xxhash64(text) == F.col("__node")) & F.col(id_column).eqNullSafe(F.col("__id"))
    return docs.join(_few(gone), same, "left_anti")
