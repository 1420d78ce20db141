"""Sharding by a keyed permutation of global row numbers, in DataFrame expressions only.

Rows are numbered by the order of (MD5 of the id, id, further columns). The first hex digits of the MD5 are the
bucket of a row, as many digits as keep buckets near ``BUCKET_ROWS``: bucket sizes (the only thing that reaches the
driver) give each bucket its offset, so numbering needs no global sort and no task holds more than one bucket. An id
of over ``HOT_ROWS`` rows (null ids are one) is a bucket of its own, dealt to tasks by ranges of the further columns
and stored, so that its rows are numbered range by range. A Feistel network over a grid of about sqrt(n) x sqrt(n)
cells permutes the numbers; a number that leaves the range walks its cycle until it is back. Permuted number p gives
shard ``p % shards`` and slot ``p // shards``: counts differ by one at most, and the place of any row number can be
computed without the data.

Defined results: rows with a null id are numbered as if the id were empty; repeated rows get places of their own, and
rows that tie in the id and all further columns share their places in any order; an empty table stays empty; input
columns of the names written (row_number, shard, slot) are replaced, other names travel whatever they are.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkfield.llm.common import Stored, without

PRIME, ROUNDS, WALK = 2_147_483_647, 6, 64
#: Rows of a bucket, about, and rows of one id beyond which it is dealt to several tasks.
BUCKET_ROWS, HOT_ROWS = 65_536, 1_000_000


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(1, PRIME), rng.randrange(1, PRIME)) for _ in range(ROUNDS)]


def grid(n: int) -> tuple[int, int]:
    """The sides of the least near-square grid of n cells or more."""
    a = max(1, math.isqrt(max(1, n) - 1) + 1)
    return a, max(1, -(-n // a))


def mixed(v: int, key: tuple[int, int, int]) -> int:
    t = (v % PRIME + key[0]) % PRIME
    t = (t * t + key[1]) % PRIME
    return (t * key[2] + (t >> 15)) % PRIME


def permuted(x: int, n: int, seed: int) -> int:
    """The permutation for a single number, on the driver; the columns below compute the same."""
    (a, b), keys = grid(n), round_keys(seed)
    while True:
        left, right = divmod(x, b)
        for i, key in enumerate(keys):
            if i % 2 == 0:
                left = (left + mixed(right, key)) % a
            else:
                right = (right + mixed(left, key)) % b
        x = left * b + right
        if x < n:
            return x


def _square(v: Column, key) -> Column:
    t = (v % F.lit(PRIME) + F.lit(key[0])) % F.lit(PRIME)
    return (t * t + F.lit(key[1])) % F.lit(PRIME)


def _scaled(t: Column, key) -> Column:
    return (t * F.lit(key[2]) + F.shiftright(t, 15)) % F.lit(PRIME)


def _walker(x: Column, n: int, a: int, b: int, keys) -> Column:
    """Further steps along the cycle for the few numbers that left the range (fewer than 1 in sqrt(n))."""
    rounds = F.array(*[F.struct(F.lit(i % 2).alias("odd"), *[F.lit(k).cast("long").alias(f"k{j}") for j, k in enumerate(key)]) for i, key in enumerate(keys)])

    def turn(state: Column, r: Column) -> Column:
        v = F.when(r["odd"] == 0, state["r"]).otherwise(state["l"]) % PRIME
        t = (v + r["k0"]) % PRIME
        t = (t * t + r["k1"]) % PRIME
        m = (t * r["k2"] + F.shiftright(t, 15)) % PRIME
        return F.struct(
            F.when(r["odd"] == 0, (state["l"] + m) % a).otherwise(state["l"]).alias("l"),
            F.when(r["odd"] == 1, (state["r"] + m) % b).otherwise(state["r"]).alias("r"),
        )

    def step(at: Column, _: Column) -> Column:
        begin = F.struct(F.floor(at / b).cast("long").alias("l"), (at % b).alias("r")) if b > 1 else F.struct(at.alias("l"), F.lit(0).cast("long").alias("r"))
        return F.when(at < n, at).otherwise(F.aggregate(rounds, begin, turn, lambda s: s["l"] * b + s["r"]))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x, step)
    return F.when(x < n, x).otherwise(
        F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk did not end; choose another seed")).cast("long"))
    )


def permute_column(df: DataFrame, column: str, n: int, seed: int, out: str) -> DataFrame:
    """``df`` with ``out``: the permuted number of ``column`` (0 to n-1).

    A walk takes at most ``a`` steps, as the grid has fewer than ``a`` cells to spare. Over 64 steps can only happen
    beyond 4096 rows and then with a chance below 64 ** -64; the query fails rather than give a wrong place.
    """
    (a, b), keys = grid(n), round_keys(seed)
    df = df.withColumn("__lf_l", F.expr(f"{column} div {b}")).withColumn("__lf_r", F.col(column) % F.lit(b).cast("long"))
    for i, key in enumerate(keys):
        one, other, side = ("__lf_l", "__lf_r", a) if i % 2 == 0 else ("__lf_r", "__lf_l", b)
        df = df.withColumn("__lf_t", _square(F.col(other), key))
        df = df.withColumn(one, (F.col(one) + _scaled(F.col("__lf_t"), key)) % F.lit(side))
    df = df.withColumn("__lf_x", F.col("__lf_l") * F.lit(b) + F.col("__lf_r"))
    return df.withColumn(out, _walker(F.col("__lf_x"), n, a, b, keys)).drop("__lf_l", "__lf_r", "__lf_t", "__lf_x")


def number_rows(df: DataFrame, id_column: str, ties: tuple[str, ...] = (), digits: int | None = None, out: str = "row_number") -> tuple[DataFrame, int]:
    """Global row numbers from 0, and how many there are."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    if digits is None:
        digits = min(5, max(3, math.ceil(math.log(max(1, df.count() / BUCKET_ROWS), 16))))
    key = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    df = df.withColumn("__lf_h", key).withColumn("__lf_b", F.conv(F.substring(key, 1, digits), 16, 10).cast("int"))
    order = ["__lf_h", id_column, *ties]
    counts = {(b, 0): n for b, n in df.groupBy("__lf_b").count().collect()}
    large = [b for (b, _), n in counts.items() if n > HOT_ROWS]
    part = F.lit(0)
    if large:
        inside = df.where(F.col("__lf_b").isin(large))
        hot = [r[0] for r in inside.groupBy("__lf_h").count().where(F.col("count") > HOT_ROWS).select("__lf_h").collect()]
        # Rows before, of and after a hot id are parts of their bucket: even numbers and odd ones.
        for h in hot:
            mine = F.col("__lf_b") == int(h[:digits], 16)
            part = part + F.when(mine & (F.col("__lf_h") > h), 2).when(mine & (F.col("__lf_h") == h), 1).otherwise(0)
        df = df.withColumn("__lf_s", part)
        counts = {(b, s): n for b, s, n in df.groupBy("__lf_b", "__lf_s").count().collect()}
    else:
        df = df.withColumn("__lf_s", part)
    offsets, total = {}, 0
    for at in sorted(counts):
        offsets[at], total = total, total + counts[at]
    starts = [offsets.get((b, 0), 0) for b in range(16**digits)]
    start = F.element_at(F.lit(starts).cast("array<bigint>"), F.col("__lf_b") + 1)
    for (b, s), n in offsets.items():
        if s:
            start = F.when((F.col("__lf_b") == b) & (F.col("__lf_s") == s), F.lit(n).cast("long")).otherwise(start)
    w = W.partitionBy("__lf_b", "__lf_s").orderBy(*order)
    rank = (F.row_number().over(w).cast("long") - 1 + start).alias(out)
    numbered = df.where(F.col("__lf_s") % 2 == 0).select(*columns, rank)
    for b, s in sorted(at for at in offsets if at[1] % 2):
        rows = df.where((F.col("__lf_b") == b) & (F.col("__lf_s") == s)).withColumn("__lf_m", F.monotonically_increasing_id())
        ranges = rows.repartitionByRange(max(2, -(-counts[b, s] // HOT_ROWS)), *order, "__lf_m").withColumn("__lf_r", F.spark_partition_id())
        dealt = Stored(ranges.select(*columns, "__lf_h", "__lf_m", "__lf_r")).df  # stored, as the ranges come from a sample
        at, sizes = offsets[b, s], dict(dealt.groupBy("__lf_r").count().collect())
        begin = F.lit(0)
        for r in sorted(sizes):
            begin, at = F.when(F.col("__lf_r") == r, F.lit(at).cast("long")).otherwise(begin), at + sizes[r]
        own = W.partitionBy("__lf_r").orderBy(*order, "__lf_m")
        numbered = numbered.unionByName(dealt.select(*columns, (F.row_number().over(own).cast("long") - 1 + begin).alias(out)))
    return numbered, total


def shard(df: DataFrame, shards: int, id_column: str = "doc_id", ties: tuple[str, ...] = (), seed: int = 20_240_501, digits: int | None = None) -> DataFrame:
    """``df`` with row_number, shard (0 to ``shards`` - 1) and slot (gapless from 0 within the shard)."""
    df = without(df, ["row_number", "shard", "slot"])
    numbered, n = number_rows(df, id_column, ties, digits)
    placed = permute_column(numbered, "row_number", n, seed, "__lf_p")
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns], "row_number",
        (F.col("__lf_p") % shards).cast("int").alias("shard"), F.expr(f"__lf_p div {shards}").alias("slot"),
    )


def write_shards(df: DataFrame, path: str, shards: int, per_file: int = 0, **options) -> None:
    """Writes the rows of ``df`` to one folder a shard, in slot order within files; big shards are split by slots."""
    placed = shard(df, shards, **options)
    step = per_file or max(1, -(-df.count() // shards))
    parts = placed.repartitionByRange(shards, "shard", F.expr(f"slot div {step}")).sortWithinPartitions("shard", "slot")
    parts.write.partitionBy("shard").parquet(path)


def oracle(shards: int = 16, seed: int = 20_240_501) -> str:
    """DuckDB SQL for the places of ``documents`` under the same permutation: the whole grid is permuted, then walked."""
    steps, before = [], "dom"
    for i, (k0, k1, k2) in enumerate(round_keys(seed)):
        one, other, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        steps.append(f"t{i} AS (SELECT *, ({other} % {PRIME} + {k0}) % {PRIME} AS t FROM {before})")
        steps.append(f"u{i} AS (SELECT * REPLACE ((t * t + {k1}) % {PRIME} AS t) FROM t{i})")
        steps.append(f"s{i} AS (SELECT * EXCLUDE (t) REPLACE (({one} + (t * {k2} + (t >> 15)) % {PRIME}) % {side} AS {one}) FROM u{i})")
        before = f"s{i}"
    crc_table = (
        "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: "
        "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))"
    )
    return f"""
WITH RECURSIVE tab AS MATERIALIZED ({crc_table}),
raw AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, hex(encode(coalesce(text, ''))) AS x FROM documents),
parsed AS (SELECT doc_id, n_bytes, list_transform(range(n_bytes), lambda i: CAST(('0x' || x[2 * i + 1 : 2 * i + 2]) AS BIGINT)) AS bytes FROM raw),
d AS MATERIALIZED (SELECT doc_id, n_bytes + 1 AS size,
    xor(list_reduce(bytes, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM parsed, tab),
numbered AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size, text_crc32) - 1 AS x FROM d),
c0 AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents),
c AS (SELECT n, a, (n + a - 1) // a AS b FROM c0),
dom AS (SELECT x, x // b AS l, x % b AS r, a, b FROM (SELECT unnest(range(a * b)) AS x, a, b FROM c)),
{", ".join(steps)},
p AS MATERIALIZED (SELECT x, l * b + r AS y FROM {before}),
w AS (SELECT x, y FROM p WHERE x < (SELECT n FROM c) UNION ALL SELECT w.x, p.y FROM w JOIN p ON p.x = w.y WHERE w.y >= (SELECT n FROM c))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(y % {shards} AS INT) AS shard, y // {shards} AS slot,
    CAST(NULL AS INT) AS grown_shard FROM numbered JOIN w USING (x) WHERE y < (SELECT n FROM c)"""
