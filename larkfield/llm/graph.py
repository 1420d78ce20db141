"""Connected components of an edge list by alternating star contractions, with all state in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from larkfield.llm.common import Stored


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node reaches. Nodes without edges do not appear.

    A large-star step hangs every larger neighbour on the least node of a neighbourhood, a small-star step does so
    with the smaller ones; both keep connectivity, and edges end up as stars. Minima are aggregated before the
    shuffle, so a node with very many edges costs no more than its rows. Each round is written to the shared folder.
    """
    pair = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    state, seen = _marked(edges.where(F.col(a) != F.col(b)).select(*pair).distinct())
    for _ in range(max_rounds):
        e = state.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after, mark = _marked(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state.drop()
        state = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = state.df
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _marked(edges: DataFrame) -> tuple[Stored, tuple]:
    """The edges stored, with their number and a sum of their hashes, which are taken while they are written."""
    seen = Observation()
    stored = Stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    return stored, (seen.get["n"], seen.get["h"])
