"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, stored


def _signed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """A stored copy of the edges and a signature that tells whether a step changed anything."""
    seen = Observation()
    out = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")))
    return out, (seen.get["n"], seen.get["x"])


def _parents(edges: DataFrame) -> DataFrame:
    return stored(edges.groupBy("u").agg(F.min("v").alias("p")))


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """The smallest node reachable from each node.

    Returns node and component for every node that can reach a smaller one; all others are their own component. Loops and
    edges with a null end are ignored, repeated edges count once, and no edges give no rows. Parents are pre-aggregated and
    skewed joins divide the children of a hub, so one node with very many neighbours does not fill a single task.
    Each step is written to the shared folder.
    """
    a, b = F.col(f"`{a}`").cast("long"), F.col(f"`{b}`").cast("long")
    cur, last = _signed(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(most):
        if not last[0]:
            break
        up = _parents(cur)
        # both sides are written tables, so a join divides the children of a hub, and sends what is small
        large = stored(cur.join(up.select(F.col("u").alias("v"), "p"), "v", "left").select("u", F.coalesce("p", "v").alias("v")).distinct())
        least = _parents(large)
        moved = large.join(least, "u").where(F.col("v") != F.col("p")).select(F.col("v").alias("u"), F.col("p").alias("v"))
        after, now = _signed(moved.union(least.select("u", F.col("p").alias("v"))).distinct())
        for x in (cur, up, large, least):
            discard(x)
        cur = after
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
