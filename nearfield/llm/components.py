"""Connected components over an edge table, by alternating large and small stars.

Every round is a handful of joins and partial aggregates keyed by node, its result is checkpointed in
the shared folder, and the loop ends when a round changes nothing; only a count and a digest of the
edges reach the driver. A node of very high degree is no join key: nodes of more than
max(``HUB``, edges / 50,000) edges, so 100,000 at most, are broadcast with their least neighbour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared


HUB = 512


def _with_least(pairs: DataFrame, hub: int) -> DataFrame:
    """``pairs`` (u, v) with m, the least v of each u; the pairs of a u that has over ``hub`` stay where they are."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.filter(F.col("n") > hub).select("u", "m"))
    few = pairs.join(hubs, "u", "left_anti").join(least.filter(F.col("n") <= hub).select("u", "m"), "u")
    return pairs.join(hubs, "u").unionByName(few)


def _large_star(e: DataFrame, hub: int) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(both, hub).filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame, hub: int) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("b"))
    rest = _with_least(e.select(F.col("a").alias("u"), F.col("b").alias("v")), hub).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return rest.unionAll(least).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b), any orderable type, no nulls, loops and repeats allowed → (node, label), where
    label is the least node of the component; nodes without an edge to another node do not appear."""
    e = shared(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(e)
    while seen[0]:
        hub = max(HUB, seen[0] // 50_000)
        e = shared(_large_star(e, hub))
        e = shared(_small_star(e, hub))
        now = _mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
