"""Connected components of an edge table by alternating large-star and small-star steps.

No step gathers a node's neighbours: minima are aggregated with partial aggregation and joined back, so a hub with many
edges is no more than a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm._common import materialize


SMALL_EDGES, EDGES_PER_TASK = 1_000_000, 50_000


def _dealt(pairs: DataFrame, edges: int) -> DataFrame:
    """Few edges are dealt by u to few tasks, so that what groups and joins them shuffles once. Many are left as they are:
    a hub would put all its edges into one task."""
    return pairs if edges > SMALL_EDGES else pairs.repartition(4 + edges // EDGES_PER_TASK, "u")


def _toward_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m) where m is the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b): component is the least node reachable, the node itself included.

    Loops and repeated edges are allowed, null ends are dropped, an empty table gives no rows. Each round is written to
    the scratch folder; the number of rounds grows with the logarithm of the longest path.
    """
    now = materialize(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if state == before or not state[0]:
            break
        before, n = state, state[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(_dealt(both, 2 * n)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _toward_minimum(_dealt(large, 2 * n).distinct())
        now = materialize(_dealt(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v"), 2 * n).distinct())
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
