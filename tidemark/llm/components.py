"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scratch


def _centred(links: DataFrame) -> DataFrame:
    """(u, v, m): each link with the least node among u and its neighbours. Minima are pre-aggregated, so a hub
    costs one row per task there; in the join back, adaptive execution splits a hub's partition."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return links.join(least.hint("merge"), "u")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links``; a component is named by its least node.

    Links are undirected; repeated links and loops don't matter (a node with only a loop is its own component); NULL
    ends are dropped. Large-star hangs each node's greater neighbours on its least neighbour, small-star does so with
    the lesser ones; when a round changes no link, every component is a star. Each round is written to the shared
    folder. Raises when ``rounds`` don't suffice (they grow as the logarithm of the longest chain).
    """
    spark = links.sparkSession
    raw = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    loops = raw.where(F.col("u") == F.col("v")).select(F.col("u").alias("node"))
    paths = [scratch.new_path(spark, "links")]
    edges = scratch.materialize(raw.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path=paths[0])
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _centred(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        c = _centred(large)
        small = c.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(c.select("u", F.col("m").alias("v")))
        small = small.where(F.col("u") != F.col("v")).distinct()
        paths.append(scratch.new_path(spark, "links"))
        edges = scratch.materialize(small, path=paths[-1])
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if len(paths) > 2:
            scratch.remove(spark, paths[-3])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components didn't settle")
    scratch.remove(spark, paths[-2])
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = members.unionByName(centres)
    alone = loops.distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))
