"""Distributed union-find: connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.base import dropped, stored


def _mark(edges: DataFrame) -> tuple:
    """What tells two edge tables apart: the number of edges and two sums of their hashes."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit((1 << 32) - 1)))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(u, v), component being the smallest node reachable.

    Each round points neighbours at smaller nodes, as minima that combine before the shuffle and
    joins that adaptive execution may split; a star with a million leaves is never gathered in a
    task. Rounds are logarithmic in the component's size. Loops and null ends are ignored; no edges
    give no rows.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    mark = _mark(now)
    while True:
        both = now.select(F.col("a").alias("x"), F.col("b").alias("y")).union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = stored(both.where("y > x").join(least, "x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct())
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(roots, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(moved.union(roots.select("a", "m")).distinct())
        dropped(large)
        dropped(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b"), F.col("b")).distinct()
    )
