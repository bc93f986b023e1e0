"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townmeter.llm.common import Scratch, checked


def _hang(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Hang every neighbour of a node on the least one: (u, v), (u, m) to (v, m)."""
    return pairs.join(least, "u").filter(F.col("v") != F.col("m")).select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that it reaches.

    Each round sums up a node's neighbours by their minimum before the shuffle, writes it and joins
    it back, so that the links of a node with very many stay where they are or are split like any
    skewed join; a round's links are written, and rounds end when they no longer change. Stars converge in O(log n) rounds.
    """
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    edges = scratch.put(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    seen = mark(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        first = scratch.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = _hang(both.filter("v > u"), checked(first)).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _hang(down, least).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        last, edges = edges, scratch.put(small)
        for used in (last, first):
            scratch.drop(used)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
