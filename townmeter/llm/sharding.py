"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townmeter.llm.common import Scratch

#: Parts of a shard that are numbered on their own, so that no task sorts a whole shard.
PARTS = 256
#: Copies of one row that a task makes of their count at a time.
PIECE = 100_000


def _unit(*keys: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53)


def _bids(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """Each shard's bid for a key, -ln(u) / weight: the least one wins, ties go to the smaller shard."""
    return F.array(*[
        F.struct((-F.log(_unit(key, F.lit(s).cast("long"))) / F.lit(float(w))).alias("bid"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights, first)
    ])


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, 0 to len(weights) - 1, by weighted rendezvous hashing.

    The key and the weights alone decide. A shard put at the end takes keys, and no key moves
    between the others. A null key is a key of its own. Weights are positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return F.array_min(_bids(key, weights))["shard"]


def assign(docs: DataFrame, weights: Sequence[float], grown: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 8; a null text counts as empty. slot numbers the rows of a
    shard from 0 without gaps, by a hash of the row. grown_shard: the shard after one more with
    weight `grown` is added. Repeated rows share a shard and get slots of their own; an empty
    table gives an empty one; other columns are ignored, whatever their names.

    Equal rows are counted per task before the shuffle, so a key, or no key, with very many of
    them is one row; different texts of one key are dealt to different parts. The sizes of the
    parts, at most shards x PARTS rows, give each part's first slot. Counts become rows again in
    pieces of PIECE rows, which are dealt anew.
    """
    if grown is not None and grown <= 0:
        raise ValueError("weights must be positive")
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    t = F.coalesce(F.col(text), F.lit(""))
    each = docs.select(F.col(key).alias("k"), (F.octet_length(t).cast("long") + 8).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    k, mark = F.col("k"), lambda seed: F.xxhash64("k", "size", "text_crc32", F.lit(seed))
    best = F.array_min(_bids(k, weights))
    more = F.lit(None).cast("int")
    if grown is not None:
        more = F.array_min(F.array(best, _bids(k, [grown], len(weights))[0]))["shard"]
    rows = Scratch(docs.sparkSession).put(
        each.groupBy("k", "size", "text_crc32").agg(F.count("*").alias("n"))
        .select("*", best["shard"].alias("shard"), F.pmod(mark(-1), F.lit(PARTS)).cast("int").alias("part"), more.alias("grown_shard"))
    )
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.sum("n").alias("held"))
    first = counts.select("shard", "part", F.coalesce(F.sum("held").over(before(Window.partitionBy("shard").orderBy("part"))), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy("shard", "part").orderBy(mark(-2), "k", "size", "text_crc32"))), F.lit(0))
    placed = rows.withColumn("inside", inside).join(F.broadcast(first), ["shard", "part"])  # shards x PARTS rows at most
    pieces = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))).alias("at")).repartition("k", "size", "text_crc32", "at")
    copies = F.explode(F.sequence(F.col("at"), F.least(F.col("at") + PIECE, F.col("n")) - 1)).alias("copy")
    return pieces.select("*", copies).select(
        k.alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("inside") + F.col("copy")).alias("slot"), "grown_shard"
    )
