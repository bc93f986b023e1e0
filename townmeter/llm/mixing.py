"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townmeter.llm.common import Scratch, checked, uniform, words

#: Ranges of sampling keys in a source; only the range in which the budget ends is sorted row by row.
RANGES = 1024


def quality_weight(w: Column) -> Column:
    """Weight of a document from its words: the share of different words, 0.05 to 1; 1 without words."""
    return F.when(F.size(w) == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.05), F.size(F.array_distinct(w)).cast("double") / F.size(w).cast("double"))
    )


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Words to take of each source; sizes has one row per source: source, source_size, wbar.

    Sources by code point, null last, get the weights in turn and share `share` of all sizes by
    them; a target stops at `most` times its source's size and the excess is dealt again by
    weight. That is a water level: sources in the order of cap / weight are full while the level
    of those that remain reaches them. One row per source passes the window.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sizes.withColumn("weight", F.get(given, F.pmod(turn, F.lit(len(weights)))))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here))
        .withColumn("open", F.when(F.col("full_at") > F.col("level"), F.col("level")))
        # The first source that the level doesn't fill fixes the level for all after it.
        .withColumn("fixed", F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .select("source", "source_size", "wbar", F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.col("fixed") * F.col("weight")).alias("target"))
    )


def _drawn(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows of id, source, size, weight with their source's plan, sampling key and range of keys."""
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("draw", -F.log(uniform(F.col("id"))) / F.col("weight"))
        .withColumn("range", F.least(F.lit(RANGES - 1), F.floor(F.lit(RANGES) * (1 - F.exp(-F.col("draw") * F.col("wbar"))))).cast("int"))
    )


def plan_mix(rows: DataFrame, weights: Sequence[float], share: float, most: float, scratch: Scratch) -> DataFrame:
    """One row per source: of, source_size, target, wbar, epochs, and where its sampling ends: cut_range and last.

    rows: id, source, size, weight. The sizes of the ranges of sampling keys, a bounded number per
    source, tell in which range the budget ends; only that range's rows are sorted.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("weight").alias("wbar"))
    dealt = scratch.put(targets(sizes, weights, share, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    dealt = dealt.select(F.col("source").alias("of"), "source_size", "target", "wbar", whole.alias("epochs"), (F.col("target") - whole * F.col("source_size")).alias("rest"))
    keyed = _drawn(rows, checked(dealt))
    before = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keyed.groupBy("of", "range", "rest").agg(F.sum("size").alias("held")).withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
    cut = scratch.put(ranges.filter("start <= rest and rest < start + held").select(F.col("of").alias("cut_of"), F.col("range").alias("cut_range"), "start"))
    ordered = Window.partitionBy("of").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        keyed.join(checked(cut), F.col("of").eqNullSafe(F.col("cut_of")) & (F.col("range") == F.col("cut_range")))
        .withColumn("end", F.col("start") + F.sum("size").over(ordered)).filter(F.col("end") - F.col("size") / 2 <= F.col("rest"))
        .groupBy(F.col("of").alias("last_of")).agg(F.max(F.struct("draw", "id", "size")).alias("last"))
    )
    return scratch.put(
        dealt.join(cut, F.col("of").eqNullSafe(F.col("cut_of")), "left").join(last, F.col("of").eqNullSafe(F.col("last_of")), "left")
        .select("of", "source_size", "target", "wbar", "epochs", "cut_range", "last")
    )


def _times() -> Column:
    """How often a drawn row is taken."""
    here = (F.col("range") == F.col("cut_range")) & (F.struct("draw", "id", "size") <= F.col("last"))
    return F.col("epochs") + F.when((F.col("range") < F.col("cut_range")) | here, 1).otherwise(0)


def _sized(docs: DataFrame, key: str, text: str, source: str, *also: Column) -> DataFrame:
    w = words(F.col(text))
    return docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), w.alias("w"), *also).select(
        "id", "source", F.size("w").cast("long").alias("size"), quality_weight(F.col("w")).alias("weight"), *[F.col("__row")] * bool(also)
    )


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: key, size, source_size, target, taken, times.

    size: words of the text, 0 for a null text. A source whose target is e.g. 1.4 times its size
    gives every document once (complete epochs come first), then documents in the order of
    -ln(u) / quality weight until their sizes reach the remaining 0.4; the document at the end is
    taken if over half of it fits. u depends on the key alone, so reruns agree; documents with
    equal keys are ordered by size, rows equal in both go together. Null sources are one source.
    An empty table gives an empty one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put(_sized(docs, key, text, source))
    plan = plan_mix(rows, weights, share, most, scratch)
    return _drawn(rows, checked(plan)).withColumn("times", _times()).select(F.col("id").alias(key), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns. Texts are not shuffled."""
    scratch = Scratch(docs.sparkSession)
    plan = plan_mix(scratch.put(_sized(docs, key, text, source)), weights, share, most, scratch)
    whole = _sized(docs, key, text, source, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = _drawn(whole, checked(plan)).withColumn("times", _times()).filter("times > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("__row.*")
