"""Nearest neighbours in the space of indicators, by branch and bound over a tree of grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townmeter.sources.scratch import BROADCAST_LISTS, Tables, checked

#: The indicators' extent is halved so many times at most; a round looks STEP halvings further.
DEPTH, STEP = 16, 2
#: Points of a cell that is not divided.
LEAF = 64
#: Decimals to which distances are compared, so that ties are ties whatever the order of sums; bounds have as much slack.
DECIMALS, SLACK = 9, 1e-8


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _cell(at: Column, low: Column, high: Column, level: Column) -> Column:
    """The cell of a point at a level: per indicator the number of the part of the extent that it lies in."""
    parts = F.pow(F.lit(2.0), level)
    one = lambda v, i: F.floor((v - low[i]) / F.when(high[i] > low[i], high[i] - low[i]).otherwise(1.0) * parts)
    return F.transform(at, lambda v, i: F.least(one(v, i), parts - 1).cast("int"))


def _near(at: Column, low: Column, high: Column) -> Column:
    """Least square distance from a point to a box."""
    gap = F.zip_with(F.zip_with(at, low, lambda x, a: F.greatest(a - x, F.lit(0.0))), F.zip_with(at, high, lambda x, b: F.greatest(x - b, F.lit(0.0))), lambda p, q: F.greatest(p, q))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def _far(at: Column, low: Column, high: Column) -> Column:
    """Largest square distance from a point to a box."""
    gap = F.zip_with(F.zip_with(at, low, lambda x, a: F.abs(x - a)), F.zip_with(at, high, lambda x, b: F.abs(x - b)), lambda p, q: F.greatest(p, q))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def climate_analogs(projected: DataFrame, present: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, analog, distance): for each projected place the nearest other place of the present, whatever its distance, ties to the smaller key.

    Distances are Euclidean over the indicators, each divided by its standard deviation over the
    present places (by 1 if that is 0), and compared to DECIMALS decimals. Rows with a null
    indicator take no part. So every projected place has an analog as soon as the present has another one.

    Present places of one climate are one point with its two smallest keys. Cells of the tree
    hold their points' box and number; those of over LEAF points are divided. A round goes STEP
    levels down: the boxes' farthest corners bound a row's distance, and only cells nearer than
    the bound go on. A row thus meets a few cells on each level, and the points of a few leaves,
    however dense the climates lie.
    """
    spark = projected.sparkSession
    tables = Tables(spark, "analogs")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = lambda df: df.dropna(subset=list(columns)).select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f"c{i}" for i in range(len(columns))]
    now = numbers(present)
    spread = now.agg(F.array(*[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0) for c in names]).alias("spread")).first().spread
    if spread is None or now.limit(1).count() == 0:
        return spark.createDataFrame([], f"{key} {projected.schema[key].dataType.simpleString()}, analog {present.schema[key].dataType.simpleString()}, distance double")
    scaled = F.array(*[F.col(c) / F.lit(s) for c, s in zip(names, spread)])
    points = tables.put(now.select("key", scaled.alias("at")).groupBy("at").agg(F.min("key").alias("first"), F.array_sort(F.collect_set("key")).alias("keys")).select("at", "first", F.get("keys", F.lit(1)).alias("second")))
    each = range(len(columns))
    ends = points.agg(F.array(*[F.min(F.col("at")[i]) for i in each]).alias("low"), F.array(*[F.max(F.col("at")[i]) for i in each]).alias("high")).first()
    low, high = (F.array(*map(F.lit, e)) for e in (ends.low, ends.high))

    # Boxes of all levels: a point's cells from the root down.
    placed = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(0, DEPTH + 1, STEP)]))).withColumn("cell", _cell(F.col("at"), low, high, F.col("level")))
    keys = F.sum(F.when(F.col("second").isNull(), 1).otherwise(2))
    boxes = tables.put(placed.groupBy("level", "cell").agg(
        F.count("*").alias("held"), keys.alias("keys"), F.min("first").alias("only"),
        F.array(*[F.min(F.col("at")[i]) for i in each]).alias("b_low"), F.array(*[F.max(F.col("at")[i]) for i in each]).alias("b_high"),
    ).withColumn("parent", F.transform("cell", lambda c: F.call_function("shiftright", c, F.lit(STEP)))))

    rows = numbers(projected).select("key", scaled.alias("at")).repartition(tasks, "key")
    rows = tables.put(rows.withColumn("q", F.monotonically_increasing_id()))
    open_cells, leaves = rows.select("q", "key", "at", F.array(*[F.lit(0)] * len(columns)).alias("parent"), F.lit(float("inf")).alias("bound")), []
    for level in range(0, DEPTH + 1, STEP):
        met = open_cells.join(checked(boxes.filter(F.col("level") == level).drop("level"), BROADCAST_LISTS), "parent")
        other = (F.col("keys") > 1) | (F.col("only") != F.col("key"))
        seen = tables.put(met.select("q", "key", "at", "cell", "held", "bound", _near("at", "b_low", "b_high").alias("near"), F.when(other, _far("at", "b_low", "b_high")).alias("far")))
        bound = seen.groupBy("q").agg(F.least(F.min("bound"), F.min("far")).alias("tight"))
        left = tables.put(seen.join(bound, "q").filter(F.col("near") <= F.col("tight") + SLACK).select("q", "key", "at", "cell", "held", F.col("tight").alias("bound"), "near"))
        ended = (F.col("held") <= LEAF) | F.lit(level == DEPTH)
        leaves.append(left.filter(ended).select("q", "key", "at", F.lit(level).alias("level"), "cell", "near", "bound"))
        open_cells = left.filter(~ended).select("q", "key", "at", F.col("cell").alias("parent"), "bound")
        if not open_cells.limit(1).count():
            break
    met = leaves[0]
    for more in leaves[1:]:
        met = met.unionByName(more)
    best = met.groupBy("q").agg(F.min("bound").alias("last"))
    met = met.join(best, "q").filter(F.col("near") <= F.col("last") + SLACK).drop("near", "bound", "last")
    undivided = boxes.filter((F.col("held") <= LEAF) | (F.col("level") == DEPTH)).select("level", "cell")
    there = placed.select("level", "cell", F.col("at").alias("there"), "first", "second").join(undivided, ["level", "cell"], "left_semi")
    analog = F.when(F.col("first") != F.col("key"), F.col("first")).otherwise(F.col("second"))
    found = met.join(there, ["level", "cell"]).select("q", "key", analog.alias("analog"), F.round(F.sqrt(_square(F.col("at"), F.col("there"))), DECIMALS).alias("distance")).filter("analog is not null")
    return found.groupBy("q").agg(F.first("key").alias("key"), F.min(F.struct("distance", "analog")).alias("best")).select(F.col("key").alias(key), "best.analog", "best.distance")
