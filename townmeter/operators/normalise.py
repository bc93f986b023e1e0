"""Percentile ranks, quantiles and winsorised values over whole populations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townmeter.sources.scratch import BROADCAST_ROWS, Tables, checked

#: A value that more rows than one in HOT of its group have is joined as one of a small table.
HOT = 1000
#: Bits of a value's order that one pass over a histogram settles.
BITS = 16


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, value, ties) in order to the same with before, the sum of the ties of the group's rows before in this task."""
    group, total = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, ties = batch.column(0).to_pylist(), batch.column(2).to_numpy()
        before = np.empty(len(ties), np.int64)
        starts, at = [i for i, g in enumerate(groups) if g != (groups[i - 1] if i else group)], 0
        for start in [*starts, len(groups)]:
            if start > at:
                before[at:start] = total + np.cumsum(ties[at:start]) - ties[at:start]
                total += int(ties[at:start].sum())
            if start < len(groups):
                total = 0
            at = start
        group = groups[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "before"])


def positions(long: DataFrame, tables: Tables, group: str, value: str) -> DataFrame:
    """A written table (__g, __v, __ties, __below, __n) of a population's different values: group, value, rows with the value, rows of the group under it, rows of the group.

    Null values take no part; a null group is one. Equal values are counted before anything is
    sorted. All groups together are then dealt by ranges of (group, value), once; a task adds
    up the ties of its own range, and the ranges' sums, at most ranges + groups rows, give each
    range's start. So no task sorts a group.
    """
    spark = long.sparkSession
    counts = long.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("ties"))
    order = [F.col("g").asc_nulls_first(), F.col("v")]
    counts = tables.put(counts)
    kind = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    ranged = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    run = ranged.mapInArrow(_running, f"g {kind['g']}, v {kind['v']}, ties long, before long").withColumn("part", F.spark_partition_id())
    run = tables.put(run)
    sums = run.groupBy("part", "g").agg(F.sum("ties").alias("held"))
    own = Window.partitionBy("g")
    starts = tables.put(sums.select(
        F.col("part").alias("s_part"), F.col("g").alias("s_g"), F.coalesce(F.sum("held").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("held").over(own).alias("n")
    ))
    here = (F.col("part") == F.col("s_part")) & F.col("g").eqNullSafe(F.col("s_g"))
    return tables.put(run.join(checked(starts), here).select(
        F.col("g").alias("__g"), F.col("v").alias("__v"), F.col("ties").alias("__ties"), (F.col("start") + F.col("before")).alias("__below"), F.col("n").alias("__n")
    ))


def with_positions(long: DataFrame, found: DataFrame, group: str, value: str) -> DataFrame:
    """long with __ties, __below and __n of `positions`, null where the value is null.

    One join: with all values if they are few; else values that very many rows share are joined
    as a small table first, so that they aren't dealt by their value.
    """
    meets = lambda side: F.col(group).eqNullSafe(side["__g"]) & (F.col(value) == side["__v"])
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return long.join(F.broadcast(found), meets(found), "left").drop("__g", "__v")
    # Fewer than HOT values of each group.
    hot = found.filter(F.col("__ties") * HOT > F.col("__n"))
    split = long.join(F.broadcast(hot), meets(hot), "left")
    done = split.filter(F.col("__ties").isNotNull() | F.col(value).isNull()).drop("__g", "__v")
    rest = split.filter(F.col("__ties").isNull() & F.col(value).isNotNull()).select(*long.columns)
    cold = found.filter(F.col("__ties") * HOT <= F.col("__n"))
    return done.unionByName(rest.join(cold, meets(cold), "left").drop("__g", "__v"))


def percent(below: Column, ties: Column, n: Column) -> Column:
    """Percentile rank of a value: 0 to 100, ties in the middle of theirs; a single value gets 50."""
    return F.when(n <= 1, F.lit(50.0)).when(n.isNotNull(), (below + (ties - 1) / 2) / (n - 1) * 100)


def percentile_ranks(long: DataFrame, group: str = "indicator", value: str = "value") -> DataFrame:
    """long with pct, 0 to 100: (below + (ties - 1) / 2) / (n - 1) * 100 among the group's non-null values.

    Null stays null, and a single value gets 50. The ranks are exact, and come from one exchange
    by range for all groups (`positions`).
    """
    found = positions(long, Tables(long.sparkSession, "ranks"), group, value)
    return with_positions(long, found, group, value).select(*long.columns, percent(F.col("__below"), F.col("__ties"), F.col("__n")).alias("pct"))


def rank_columns(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per key with the percentile rank of each column, as <column>_pct."""
    pairs = F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).cast("double").alias("value")) for c in columns])
    # The rows are read for the counts and for the join, and may be dear.
    rows = Tables(df.sparkSession, "ranks").put(df.select(key, *columns))
    long = rows.select(key, F.explode(pairs).alias("x")).select(key, "x.*")
    return percentile_ranks(long).groupBy(key).pivot("indicator", list(columns)).agg(F.first("pct")).withColumnsRenamed({c: f"{c}_pct" for c in columns})


def order_bits(value: Column) -> Column:
    """A long that orders like the double: its bits, those of negative numbers turned."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF)))


def quantiles(df: DataFrame, value: str, at: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation at p * (n - 1), one column q<i> each, by group; null where a group has no value.

    The ranks that the quantiles lie between are selected from histograms over the bits of the
    values' order, BITS of them in each of four passes: a pass counts the cells under the prefixes
    that are still in question, per task before the exchange, and settles the next bits of each
    rank. So a task holds the 2 ** BITS cells of a prefix at most, whatever the number of values.
    Groups of null are groups of their own; NaN is larger than any number.
    """
    if not all(0 <= p <= 1 for p in at):
        raise ValueError("quantiles lie in [0, 1]")
    spark = df.sparkSession
    tables = Tables(spark, "quantiles")
    name = F.to_json(F.struct(*[F.col(c) for c in group]), {"ignoreNullFields": "false"}) if group else F.lit("")
    rows = tables.put(df.select(name.alias("__g"), *group, F.col(value).cast("double").alias("__v")))
    keyed = tables.put(rows.filter("__v is not null").select(F.col("__g").alias("g"), F.col("__v").alias("v"), order_bits(F.col("__v")).alias("bits")))
    sizes = keyed.groupBy("g").agg(F.count("*").alias("n"))
    ends = F.array(*[F.struct(F.lit(i).alias("i"), (p * (F.col("n") - 1)).alias("pos")) for i, p in enumerate(map(float, at))])
    wanted = tables.put(sizes.select("g", F.explode(ends).alias("e")).select("g", "e.i", "e.pos", F.explode(F.array_distinct(F.array(F.floor("e.pos"), F.ceil("e.pos")))).alias("rank")))
    # rank: place among the rows of the prefix, from 0
    targets = wanted.select("g", "rank", F.lit(0).cast("long").alias("prefix"), F.col("rank").alias("left")).distinct()
    for shift in range(64 - BITS, -1, -BITS):
        cell = F.call_function("shiftright", F.col("bits"), F.lit(shift))
        inside = keyed.withColumn("prefix", F.lit(0).cast("long"))
        if shift + BITS < 64:
            above = F.call_function("shiftright", F.col("bits"), F.lit(shift + BITS))
            inside = keyed.withColumn("prefix", above).join(targets.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
        counts = inside.groupBy("g", "prefix", cell.alias("cell")).agg(F.count("*").alias("held"), F.min("v").alias("v"))
        upto = counts.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy("g", "prefix").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        met = targets.select("g", "rank", "prefix", "left").join(upto, ["g", "prefix"]).filter((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("held")))
        targets = tables.put(met.select("g", "rank", F.col("cell").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), "v"))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    share = F.max("pos") - F.floor(F.max("pos"))
    between = wanted.join(targets.select("g", "rank", "v"), ["g", "rank"]).groupBy("g", "i").agg(F.when(F.count("*") == 1, low).otherwise((1 - share) * low + share * high).alias("q"))
    wide = between.groupBy(F.col("g").alias("__g")).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(at))])
    groups = rows.groupBy("__g", *group).agg(F.lit(1).alias("__one")) if group else spark.range(1).select(F.lit("").alias("__g"))
    return groups.join(wide, "__g", "left").select(*group, *[f"q{i}" for i in range(len(at))])


def winsorise(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, into: str = "winsorised") -> DataFrame:
    """Values clamped to two quantiles of the column, which are one row."""
    ends = quantiles(df, value, (low, high))
    return df.crossJoin(F.broadcast(ends)).withColumn(into, F.when(F.col(value).isNotNull(), F.least("q1", F.greatest("q0", F.col(value).cast("double"))))).drop("q0", "q1")
