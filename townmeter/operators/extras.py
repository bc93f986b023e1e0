"""Uncertainty, sensitivity, trade-offs and overviews of the ranked places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townmeter.operators.normalise import positions, with_positions
from townmeter.sources.scratch import Tables


#: Cells of the grid in which points are compared.
CELLS = 1024


def _draws(years: Sequence, replicates: int) -> np.ndarray:
    """How often each replicate (row) draws each year (column): as many draws as there are years, by a hash of replicate and slot."""
    times = np.zeros((replicates, len(years)))
    for rep in range(replicates):
        for slot in range(len(years)):
            times[rep, int(hashlib.md5(f"{rep}:{slot}".encode()).hexdigest()[:8], 16) % len(years)] += 1
    return times


def bootstrap_bands(yearly: DataFrame, key: str, year: str, value: str, replicates: int = 200, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(key, mean, low, high): an interval of the mean over years that are drawn with replacement.

    A replicate draws as many years as there are, by a hash of replicate and slot; all places
    share its draw, as anomalies go together across space. Means are taken over the years a place
    has; a replicate that draws none of them is left out, and a place without a value has no interval.

    The draws of all replicates are one small matrix of replicates by years. A place's years
    become one row, and a product with the matrix gives its replicates' means, so the exchange has
    a row per place and task, however many replicates there are.
    """
    years = sorted(r[0] for r in yearly.select(year).distinct().collect())  # a row per year
    times, place = _draws(years, replicates), {y: i for i, y in enumerate(years)}
    known = yearly.filter(F.col(value).isNotNull()).groupBy(key).agg(F.avg(value).alias("mean"), F.collect_list(F.struct(F.col(year).alias("y"), F.col(value).cast("double").alias("v"))).alias("own"))

    @F.pandas_udf("low double, high double")
    def interval(own: pd.Series) -> pd.DataFrame:
        ends = []
        for rows in own:
            at, v = [place[r["y"]] for r in rows], np.array([r["v"] for r in rows])
            drawn = times[:, at]
            held = drawn.sum(1)
            means = (drawn @ v)[held > 0] / held[held > 0]
            ends.append(np.quantile(means, [low, high]) if len(means) else (None, None))
        return pd.DataFrame(ends, columns=["low", "high"])

    once = interval.asNondeterministic()  # else the filter would run it again
    bands = known.select(key, "mean", once("own").alias("b")).select(key, "mean", "b.low", "b.high")
    return bands.filter("low is not null")


def weight_sensitivity(burdens: DataFrame, key: str, columns: Sequence[str], weights: Sequence[float], shift: float = 0.2) -> DataFrame:
    """(key, rank, best, worst, flips): a place's rank with the given weights, and over weights with one of them shifted either way.

    Places that miss a burden have no rank. Scores of all sets of weights are ranked together, by
    one exchange by range of their different values (`normalise.positions`), so no task sorts the places.
    """
    sets = [list(weights)] + [[w * (1 + s * (j == i)) for j, w in enumerate(weights)] for i in range(len(weights)) for s in (-shift, shift)]
    tables = Tables(burdens.sparkSession, "sensitivity")
    whole = tables.put(burdens.dropna(subset=list(columns)).select(key, *columns))
    score = lambda ws: F.round(sum((F.col(c).cast("double") * F.lit(w / sum(ws)) for c, w in zip(columns, ws, strict=True)), F.lit(0.0)), 6)
    rows = whole.select(key, F.posexplode(F.array(*[score(ws) for ws in sets])).alias("variant", "score"))
    ranked = with_positions(rows, positions(rows, tables, "variant", "score"), "variant", "score").withColumn("rank", F.col("__below") + 1)
    return ranked.groupBy(key).agg(
        F.max(F.when(F.col("variant") == 0, F.col("rank"))).alias("rank"), F.min("rank").alias("best"), F.max("rank").alias("worst")
    ).withColumn("flips", F.col("best") != F.col("worst"))


def _skyline(points: np.ndarray) -> np.ndarray:
    """Mask of the rows that no other row is at most as large as in all columns and smaller in one; equal rows stay."""
    order = np.lexsort(points.T[::-1])
    front, held = np.empty_like(points), 0
    keep = np.zeros(len(points), bool)
    for i in order:
        p, f = points[i], front[:held]
        if not ((f <= p).all(1) & (f < p).any(1)).any():
            front[held] = p
            held += 1
            keep[i] = True
    return keep


def _beaten(cells: np.ndarray) -> np.ndarray:
    """Mask of the cells that another one lies under in every column: each of its points is beaten by any point there."""
    return np.array([(cells < c).all(1).any() for c in cells])


def _rivals(cells: np.ndarray, codes: Sequence[int]) -> list[tuple[int, int]]:
    """(a, b) of different cells where a lies nowhere over b, so that points of a may beat points of b."""
    return [(codes[i], codes[j]) for j, c in enumerate(cells) for i in np.flatnonzero((cells <= c).all(1)) if i != j]


def pareto_front(places: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, columns) of the places that none beats: smaller is better; rows with a null take no part.

    Different points are compared, so that places tied at a good one are one row, and joined with
    their places in the end. The indicators' extent is a grid of CELLS cells at most. A cell that
    another lies under in every column goes before any of its points is compared. In each other
    cell, tasks reduce their own points first, then what is left of the cell. Last, each pair of
    cells of which one may beat points of the other is a group, so that no task meets more than two
    cells' fronts; points that some pair beats go.
    """
    names, n = list(columns), len(columns)
    tables = Tables(places.sparkSession, "pareto")
    spark = places.sparkSession
    whole = tables.put(places.dropna(subset=names).select(key, *[F.col(c).cast("double").alias(c) for c in names]))
    ends = whole.agg(*[f(c).alias(f"{w}{i}") for i, c in enumerate(names) for w, f in (("low", F.min), ("high", F.max))]).first()
    if ends.low0 is None:
        return whole
    side = max(2, int(CELLS ** (1 / n) + 1e-9))
    at = lambda c, low, high: F.least(F.floor((F.col(c) - low) / (high - low) * side), F.lit(side - 1)) if high > low else F.lit(0)
    code = sum((at(c, ends[f"low{i}"], ends[f"high{i}"]).cast("long") * side**i for i, c in enumerate(names)), F.lit(0).cast("long"))
    points = tables.put(whole.select(*names).distinct().withColumn("__cell", code))
    codes = sorted(r[0] for r in points.select("__cell").distinct().collect())  # at most CELLS
    cells = np.array([[c // side**i % side for i in range(n)] for c in codes])
    alive = ~_beaten(cells)
    cells, codes = cells[alive], [c for c, ok in zip(codes, alive) if ok]

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, pd.DataFrame] = {}
        for f in frames:
            for cell, own in f.groupby("__cell"):
                both = pd.concat([held[cell], own], ignore_index=True) if cell in held else own
                held[cell] = both[_skyline(both[names].to_numpy())]
        yield from held.values()

    left = points.join(F.broadcast(spark.createDataFrame([(c,) for c in codes], "__cell long")), "__cell")
    local = left.mapInPandas(reduce, left.schema)
    fronts = tables.put(local.groupBy("__cell").applyInPandas(lambda f: f[_skyline(f[names].to_numpy())], left.schema))
    pairs = _rivals(cells, codes)
    if not pairs:
        return whole.join(fronts.drop("__cell"), names, "left_semi").select(key, *names)
    rivals = F.broadcast(spark.createDataFrame(pairs, "__a long, __b long"))  # at most the square of CELLS

    def beaten(f: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = f[f["__ours"]][names], f[~f["__ours"]][names].to_numpy()
        gone = [bool(((theirs <= p).all(1) & (theirs < p).any(1)).any()) for p in ours.to_numpy()]
        return ours[gone]

    sides = fronts.join(rivals, F.col("__cell") == F.col("__b")).withColumn("__ours", F.lit(True)).unionByName(fronts.join(rivals, F.col("__cell") == F.col("__a")).withColumn("__ours", F.lit(False)))
    schema = ", ".join(f"`{c}` double" for c in names)
    dropped = sides.groupBy("__a", "__b").applyInPandas(beaten, schema).distinct()
    front = fronts.drop("__cell").join(dropped, names, "left_anti")
    return whole.join(front, names, "left_semi").select(key, *names)


def correlations(places: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) of every pair of indicators, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = places.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def cell_overview(places: DataFrame, degrees: float, columns: Sequence[str]) -> DataFrame:
    """(cell_y, cell_x, places, means) for low zooms."""
    y, x = F.floor(F.col("lat") / F.lit(degrees)).cast("long"), F.floor(F.col("lon") / F.lit(degrees)).cast("long")
    return places.groupBy(y.alias("cell_y"), x.alias("cell_x")).agg(F.count("*").alias("places"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def overview_pyramid(places: DataFrame, degrees: float, levels: int, columns: Sequence[str]) -> DataFrame:
    """(level, cell_y, cell_x, places, means) at every zoom: cells of `degrees` at level 0, twice as wide at each level above; a mean is over the places with a value, null without one.

    The places are read once, into sums and counts of the finest cells that have any; each level
    is the sum of the four cells below, so what grows with the places is the first aggregation alone.
    """
    y, x = F.floor(F.col("lat") / F.lit(degrees)).cast("long"), F.floor(F.col("lon") / F.lit(degrees)).cast("long")
    parts = lambda c, like: [F.sum(c).cast("double").alias(f"sum_{like}"), F.count(c).alias(f"n_{like}")]
    tables = Tables(places.sparkSession, "overview")
    whole = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    level = tables.put(whole.groupBy(y.alias("cell_y"), x.alias("cell_x")).agg(F.count("*").alias("places"), *[p for c in columns for p in parts(c, c)]).withColumn("level", F.lit(0)))
    every = level
    half = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    for k in range(1, levels):
        level = tables.put(level.groupBy(half("cell_y"), half("cell_x")).agg(F.sum("places").alias("places"), *[F.sum(f"{w}_{c}").alias(f"{w}_{c}") for c in columns for w in ("sum", "n")]).withColumn("level", F.lit(k)))
        every = every.unionByName(level)
    return every.select("level", "cell_y", "cell_x", "places", *[F.when(F.col(f"n_{c}") > 0, F.col(f"sum_{c}") / F.col(f"n_{c}")).alias(f"mean_{c}") for c in columns])


def department_overview(places: DataFrame, dept: str, columns: Sequence[str]) -> DataFrame:
    """(dept, places, means) for low zooms."""
    return places.groupBy(dept).agg(F.count("*").alias("places"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def warming_overlay(model: DataFrame, key: str, year: str, value: str, baseline: tuple[int, int], future: tuple[int, int], observed: DataFrame) -> DataFrame:
    """(key, delta, projected): a model's change between two windows of 20 years or more, added to the observed baseline of `observed` (key, normal)."""
    for a, b in (baseline, future):
        if b - a + 1 < 20:
            raise ValueError("windows hold 20 years at least")
    in_ = lambda w: F.avg(F.when(F.col(year).between(*w), F.col(value)))
    change = model.groupBy(key).agg((in_(future) - in_(baseline)).alias("delta"))
    return change.join(observed, key).select(key, "delta", (F.col("normal") + F.col("delta")).alias("projected"))


def warming_crossings(yearly: DataFrame, model: str, year: str, value: str, levels: Sequence[float] = (2.0, 2.7, 4.0), baseline: tuple[int, int] = (1991, 2020), span: int = 20) -> DataFrame:
    """(model, level, first_year, last_year, warming): the first window of `span` years whose mean lies a level over the model's own baseline.

    A model's years are the means over its places. Windows have a value in each of their years;
    a model without a baseline of `span` years, or one that never gets so warm, has no row.
    """
    if span < 20 or baseline[1] - baseline[0] + 1 < 20:
        raise ValueError("windows hold 20 years at least")
    means = yearly.groupBy(model, year).agg(F.avg(value).alias("v")).filter("v is not null")
    ahead = Window.partitionBy(model).orderBy(year).rangeBetween(0, span - 1)
    in_base = F.when(F.col(year).between(*baseline), F.col("v"))
    whole = Window.partitionBy(model)
    moving = means.select(model, year, F.avg("v").over(ahead).alias("mean"), F.count("v").over(ahead).alias("held"), F.avg(in_base).over(whole).alias("base"), F.count(in_base).over(whole).alias("base_years"))
    warm = moving.filter((F.col("held") == span) & (F.col("base_years") >= 20)).select(model, year, (F.col("mean") - F.col("base")).alias("warming"))
    reached = warm.select("*", F.explode(F.filter(F.array(*[F.lit(float(x)) for x in levels]), lambda x: F.col("warming") >= x)).alias("level"))
    first = reached.groupBy(model, "level").agg(F.min(F.struct(year, "warming")).alias("first"))
    return first.select(model, "level", F.col("first")[year].alias("first_year"), (F.col("first")[year] + span - 1).alias("last_year"), F.col("first.warming").alias("warming"))


def warming_levels(yearly: DataFrame, model: str, place: str, year: str, value: str, levels: Sequence[float] = (2.0, 2.7, 4.0), baseline: tuple[int, int] = (1991, 2020), span: int = 20) -> DataFrame:
    """(place, level, models, delta, least, most): the places' changes at each warming level, as the mean, least and most of the models that reach it.

    A model's change at a place is its mean over the window in which the model first reaches the
    level (`warming_crossings`) less its mean over the baseline there. Levels that no model reaches
    have no row, nor have places without a value in the window or the baseline.

    A model's windows are one array, so the yearly rows are read once more, stay as many, and go
    to one aggregation by model and place.
    """
    crossed = warming_crossings(yearly, model, year, value, levels, baseline, span).groupBy(F.col(model).alias("__m")).agg(F.collect_list(F.struct("level", "first_year", "last_year")).alias("windows"))
    rows = yearly.join(crossed, F.col(model) == F.col("__m"))
    window_of = lambda level: F.try_element_at(F.filter("windows", lambda w: w["level"] == level), F.lit(1))
    windows = [window_of(float(x)) for x in levels]
    means = [F.avg(F.when(F.col(year).between(w["first_year"], w["last_year"]), F.col(value))).alias(f"m{i}") for i, w in enumerate(windows)]
    by_model = rows.groupBy(model, place).agg(F.avg(F.when(F.col(year).between(*baseline), F.col(value))).alias("base"), *means)
    deltas = F.array(*[F.struct(F.lit(float(x)).alias("level"), (F.col(f"m{i}") - F.col("base")).alias("delta")) for i, x in enumerate(levels)])
    spread = by_model.select(place, F.explode(deltas).alias("d")).filter("d.delta is not null")
    return spread.groupBy(place, F.col("d.level").alias("level")).agg(F.count("*").alias("models"), F.avg("d.delta").alias("delta"), F.min("d.delta").alias("least"), F.max("d.delta").alias("most"))
