"""Top-k searches within circles through a pyramid of cells that hold their coolest places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townmeter.functions.geo import EARTH_KM, haversine_km
from townmeter.sources.scratch import BROADCAST_LISTS, Tables, checked

#: Levels of the pyramid: level k has 2 ** k cells around the Earth, so its cells are 360 / 2 ** k degrees wide and high.
COARSEST, FINEST = 3, 13
#: A search starts at the level whose cells are at most its radius over this high.
CELLS_PER_RADIUS = 1.5
#: Levels that a round goes down.
STEP = 2
#: Entries of each cell's list from which a search's bound is taken; any `top` places within the circle are a bound.
BOUND_ENTRIES = 4
#: Lists are kept for all places (ALL), those with a hospital and a station (-1), and those of so many people; a search uses the
#: largest class that holds all that it asks for, and tests the entries itself where the class holds more.
ALL, CLASSES = -2, (0, 1000, 5000, 20000, 100000)


def _side(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _row(lat: Column, level: Column) -> Column:
    return F.floor((lat + 90.0) / _side(level)).cast("int")


def _column(lon: Column, level: Column) -> Column:
    """Counted on from -180 degrees; across the date line it goes on, and is taken round the Earth by _around."""
    return F.floor((lon + 180.0) / _side(level)).cast("int")


def _around(x: Column, level: Column) -> Column:
    return F.pmod(x, F.pow(F.lit(2.0), level).cast("int"))


def _classes(people: Column, hospital: Column, station: Column) -> Column:
    """The classes of a place; a null population is 0."""
    n = F.coalesce(people, F.lit(0))
    of = [F.lit(ALL), F.when(hospital & station, F.lit(-1)), *[F.when(n >= c, F.lit(c)) for c in CLASSES]]
    return F.array_compact(F.array(*of))


def _class_of(least: Column) -> tuple[Column, Column]:
    """The class for a search's preset, and whether it holds no other places."""
    found = F.when(least == -1, -1).when(least < 0, ALL)
    for c in reversed(CLASSES):
        found = found.when(least >= c, c)
    return found, (found == least)


def cool_lists(places: DataFrame, tables: Tables, key: str, summer: str, top: int) -> DataFrame:
    """(level, class, y, x, list): the `top` coolest places of each cell and class, coolest first, as a written table.

    Places without a summer or a point are left out. The finest cells' lists are taken first;
    a coarser cell's list is the top of those of the finest cells in it, so each level has at
    most `top` rows per cell and class. Spark cuts a cell's rows to `top` in each task before the
    exchange, so a cell with very many places is no large group.
    """
    finest = F.lit(FINEST)
    whole = places.filter(F.col(summer).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    rows = whole.select(
        _row(F.col("lat"), finest).alias("y"), _around(_column(F.col("lon"), finest), finest).alias("x"), F.explode(_classes(F.col("population"), F.col("hosp"), F.col("station"))).alias("class"),
        F.struct(F.col(summer).alias("summer"), F.col(key).alias("key"), "lat", "lon", "population").alias("place"),
    )

    def tops(df: DataFrame, *by: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(*by).orderBy("place.summer", "place.key"))
        return df.withColumn("at", at).filter(F.col("at") <= top).drop("at")

    fine = tables.put(tops(rows, "class", "y", "x"))
    up = lambda c: F.call_function("shiftright", F.col(c), F.lit(FINEST) - F.col("level")).alias(c)
    levels = fine.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(COARSEST, FINEST + 1)])))
    spread = levels.select("level", "class", up("y"), up("x"), "place")
    kept = tops(spread, "level", "class", "y", "x")
    return tables.put(kept.groupBy("level", "class", "y", "x").agg(F.sort_array(F.collect_list("place")).alias("list")))


def _level(reach: Column) -> Column:
    """The level that fits a radius."""
    return F.greatest(F.lit(COARSEST), F.least(F.lit(FINEST), F.ceil(F.log2(F.lit(CELLS_PER_RADIUS * 2 * math.pi * EARTH_KM) / F.greatest(reach, F.lit(0.001)))))).cast("int")


def _cover(asked: DataFrame) -> DataFrame:
    """asked (q, la, lo, reach, level, ...) with y, x: the level's cells that meet the box around each circle."""
    angle = F.least(F.col("reach") * 1.0001 / EARTH_KM, F.lit(math.pi))
    d_lat = F.degrees(angle)
    polar = (F.abs("la") + d_lat) >= 90.0
    d_lon = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians("la"))))) * 1.0001)
    boxed = asked.withColumn("d_lat", d_lat).withColumn("d_lon", d_lon)
    k, la, lo = F.col("level"), F.col("la"), F.col("lo")
    rows = F.sequence(_row(F.greatest(la - F.col("d_lat"), F.lit(-90.0)), k), _row(F.least(la + F.col("d_lat"), F.lit(90.0)), k))
    first = _column(lo - F.col("d_lon"), k)
    columns = F.sequence(first, F.least(_column(lo + F.col("d_lon"), k), first + F.pow(F.lit(2.0), k).cast("int") - 1))
    return boxed.withColumn("y", F.explode(rows)).withColumn("x", F.explode(columns)).withColumn("x", _around(F.col("x"), k)).drop("d_lat", "d_lon")


def _inside() -> Column:
    """Whether a cell (level, y, x) lies wholly within the circle (la, lo, reach): its farthest point is a corner, unless it spans the meridian opposite."""
    side = _side(F.col("level"))
    south, west = F.col("y") * side - 90.0, F.col("x") * side - 180.0
    far = F.greatest(*[haversine_km(F.col("la"), F.col("lo"), a, b) for a in (south, south + side) for b in (west, west + side)])
    turn = F.abs(F.pmod(west + side / 2 - F.col("lo") + 180.0, F.lit(360.0)) - 180.0)
    return (far <= F.col("reach") - 1e-6) & (turn + side / 2 < 180.0)


def _children(cells: DataFrame) -> DataFrame:
    """The parts of cells STEP levels below, or as far as the pyramid goes."""
    steps = F.least(F.lit(STEP), FINEST - F.col("level"))
    parts = F.call_function("shiftleft", F.lit(1), steps)
    part = lambda c: F.explode(F.sequence(F.col(c) * parts, F.col(c) * parts + parts - 1))
    return cells.withColumn("__y", part("y")).withColumn("x", part("x")).withColumn("y", F.col("__y")).withColumn("level", F.col("level") + steps).drop("__y")


def coolest_within(asked: DataFrame, places: DataFrame, tables: Tables, key: str, summer: str, top: int) -> DataFrame:
    """(q, rank, key, km, summer): the `top` coolest places within each circle that pass its preset, ties to the smaller key.

    asked: written (q, la, lo, reach, people), q different in each row; reach in km, inclusive,
    of any size, anywhere on the Earth, across the date line and the poles as well. A search without a
    point, a reach or a preset finds nothing.

    Some entries of each list that lie in the circle bound what can still be among the top, and
    all lists are then read down to that bound. Cells wholly inside a circle answer from their
    lists; a rim cell whose list ends before the bound is open, and its parts STEP levels below
    are looked at in the next round, down to the finest cells, whose places are read.
    So rows are searches x cells of a circle's box plus the entries under the bound, however many places
    there are.
    """
    spark = asked.sparkSession
    lists = cool_lists(places, tables, key, summer, top)
    of, exact = _class_of(F.col("people"))
    known = asked.filter(F.col("la").isNotNull() & F.col("lo").isNotNull() & (F.col("reach") >= 0) & F.col("people").isNotNull())
    known = known.withColumn("class", of).withColumn("exact", exact).withColumn("level", _level(F.col("reach")))
    levels = [r.level for r in known.select("level").distinct().collect()]  # at most as many as the pyramid has
    # Each search becomes many rows, so few searches are dealt to all tasks.
    frontier, bounds, found = _cover(known.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "q")), None, []
    of_place = lambda p: F.struct(p["summer"].alias("summer"), p["key"].alias("key"))
    while levels:
        met = frontier.join(checked(lists.filter(F.col("level").isin(levels)), BROADCAST_LISTS), ["level", "class", "y", "x"]).withColumn("sure", F.col("exact") & _inside())
        if bounds is None:
            some = _tested(met.select("q", "la", "lo", "reach", "people", F.explode(F.slice("list", 1, BOUND_ENTRIES)).alias("p"))).select("q", F.struct("summer", "key").alias("bound"))
            ranked = some.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy("bound")))
            bounds = tables.put(ranked.filter(F.col("at") == top).select("q", "bound"))
        under = lambda p: F.col("bound").isNull() | (of_place(p) <= F.col("bound"))
        last = F.get("list", F.lit(top - 1))
        is_open = ~F.col("sure") & (F.size("list") == top) & under(last)
        limited = met.join(checked(bounds), "q", "left").withColumn("open", is_open).withColumn("list", F.filter("list", under)).filter(F.size("list") > 0)
        seen = tables.put(limited.select(*known.columns, "y", "x", "list", "open"))
        found.append(_tested(seen.select("q", "la", "lo", "reach", "people", F.explode("list").alias("p"))))
        open_cells = seen.filter("open")
        levels = [r.level for r in open_cells.select("level").distinct().collect()]
        if FINEST in levels:
            ends = open_cells.filter(F.col("level") == FINEST).withColumn("last", last)
            found.append(_tested(_places_of(ends, places, bounds, key, summer)))
        levels = [min(k + STEP, FINEST) for k in levels if k < FINEST]
        frontier = _children(open_cells.filter(F.col("level") < FINEST).drop("list", "open"))
    if not found:
        return spark.createDataFrame([], f"q long, rank int, key {places.schema[key].dataType.simpleString()}, km double, summer {places.schema[summer].dataType.simpleString()}")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # A place may be in the lists of a cell and of its parts.
    best = Window.partitionBy("q").orderBy("summer", "key")
    near = rows.withColumn("at", F.dense_rank().over(best)).filter(F.col("at") <= top)
    if len(found) > 1:
        near = near.dropDuplicates(["q", "key", "lat", "lon", "summer"])
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("q", "rank", "key", "km", "summer")


def _tested(entries: DataFrame) -> DataFrame:
    """Entries (q, la, lo, reach, people, p) that lie within their circle and pass the preset; a list of class -1 holds only what -1 asks for."""
    km = haversine_km(F.col("la"), F.col("lo"), F.col("p.lat"), F.col("p.lon"))
    passes = (F.col("people") == -1) | (F.coalesce(F.col("p.population"), F.lit(0)) >= F.col("people"))
    return entries.select("q", "p.key", "p.summer", "p.lat", "p.lon", "reach", km.alias("km"), passes.alias("passes")).filter(F.col("passes") & (F.col("km") <= F.col("reach"))).select("q", "key", "summer", "lat", "lon", "km")


def _places_of(ends: DataFrame, places: DataFrame, bounds: DataFrame, key: str, summer: str) -> DataFrame:
    """The places of open finest cells that come after the cell's list and under the search's bound."""
    k = F.lit(FINEST)
    rows = places.filter(F.col(summer).isNotNull()).select(
        _row(F.col("lat"), k).alias("y"), _around(_column(F.col("lon"), k), k).alias("x"), F.explode(_classes(F.col("population"), F.col("hosp"), F.col("station"))).alias("class"),
        F.struct(F.col(summer).alias("summer"), F.col(key).alias("key"), "lat", "lon", "population").alias("p"),
    )
    own = F.struct("p.summer", "p.key")
    after = own > F.struct("last.summer", "last.key")
    met = ends.join(rows, ["class", "y", "x"]).filter(after).join(bounds, "q", "left").filter(F.col("bound").isNull() | (own <= F.col("bound")))
    return met.select("q", "la", "lo", "reach", "people", "p")
