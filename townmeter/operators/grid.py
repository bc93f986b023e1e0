"""Hourly grids to local days, and grids to places."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townmeter.functions.climate import LAPSE_TMAX, LAPSE_TMIN, celsius, grid_fraction, grid_index, lapse_adjust, nan_to_null, nearest_index


#: Nodes of a block's side.
BLOCK = 32


class Axes(NamedTuple):
    """First node, step and number of nodes of a grid's axes; steps may be negative."""

    lat0: float
    dlat: float
    n_lat: int
    lon0: float
    dlon: float
    n_lon: int


def hourly_to_daily(hours: DataFrame, node: str = "node", ts: str = "ts", value: str = "t2m", zone: str = "Europe/Paris", year: int | None = None) -> DataFrame:
    """(node, day, tmax, tmin) over local calendar days of 23 to 25 hours; ts is UTC.

    NaN is missing, a day without a value has nulls. With a year, only its local days are kept:
    the last hours of the December before belong to it, its own last hours may not. Maxima and
    minima are taken per task before the one shuffle, by node and day.
    """
    rows = hours
    if year is not None:
        rows = rows.filter(F.col(ts).between(F.lit(f"{year - 1}-12-31 00:00:00").cast("timestamp"), F.lit(f"{year + 1}-01-01 23:59:59").cast("timestamp")))
    day = F.to_date(F.from_utc_timestamp(F.col(ts), zone))
    rows = rows.select(F.col(node), day.alias("day"), nan_to_null(F.col(value)).alias("v"))
    if year is not None:
        rows = rows.filter(F.year("day") == year)
    return rows.groupBy(node, "day").agg(F.max("v").alias("tmax"), F.min("v").alias("tmin"))


def complete_years(hours: DataFrame, ts: str = "ts", months: int = 12) -> DataFrame:
    """(year) of the years of which every month is there."""
    return hours.select(F.year(ts).alias("year"), F.month(ts).alias("month")).distinct().groupBy("year").agg(F.count("*").alias("months")).filter(F.col("months") == months).select("year")


def corner_weights(places: DataFrame, nodes: DataFrame, axes: Axes, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(key, node, w, elev, coastal): up to four land corners of each place with weights that sum to 1.

    nodes: node = lat index * n_lon + lon index, is_land, elev. Sea corners weigh nothing and
    the others are scaled up; a place with four sea corners is left out. coastal: a corner is sea.
    """
    i, fi = grid_index(F.col(lat), axes.lat0, axes.dlat, axes.n_lat), grid_fraction(F.col(lat), axes.lat0, axes.dlat, axes.n_lat)
    j, fj = grid_index(F.col(lon), axes.lon0, axes.dlon, axes.n_lon), grid_fraction(F.col(lon), axes.lon0, axes.dlon, axes.n_lon)
    base = places.select(F.col(key), i.alias("i"), j.alias("j"), fi.alias("fi"), fj.alias("fj"))
    corners = F.array(*[
        F.struct(((F.col("i") + a) * axes.n_lon + F.col("j") + b).alias("node"), ((F.col("fi") if a else 1 - F.col("fi")) * (F.col("fj") if b else 1 - F.col("fj"))).alias("w"))
        for a in (0, 1) for b in (0, 1)
    ])
    all_corners = base.select(key, F.explode(corners).alias("c")).select(key, F.col("c.node").alias("node"), F.col("c.w").alias("w")).join(nodes.select("node", "is_land", "elev"), "node")
    totals = all_corners.groupBy(key).agg(F.sum(F.when(F.col("is_land"), F.col("w"))).alias("total"), (~F.bool_and("is_land")).alias("coastal")).filter(F.col("total") > 0)
    return all_corners.filter("is_land").join(totals, key).select(key, "node", (F.col("w") / F.col("total")).alias("w"), "elev", "coastal")


def place_elevations(weights: DataFrame, places: DataFrame, key: str, elev: str) -> DataFrame:
    """(key, grid_m, place_m, difference_m, coastal): the grid's height at a place, which stands in for a missing own height."""
    grid = weights.groupBy(key).agg(F.sum(F.col("w") * F.col("elev")).alias("grid_m"), F.bool_or("coastal").alias("coastal"))
    own = F.coalesce(F.col(elev).cast("double"), F.col("grid_m"))
    return grid.join(places.select(key, elev), key).select(key, "grid_m", own.alias("place_m"), (own - F.col("grid_m")).alias("difference_m"), "coastal")


def downscale(daily: DataFrame, weights: DataFrame, elevations: DataFrame, key: str, node: str = "node", day: str = "day", n_lon: int | None = None) -> DataFrame:
    """(key, day, tmax, tmin) in degrees Celsius at places, from daily grid values in Kelvin.

    Weighted mean of the land corners, as single precision, moved by the lapse of the height
    difference, to two decimals. A day on which a corner in use has no value is null.

    n_lon: nodes of a grid row. With it the grid is cut into blocks of BLOCK by BLOCK nodes, which
    have the first row and column of their neighbours as a halo, as a place's corners may lie
    there; (day, block) is what is dealt, so a run over one day, or a very large grid, has many tasks. Without
    it, days are dealt. Either way corners multiply rows after the exchange, and sums need no further one.
    """
    mean = lambda c: F.when(F.count(c) == F.count("*"), F.sum(F.col("w") * c))
    at = weights.filter(F.col("w") > 0).select(key, F.col("node").alias("__node"), "w")
    hot, cold = nan_to_null(F.col("tmax").cast("double")), nan_to_null(F.col("tmin").cast("double"))
    rows = daily.select(F.col(node).alias("__at"), day, hot.alias("hot"), cold.alias("cold"))
    if n_lon is None:
        rows, at = rows.select("*", F.lit(0).cast("long").alias("__block")), at.select("*", F.lit(0).cast("long").alias("__own"))
    else:
        i, j = F.call_function("div", F.col("__node"), F.lit(n_lon)), F.col("__node") % n_lon
        block = lambda i, j: (F.floor(i / BLOCK) * (n_lon // BLOCK + 1) + F.floor(j / BLOCK)).cast("long")
        # A place's corners are within one node of each other, so that the least ones' block has them all.
        own = at.groupBy(key).agg(block(F.min(i), F.min(j)).alias("__own"))
        at = at.join(own, key)
        i, j = F.call_function("div", F.col("__at"), F.lit(n_lon)), F.col("__at") % n_lon
        around = F.array_distinct(F.array(*[block(F.greatest(i - a, F.lit(0)), F.greatest(j - b, F.lit(0))) for a in (0, 1) for b in (0, 1)]))
        rows = rows.select("*", F.explode(around).alias("__block"))
    dealt = rows.repartition(int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions")), day, "__block")
    met = dealt.join(at, (F.col("__at") == F.col("__node")) & (F.col("__block") == F.col("__own")))
    sums = met.groupBy(day, "__block", key).agg(mean(F.col("hot")).alias("hot"), mean(F.col("cold")).alias("cold"))
    single = lambda c: celsius(F.col(c)).cast("float").cast("double")
    return sums.join(elevations.select(key, "difference_m"), key).select(
        key, day, F.round(lapse_adjust(single("hot"), F.col("difference_m"), LAPSE_TMAX), 2).alias("tmax"), F.round(lapse_adjust(single("cold"), F.col("difference_m"), LAPSE_TMIN), 2).alias("tmin")
    )


def grid_qc(daily: DataFrame, file: str, day: str, value: str, is_land: Column, month: int = 7, limit_c: float = 20.0) -> DataFrame:
    """(file, mean_c, kind): the land mean of a month tells whether an unlabelled file holds maxima or minima."""
    v = nan_to_null(F.col(value).cast("double"))
    means = daily.filter(F.month(day) == month).filter(is_land).groupBy(file).agg(F.avg(celsius(v)).alias("mean_c"))
    return means.withColumn("kind", F.when(F.col("mean_c") > limit_c, "tmax").otherwise("tmin"))


def nearest_node(lat: Column, lon: Column, axes: Axes) -> Column:
    """Id of the node nearest to a point on the grid."""
    return nearest_index(lat, axes.lat0, axes.dlat) * axes.n_lon + nearest_index(lon, axes.lon0, axes.dlon)
