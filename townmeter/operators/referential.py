"""The place referential: points, heights, target selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_places(raw: DataFrame) -> DataFrame:
    """Places of raw geo records: the town hall's point, else the centre; [longitude, latitude] pairs. Records without a point have null coordinates."""
    point = F.coalesce(F.col("mairie"), F.col("centre"))
    return raw.select(
        F.col("code").alias("insee"), F.col("nom").alias("name"), F.col("codeDepartement").alias("dept"), F.col("codeEpci").alias("epci"), F.col("population"),
        F.get(point["coordinates"], F.lit(1)).alias("lat"), F.get(point["coordinates"], F.lit(0)).alias("lon"),
        F.when(F.col("mairie").isNotNull(), "mairie").when(F.col("centre").isNotNull(), "centre").alias("coord_source"),
    )


def ingest(raw: DataFrame) -> DataFrame:
    """Places that have a point."""
    return to_places(raw).filter("coord_source is not null")


def ingest_counts(places: DataFrame, elevation: str = "elevation_m") -> DataFrame:
    """One row of counts over to_places() with heights: places, centre fallbacks, records without a point, missing heights."""
    there = F.col("coord_source").isNotNull()
    return places.agg(
        F.count_if(there).alias("places"), F.count_if(F.col("coord_source") == "centre").alias("centre_fallbacks"),
        F.count_if(~there).alias("without_point"), F.count_if(there & F.col(elevation).isNull()).alias("without_elevation"),
    )


def point_key(lat: Column, lon: Column, digits: int = 5) -> list[Column]:
    """Coordinates as whole numbers of 10^-digits degrees, so that equal rounded points are equal keys."""
    return [F.round(c * F.lit(float(10**digits))).cast("long") for c in (lat, lon)]


def attach_elevation(places: DataFrame, heights: DataFrame, digits: int = 5, lat: str = "lat", lon: str = "lon", elevation: str = "elevation_m") -> DataFrame:
    """places with the height of the equal rounded point, null if there is none; heights: lat, lon, height, one per point."""
    ky, kx = point_key(F.col("lat"), F.col("lon"), digits)
    table = heights.select(ky.alias("__hy"), kx.alias("__hx"), F.col("height").alias(elevation))
    py, px = point_key(F.col(lat), F.col(lon), digits)
    return places.withColumn("__py", py).withColumn("__px", px).join(table, (F.col("__py") == F.col("__hy")) & (F.col("__px") == F.col("__hx")), "left").drop("__py", "__px", "__hy", "__hx")


def select_targets(places: DataFrame, mode: str, pilot: Sequence[str], names: Sequence[str] = (), dept: str = "dept", name: str = "name", population: str = "population", key: str = "insee") -> DataFrame:
    """Places of a run: `all`, `pilot` (its departments), `dept:NN`, or `validation` (the best place of each name)."""
    if mode == "all":
        return places
    if mode == "pilot":
        return places.filter(F.col(dept).isin(*pilot))
    if mode.startswith("dept:"):
        return places.filter(F.col(dept) == mode[5:])
    if mode == "validation":
        return best_per_name(places.filter(F.col(name).isin(*names)), pilot, dept, name, population, key)
    raise ValueError(f"unknown mode {mode}")


def names_not_found(places: DataFrame, names: Sequence[str], name: str = "name") -> DataFrame:
    """(name) of the names of a run that no place has."""
    wanted = places.sparkSession.createDataFrame([(n,) for n in names], "__wanted string")
    return wanted.join(places.select(F.col(name).alias("__name")), F.col("__wanted") == F.col("__name"), "left_anti").select(F.col("__wanted").alias("name"))


def best_per_name(places: DataFrame, pilot: Sequence[str], dept: str = "dept", name: str = "name", population: str = "population", key: str = "insee") -> DataFrame:
    """One place per name: pilot departments first, then the most people, then the smallest key."""
    order = [F.when(F.col(dept).isin(*pilot), 0).otherwise(1), F.coalesce(F.col(population), F.lit(0)).desc(), F.col(key)]
    return places.withColumn("__at", F.row_number().over(Window.partitionBy(name).orderBy(*order))).filter("__at = 1").drop("__at")
