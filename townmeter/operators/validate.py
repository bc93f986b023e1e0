"""Station observations against the model: aggregates, matches, bias and RMSE by elevation band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townmeter.functions.labels import elevation_band, elevation_order, round_up
from townmeter.operators.near import nearest_within

#: Largest distance and height difference of a match, and summer days that a station needs.
MATCH_KM, MATCH_M, MIN_SUMMER_DAYS = 8.0, 150.0, 680


def station_aggregates(rows: DataFrame, station: str = "station", day: str = "day", tx: str = "tx", tn: str = "tn", first: str | None = None, last: str | None = None) -> DataFrame:
    """Per station: sum and count of summer maxima, tropical nights and counted minima, and name, lat, lon, alti of its first day."""
    if first and last:
        rows = rows.filter(F.col(day).between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    summer = F.month(day).between(6, 8)
    about = [c for c in ("name", "lat", "lon", "alti") if c in rows.columns]
    counts = ("summer_sum", "summer_days", "tropical", "nights")
    # One row per station and place first, by counters only, so that no task sorts rows of days for the first one's place.
    each = rows.groupBy(station, *about).agg(
        F.sum(F.when(summer, F.col(tx))).alias("summer_sum"), F.count(F.when(summer, F.col(tx))).alias("summer_days"),
        F.count_if(F.col(tn) >= 20).alias("tropical"), F.count(tn).alias("nights"), F.when(F.count_if(F.col(day).isNull()) == 0, F.min(day)).alias("__first"),
    )
    if not about:  # a row a station already: grouped again, each task would hold its stations in two more tables
        return each.select(station, *counts)
    out = each.groupBy(station).agg(*[F.sum(c).alias(c) for c in counts], F.min(F.struct("__first", *about)).alias("__m"))
    return out.select(station, *counts, *[F.col(f"__m.{c}").alias(c) for c in about])


def station_indices(aggregates: DataFrame, least: int = MIN_SUMMER_DAYS) -> DataFrame:
    """Stations with enough summer days and a place: pooled summer mean, tropical nights per year (null without minima)."""
    good = (F.col("summer_days") >= least) & F.col("lat").isNotNull() & ~F.isnan(F.col("lat").cast("double"))
    return aggregates.filter(good).withColumn("summer_mean", F.col("summer_sum") / F.col("summer_days")).withColumn(
        "tropical_per_year", F.when(F.col("nights") > 0, F.col("tropical") / (F.col("nights") / F.lit(365.25)))
    )


def match_stations(stations: DataFrame, places: DataFrame, station: str, place: str, km: float = MATCH_KM, metres: float = MATCH_M, max_lat: float = 60.0) -> DataFrame:
    """Each station's nearest place within km whose height differs by at most metres; places without a height don't count.

    stations: lat, lon, alti; places: place_lat, place_lon, place_m.
    """
    return nearest_within(stations, places, station, place, km, max_lat, ("alti", "place_m", metres), left_at=("lat", "lon"), right_at=("place_lat", "place_lon"))


def bias_rows(matched: DataFrame, station: str, model: str, observed: str = "summer_mean") -> DataFrame:
    """(station, alti, band, band_order, bias): model minus the unrounded observation, to two decimals."""
    bias = round_up(F.col(model) - F.col(observed), 2)
    return matched.select(station, "alti", elevation_band(F.col("alti")).alias("band"), elevation_order(F.col("alti")).alias("band_order"), bias.alias("bias"))


def station_report(matched: DataFrame, station: str, place: str, model: str) -> DataFrame:
    """The station table of the report, lowest station first: means and distance to one decimal, bias to two."""
    rows = matched.select(
        station, "alti", elevation_band(F.col("alti")).alias("band"), place, round_up(F.col("km"), 1).alias("distance_km"), round_up(F.col("summer_mean"), 1).alias("observed"),
        F.col(model).alias("model"), round_up(F.col(model) - F.col("summer_mean"), 2).alias("bias"), round_up(F.col("tropical_per_year"), 1).alias("tropical_per_year"),
    )
    return rows.orderBy("alti", station)


def band_stats(biases: DataFrame) -> DataFrame:
    """Mean bias and RMSE per band from the rounded biases, lowest band first."""
    b = F.col("bias")
    return biases.groupBy("band", "band_order").agg(F.count("*").alias("n"), round_up(F.avg(b), 2).alias("mean_bias"), round_up(F.sqrt(F.avg(b * b)), 2).alias("rmse")).orderBy("band_order")


def release_gates(biases: DataFrame, dataset: DataFrame, indicators: list[str], most_bias: float, most_missing: float) -> DataFrame:
    """(gate, value, most, passed): the median absolute bias, and the share of places that miss an indicator."""
    missing = F.lit(False)
    for c in indicators:
        missing = missing | F.col(c).isNull()
    one = biases.agg(F.percentile(F.abs(F.col("bias")), F.lit(0.5)).alias("value")).select(F.lit("median bias").alias("gate"), "value", F.lit(float(most_bias)).alias("most"))
    two = dataset.agg((F.count_if(missing) / F.count("*")).alias("value")).select(F.lit("missing indicators").alias("gate"), "value", F.lit(float(most_missing)).alias("most"))
    return one.unionByName(two).withColumn("passed", F.col("value") <= F.col("most"))


def terrain_gates(matched: DataFrame, model: str, observed: str, most: float) -> DataFrame:
    """(gate, band_order, stations, value, most, passed): per terrain class, by the station's height, the mean absolute error of the hot days a year; stations that miss a count take no part."""
    error = F.abs(F.col(model).cast("double") - F.col(observed).cast("double"))
    classes = matched.filter(error.isNotNull()).groupBy(elevation_band(F.col("alti")).alias("band"), elevation_order(F.col("alti")).alias("band_order")).agg(F.count("*").alias("stations"), F.avg(error).alias("value"))
    return classes.select(F.concat(F.lit("hot days "), "band").alias("gate"), "band_order", "stations", "value", F.lit(float(most)).alias("most"), (F.col("value") <= most).alias("passed"))
