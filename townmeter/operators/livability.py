"""Facility counts and population trend per place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Facility codes by service.
CODES = {
    "hospital": ("D101",), "urgences": ("D106",), "gp": ("D201",), "pharmacy": ("D307",), "supermarket": ("B101", "B102"),
    "bakery": ("B203",), "school": ("C107", "C108"), "college": ("C201",), "lycee": ("C301", "C302", "C303"), "station": ("E107", "E108", "E109"),
}


def facility_counts(facilities: DataFrame, place: str = "DEPCOM", code: str = "TYPEQU", codes: Mapping[str, Sequence[str]] | DataFrame = CODES, services: Sequence[str] = ()) -> DataFrame:
    """One row per place with a listed facility: the number of each service, null if there is none.

    codes: codes by service, or a table (code, service) with `services` as the result's columns.
    """
    if isinstance(codes, DataFrame):
        listed = codes.select(F.col("code").alias("__code"), "service").filter(F.col("service").isin(*services))
        rows = facilities.select(F.col(place).alias("place"), F.col(code).alias("__listed")).join(listed, F.col("__listed") == F.col("__code"))
        return rows.groupBy("place").pivot("service", list(services)).count()
    service = F.create_map(*[F.lit(x) for key, own in codes.items() for c in own for x in (c, key)])
    listed = [c for own in codes.values() for c in own]
    rows = facilities.filter(F.col(code).isin(listed)).select(F.col(place).alias("place"), F.element_at(service, F.col(code)).alias("service"))
    return rows.groupBy("place").pivot("service", list(codes)).count()


def population_trend(populations: DataFrame, place: str = "codgeo", year: str = "annee_rp", people: str = "pmun", first: str = "2017", last: str = "2021") -> DataFrame:
    """(place, trend_pct): yearly growth in percent between two vintages that both have people; one pass, no self-join."""
    there = populations.filter(F.col(year).isin(first, last) & (F.col(people) > 0))
    at = lambda y: F.max(F.when(F.col(year) == y, F.col(people).cast("double")))
    both = there.groupBy(F.col(place).alias("place")).agg(at(first).alias("a"), at(last).alias("b")).filter("a is not null and b is not null")
    years = float(int(last) - int(first))
    return both.select("place", F.round((F.pow(F.col("b") / F.col("a"), F.lit(1 / years)) - 1) * 100, 2).alias("trend_pct"))


def service_coverage(counts: DataFrame, services: Sequence[str] = ("hospital", "station")) -> DataFrame:
    """One row: places with data, and with each service."""
    return counts.agg(F.count("*").alias("places"), *[F.count_if(F.col(s) > 0).alias(f"with_{s}") for s in services])
