"""Composite scores over burdens, gates and sub-indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from townmeter.functions.labels import round_up

#: Share of the weights that must have a burden.
LEAST_COVERAGE = 0.6


def composite_score(subs: Column) -> Column:
    """struct(score, coverage) of an array of struct(burden, weight).

    100 minus the weighted mean of the burdens that are there; null when their weights are less
    than 0.6 of all, or nothing. No weight at all gives (null, 0); a negative weight fails the job.
    """
    zero = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("used"), F.lit(0.0).alias("sum"))

    def add(a: Column, x: Column) -> Column:
        w = F.when(x["weight"] < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(x["weight"].cast("double"))
        there = x["burden"].isNotNull()
        return F.struct((a["all"] + w).alias("all"), (a["used"] + F.when(there, w).otherwise(0.0)).alias("used"), (a["sum"] + F.when(there, x["burden"] * w).otherwise(0.0)).alias("sum"))

    def end(a: Column) -> Column:
        coverage = F.when(a["all"] > 0, a["used"] / a["all"]).otherwise(0.0)
        score = F.when((coverage >= LEAST_COVERAGE) & (a["used"] > 0), 100.0 - a["sum"] / a["used"])
        return F.struct(score.alias("score"), coverage.alias("coverage"))

    return F.aggregate(subs, zero, add, end)


def gated(*flags: Column) -> Column:
    """Whether any severe flag is set; a null flag isn't."""
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def heat_index(day_percentile: Column, night_percentile: Column) -> Column:
    """Rounded mean of two percentiles; null if either is."""
    return round_up((day_percentile + night_percentile) / 2)
