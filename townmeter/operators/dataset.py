"""Metrics, hazards and services to one ranked row per place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townmeter.functions.labels import round_up
from townmeter.functions.scores import heat_index
from townmeter.operators.normalise import rank_columns

#: Recent summers that a ranked place needs.
MIN_RECENT_YEARS = 8
#: Services as flags, and those as counts.
FLAGS = {"hospital": "hosp", "urgences": "urg", "pharmacy": "pharm", "station": "station", "lycee": "lycee", "supermarket": "superm"}


def gate_places(metrics: DataFrame, places: DataFrame, key: str = "insee", years: str = "summers", summer: str = "summer_tmax", least: int = MIN_RECENT_YEARS) -> DataFrame:
    """metrics with `kept`: in the referential, enough recent summers, and a summer mean; the others are the excluded ones."""
    known = places.select(F.col(key).alias("__known")).distinct()
    good = F.col("__known").isNotNull() & (F.coalesce(F.col(years), F.lit(0)) >= least) & F.col(summer).isNotNull()
    return metrics.join(known, F.col(key) == F.col("__known"), "left").withColumn("kept", good).drop("__known")


def assemble(metrics: DataFrame, places: DataFrame, hazards: DataFrame, services: DataFrame, key: str = "insee", unknown: bool = False) -> DataFrame:
    """Inner join with places, left joins with hazards and services; absent hazards are 0 or false, absent services false or 0.

    unknown=True leaves absent values null instead.
    """
    zero = lambda c, d: F.col(c) if unknown else F.coalesce(F.col(c), F.lit(d))
    joined = metrics.join(places, key).join(hazards.withColumnRenamed("place", key), key, "left").join(services.withColumnRenamed("place", key), key, "left")
    counts = [zero(c, 0).alias(c) for c in ("floods", "floods_2000")]
    flags = [zero(c, False).alias(c) for c in ("atlas", "wildfire", "clay", "coastal") if c in hazards.columns]
    rest = [c for c in ("last_flood", "plan") if c in hazards.columns]
    own = [(F.col(s) > 0 if unknown else F.coalesce(F.col(s), F.lit(0)) > 0).alias(n) for s, n in FLAGS.items() if s in services.columns]
    gp = [zero("gp", 0).alias("gp")] if "gp" in services.columns else []
    trend = ["trend_pct"] if "trend_pct" in services.columns else []
    return joined.select(*metrics.columns, *[c for c in places.columns if c != key], *counts, *rest, *flags, *own, *gp, *trend)


def with_percentiles(kept: DataFrame, key: str = "insee", cdd: str = "cdd18", tropical: str = "tropical_nights", floods: str = "floods") -> DataFrame:
    """kept with heat_pct, the rounded mean of two ranks, and flood_pct; ranks are over all kept places, so they come after the gate."""
    ranks = rank_columns(kept, key, [cdd, tropical, floods])
    heat = heat_index(F.col(f"{cdd}_pct"), F.col(f"{tropical}_pct"))
    return kept.join(ranks.select(key, heat.alias("heat_pct"), round_up(F.col(f"{floods}_pct")).alias("flood_pct")), key)


def dataset_meta(dataset: DataFrame, generated_at: str, model: str, source: str) -> DataFrame:
    """One row that goes with the dataset."""
    return dataset.agg(F.count("*").alias("places")).select(F.lit(generated_at).alias("generated_at"), F.lit(model).alias("model"), F.lit(source).alias("source"), "places")
