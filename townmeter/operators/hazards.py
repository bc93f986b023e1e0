"""Hazard registers to one row of counts and flags per place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townmeter.functions.labels import date10, department

# Labels of the decree and risk registers.
FLOOD_LABELS = ("Inondations et/ou Coulées de Boue", "Inondations Remontée Nappe")
WAVE_LABEL, DROUGHT_LABEL = "Chocs Mécaniques liés à l'action des Vagues", "Sécheresse"
WILDFIRE_LABEL, CLAY_LABEL = "Feu de forêt", "Tassements différentiels"
#: First year of the decrees, and places that a department's rate needs.
FIRST_YEAR, LEAST_PLACES = 1982, 50

#: What a place without any register entry has.
DEFAULTS = {"floods": 0, "floods_2000": 0, "last_flood": None, "waves": 0, "droughts": 0, "plan": None, "atlas": False, "wildfire": False, "clay": False, "coastal": False}


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def decree_counts(decrees: DataFrame, decree: str, place: str, label: str, date: str, flood: Sequence[str] = FLOOD_LABELS, wave: str = WAVE_LABEL, drought: str = DROUGHT_LABEL) -> DataFrame:
    """Counts per place of decrees that differ in (id, place, label, date).

    Rows without a place or label don't count; an unlisted label makes a place with zeros; a
    missing date is never since 2000. Repeated rows are dropped per task before the first exchange,
    so that a place with very many rows isn't one task's.
    """
    day = date10(F.col(date).cast("string"))
    rows = decrees.select(F.col(decree).cast("string").alias("id"), F.col(place).alias("place"), F.col(label).alias("label"), F.coalesce(day, F.lit("")).alias("day"))
    rows = rows.filter(_filled("place") & _filled("label")).dropDuplicates(["id", "place", "label", "day"])
    is_flood = F.col("label").isin(*flood)
    return rows.groupBy("place").agg(
        F.count_if(is_flood).alias("floods"), F.count_if(is_flood & (F.col("day") >= "2000-01-01")).alias("floods_2000"),
        F.max(F.when(is_flood & (F.col("day") != ""), F.col("day"))).alias("last_flood"),
        F.count_if(F.col("label") == wave).alias("waves"), F.count_if(F.col("label") == drought).alias("droughts"),
    )


def plan_states(plans: DataFrame, place: str, risks: Sequence[str], state: str) -> DataFrame:
    """(place, plan): the best state of a place's flood plans; approved wins over prescribed, other states give null."""
    risk, is_in = F.lower(F.concat_ws(" ", *risks)), F.lower(F.coalesce(F.col(state), F.lit("")))
    rank = F.when(is_in.contains("opposable") | is_in.contains("approuv"), 2).when(is_in.contains("prescrit"), 1)
    best = plans.filter(_filled(place)).filter(risk.contains("nondation") | risk.contains("ubmersion")).groupBy(F.col(place).alias("place")).agg(F.max(rank).alias("best"))
    return best.select("place", F.when(F.col("best") == 2, "approved").when(F.col("best") == 1, "prescribed").alias("plan"))


def presence(register: DataFrame, place: str, **flags) -> DataFrame:
    """(place, flags): whether any of a place's rows meets each condition; places without a hit are left out."""
    rows = register.filter(_filled(place)).groupBy(F.col(place).alias("place")).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    hit = F.lit(False)
    for n in flags:
        hit = hit | F.col(n)
    return rows.filter(hit)


def merge_registers(*parts: DataFrame) -> DataFrame:
    """One row per place of any part, by a union and one grouping; what no part gives is zero, false or null."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    have = [c for c in DEFAULTS if c in whole.columns]
    merged = whole.groupBy("place").agg(*[(F.bool_or(c) if DEFAULTS[c] is False else F.max(c)).alias(c) for c in have])
    return merged.fillna({c: DEFAULTS[c] for c in have if DEFAULTS[c] is not None})


def register_counts(hazards: DataFrame) -> DataFrame:
    """One row: places with data, and those under a coastal decree if the register has them."""
    coastal = F.count_if(F.col("coastal")) if "coastal" in hazards.columns else F.lit(0).cast("long")
    return hazards.agg(F.count("*").alias("places"), coastal.alias("coastal_places"))


def flood_rates(hazards: DataFrame, place: str = "place", floods: str = "floods", least: int = LEAST_PLACES, top: int = 5) -> DataFrame:
    """Departments with the most floods per place, of those with enough places; ties by code."""
    rates = hazards.groupBy(department(F.col(place)).alias("dept")).agg(F.sum(floods).alias("floods"), F.count("*").alias("places")).filter(F.col("places") >= least)
    return rates.withColumn("rate", F.col("floods") / F.col("places")).orderBy(F.desc("rate"), "dept").limit(top)


def yearly_flood_rate(hazards: DataFrame, as_of_year: int, floods: str = "floods") -> DataFrame:
    """hazards with floods per year of observation."""
    return hazards.withColumn("floods_per_year", F.col(floods) / F.lit(float(as_of_year - FIRST_YEAR + 1)))
