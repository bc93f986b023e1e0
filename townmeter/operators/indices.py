"""Annual climate indices of daily series, with coverage gates, and longest spells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townmeter.functions.labels import round_up

#: Valid days that a year, and a summer, needs; summers that a normals layer needs.
MIN_DAYS, MIN_SUMMER_DAYS, MIN_NORMALS_YEARS = 350, 85, 20


def slice_layers(series: DataFrame, layers: Mapping[str, tuple[str, str]], day: str = "day") -> DataFrame:
    """The rows of each layer, both ends inclusive; a day may lie in several layers. layers has a few constant rows."""
    bounds = F.array(*[F.struct(F.lit(k).alias("layer"), F.to_date(F.lit(a)).alias("a"), F.to_date(F.lit(b)).alias("b")) for k, (a, b) in layers.items()])
    inside = F.filter(bounds, lambda x: F.col(day).between(x["a"], x["b"]))
    return series.select("*", F.explode(F.transform(inside, lambda x: x["layer"])).alias("layer"))


def series_violations(arrays: DataFrame, key: str, days: str, columns: Sequence[str]) -> DataFrame:
    """(key, problem) of array-form series: bad ISO dates, dates that don't ascend strictly, columns of another length."""
    d = F.col(days)
    bad = F.exists(d, lambda x: ~x.rlike(r"^\d{4}-\d{2}-\d{2}$"))
    unsorted = F.exists(F.sequence(F.lit(1), F.greatest(F.size(d) - 1, F.lit(1))), lambda i: F.get(d, i) <= F.get(d, i - 1))
    problems = [F.when(bad, "bad date"), F.when(unsorted, "not ascending")]
    problems += [F.when(F.col(c).isNotNull() & (F.size(c) != F.size(d)), f"length of {c}") for c in columns]
    return arrays.select(key, F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def row_violations(series: DataFrame, key: str, day: str, at: str) -> DataFrame:
    """(key, day, problem) of row-form series whose days don't ascend strictly in the order of `at`."""
    before = F.lag(day).over(Window.partitionBy(key).orderBy(at))
    return series.withColumn("__before", before).filter(F.col("__before") >= F.col(day)).select(key, day, F.when(F.col("__before") == F.col(day), "duplicate day").otherwise("not ascending").alias("problem"))


def yearly(series: DataFrame, keys: Sequence[str], day: str = "day", tmax: str = "tmax", tmin: str = "tmin", precip: str = "precip", gust: str | None = None) -> DataFrame:
    """One row per series and calendar year with the counts and sums that all indices need, in one pass."""
    hi, lo, rain = F.col(tmax), F.col(tmin), F.col(precip)
    wind = F.col(gust) if gust else F.lit(None).cast("double")
    mean = (hi + lo) / 2
    summer = F.month(day).between(6, 8)
    n = lambda c: F.count(c)
    return series.withColumn("year", F.year(day)).groupBy(*keys, "year").agg(
        n(hi).alias("n_tmax"), n(lo).alias("n_tmin"), n(rain).alias("n_precip"), n(wind).alias("n_gust"), n(mean).alias("n_mean"),
        F.count_if(hi >= 30).alias("hot30"), F.count_if(hi >= 35).alias("hot35"), F.count_if(lo >= 20).alias("tropical"),
        F.count_if(rain >= 40).alias("wet40"), F.count_if(wind >= 100).alias("gust100"),
        F.sum(F.greatest(F.lit(0.0), mean - 18.0)).alias("cdd18"),
        F.count(F.when(summer, hi)).alias("n_summer"), F.avg(F.when(summer, hi)).alias("summer"),
        F.min(F.when(rain.isNotNull(), F.struct((-rain).alias("p"), F.col(day).alias("day")))).alias("wettest"),
    )


def gated_mean(value: Column, valid: Column, least: int) -> Column:
    """Mean over the years with enough valid values; null if there are none."""
    return F.avg(F.when(valid >= least, value.cast("double")))


def day_rate(series: DataFrame, keys: Sequence[str], value: str, threshold: float, day: str = "day", min_days: int = MIN_DAYS) -> DataFrame:
    """Mean yearly number of days with value >= threshold over years with min_days valid values, and the number of such years."""
    years = series.withColumn("__year", F.year(day)).groupBy(*keys, "__year").agg(F.count(value).alias("valid"), F.count_if(F.col(value) >= threshold).alias("hits"))
    full = F.col("valid") >= min_days
    return years.groupBy(*keys).agg(gated_mean(F.col("hits"), F.col("valid"), min_days).alias("value"), F.count_if(full).alias("years"))


def layer_indices(years: DataFrame, keys: Sequence[str], layers: Mapping[str, tuple[int, int]], min_days: int = MIN_DAYS, min_summer: int = MIN_SUMMER_DAYS) -> DataFrame:
    """One row per series and layer of whole years: every index, rounded to one decimal, and the summers it rests on.

    Each index has its own gate: the column that it counts, both temperatures for degree-days,
    summer days for the summer mean. The yearly rows are spread over the layers, not the days.
    """
    spans = F.array(*[F.struct(F.lit(k).alias("layer"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in layers.items()])
    inside = F.filter(spans, lambda x: F.col("year").between(x["a"], x["b"]))
    rows = years.select("*", F.explode(F.transform(inside, lambda x: x["layer"])).alias("layer"))
    rate = lambda c, n: round_up(gated_mean(F.col(c), F.col(n), min_days), 1)
    return rows.groupBy(*keys, "layer").agg(
        rate("hot30", "n_tmax").alias("days30"), rate("hot35", "n_tmax").alias("days35"), rate("tropical", "n_tmin").alias("tropical_nights"),
        rate("wet40", "n_precip").alias("rain40"), rate("gust100", "n_gust").alias("gust100"), rate("cdd18", "n_mean").alias("cdd18"),
        round_up(gated_mean(F.col("summer"), F.col("n_summer"), min_summer), 1).alias("summer_tmax"),
        F.count_if(F.col("n_summer") >= min_summer).alias("summers"), F.min("wettest").alias("__wet"),
    ).select(*keys, "layer", "days30", "days35", "tropical_nights", "rain40", "gust100", "cdd18", "summer_tmax", "summers", round_up(-F.col("__wet.p"), 1).alias("rx1day"), F.col("__wet.day").alias("rx1day_date"))


def gate_layer(rows: DataFrame, layer: str, columns: Sequence[str], least: int = MIN_NORMALS_YEARS, years: str = "summers") -> DataFrame:
    """All columns of a layer become null if it rests on too few summers."""
    good = (F.col("layer") != layer) | (F.coalesce(F.col(years), F.lit(0)) >= least)
    return rows.withColumns({c: F.when(good, F.col(c)) for c in columns})


#: Bits of a word; six words hold the days of a year.
WORD, WORDS = 64, 6


def spell_summaries(series: DataFrame, keys: Sequence[str], value: str, threshold: float, day: str = "day", calendar: bool = False) -> DataFrame:
    """One row per series and year: keys, year, valid, days, lead, trail, longest, whole; what merging years needs to know of a year's runs.

    valid: days with a value; days: rows of the year, or calendar days; lead, trail: length of the
    run that the year begins and ends with; longest: its longest run; whole: every day is a hit.

    Days become bits of a year's words, which are or-ed in each task before the exchange; so days
    are not shuffled, and the exchange has a row per series, year and task. Two rows of one day are one.
    """
    place = F.dayofyear(day) - 1
    bit = lambda on, i: F.bit_or(F.when(on & (F.call_function("div", place, F.lit(WORD)) == i), F.call_function("shiftleft", F.lit(1).cast("long"), place % WORD)))
    there, hit = F.lit(True), F.coalesce(F.col(value) >= threshold, F.lit(False))
    words = [F.coalesce(bit(on, i), F.lit(0).cast("long")).alias(f"{n}{i}") for n, on in (("there", there), ("hit", hit)) for i in range(WORDS)]
    years = series.groupBy(*keys, F.year(day).alias("year")).agg(F.count(value).alias("valid"), *words)
    last_day = F.dayofyear(F.make_date("year", F.lit(12), F.lit(31)))
    is_set = lambda n, i: F.call_function("shiftright", F.array(*[F.col(f"{n}{k}") for k in range(WORDS)])[F.call_function("div", i, F.lit(WORD)).cast("int")], (i % WORD).cast("int")).bitwiseAND(F.lit(1)) == 1
    days = F.sequence(F.lit(0), last_day - 1)
    if not calendar:
        days = F.filter(days, lambda i: is_set("there", i))
    hits = F.transform(days, lambda i: is_set("hit", i))
    n = lambda k: F.lit(k).cast("long")
    # A fold over the year's days: run so far, longest, the run from the year's start, whether that still goes on.
    start = F.struct(n(0).alias("run"), n(0).alias("longest"), n(0).alias("lead"), F.lit(True).alias("whole"))

    def step(a: Column, h: Column) -> Column:
        run = F.when(h, a["run"] + 1).otherwise(n(0))
        return F.struct(run.alias("run"), F.greatest(a["longest"], run).alias("longest"), F.when(a["whole"] & h, a["lead"] + 1).otherwise(a["lead"]).alias("lead"), (a["whole"] & h).alias("whole"))

    folded = years.select(*keys, "year", "valid", F.size(days).cast("long").alias("days"), F.aggregate(hits, start, step).alias("f"))
    return folded.select(*keys, "year", "valid", "days", F.col("f.lead").alias("lead"), F.col("f.run").alias("trail"), F.col("f.longest").alias("longest"), F.col("f.whole").alias("whole"))


def merge_spells(summaries: DataFrame, keys: Sequence[str], min_days: int = MIN_DAYS, calendar: bool = False) -> DataFrame:
    """keys, longest, mean_longest, years of summaries of `spell_summaries`, whose years may have been made at different times, each once.

    Years are merged in their order: a run goes on over a year's end if one year ends and the next one begins
    with hits; with calendar=True only if no year between them is missing.
    """
    year = F.sort_array(F.collect_list(F.struct("year", "lead", "trail", "longest", "whole")))
    n = lambda k: F.lit(k).cast("long")
    start = F.struct(n(0).alias("run"), n(0).alias("longest"), F.lit(None).cast("int").alias("year"))

    def step(a: Column, y: Column) -> Column:
        before = F.when(a["year"] + 1 == y["year"], a["run"]).otherwise(n(0)) if calendar else a["run"]
        run = F.when(y["whole"], before + y["lead"]).otherwise(y["trail"])
        return F.struct(run.alias("run"), F.greatest(a["longest"], y["longest"], before + y["lead"]).alias("longest"), y["year"].alias("year"))

    full = F.col("valid") >= min_days
    merged = summaries.groupBy(*keys).agg(year.alias("all_years"), F.avg(F.when(full, F.col("longest").cast("double"))).alias("mean_longest"), F.count_if(full).alias("years"))
    return merged.filter("years > 0").select(*keys, F.aggregate("all_years", start, step)["longest"].alias("longest"), "mean_longest", "years")


def longest_spells(series: DataFrame, keys: Sequence[str], value: str, threshold: float, day: str = "day", min_days: int = MIN_DAYS, calendar: bool = False) -> DataFrame:
    """Longest run of days at or over a threshold: over everything, and the mean of each full year's longest.

    The mean takes years with min_days valid values, a year without a hit as 0, and runs are cut at
    the year's end; the absolute one crosses years and takes all of them; a series without a full
    year has no row. A null value breaks a run; a missing row does so with calendar=True alone.
    """
    return merge_spells(spell_summaries(series, keys, value, threshold, day, calendar), keys, min_days, calendar)
