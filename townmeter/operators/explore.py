"""Searches over the dataset: presets, radius, ranking, names, permalinks, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townmeter.functions.labels import plain, round_up, signed
from townmeter.operators.pyramid import coolest_within
from townmeter.sources.scratch import Tables

# Defaults and limits of a search, and zoom bands (name, from zoom, below zoom, fewest people).
DEFAULT_ORIGIN, DEFAULT_KM, DEFAULT_PEOPLE = "34172", 150.0, 1000.0
LEAST_KM, MOST_KM = 25.0, 500.0
ZOOM_BANDS = (("z0", 0.0, 7.0, 5000), ("z1", 7.0, 8.5, 1000), ("z2", 8.5, 24.0, 0))
#: Rows of a search, hits of a name search.
TOP, NAMES = 15, 8


def passes_preset(people: Column, hospital: Column, station: Column, least: Column) -> Column:
    """-1 asks for a hospital and a station, anything else for so many people; a null population is 0."""
    return F.when(least == -1, hospital & station).otherwise(F.coalesce(people, F.lit(0)) >= least)


def zoom_rows(places: DataFrame, people: str = "population") -> DataFrame:
    """places once per zoom band that shows them."""
    bands = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(a).alias("min_zoom"), F.lit(b).alias("max_zoom"), F.lit(p).alias("least")) for n, a, b, p in ZOOM_BANDS])
    return places.select("*", F.explode(F.filter(bands, lambda b: F.coalesce(F.col(people), F.lit(0)) >= b["least"])).alias("__b")).select(*places.columns, "__b.band", "__b.min_zoom", "__b.max_zoom")


def find_names(places: DataFrame, query: str, name: str = "name", people: str = "population", key: str = "insee") -> DataFrame:
    """The most populous places whose name starts with the query, without accents and case; queries under two letters find none."""
    q = query.strip()
    wanted = plain(F.lit(q))
    found = places.filter(plain(F.col(name)).startswith(wanted)) if len(q) >= 2 else places.limit(0)
    return found.orderBy(F.coalesce(F.col(people), F.lit(0)).desc(), key).limit(NAMES)


def prefix_index(places: DataFrame, lengths: Sequence[int], name: str = "name", people: str = "population", key: str = "insee") -> DataFrame:
    """(prefix, place): the NAMES most populous places under each prefix of their plain names, of the lengths given; what a table of name searches is joined with.

    Places are dealt out by key and cut to NAMES per name before names are cut into prefixes, and
    a prefix's rows are cut to NAMES in each task before the exchange, so neither a name nor a
    prefix of very many places is a large group, and no task holds the prefixes of a whole file.
    """
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = lambda rows, by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("place.less", "place.key"))).filter(F.col("rank") <= NAMES)
    place = F.struct((-F.coalesce(F.col(people), F.lit(0))).alias("less"), F.col(key).alias("key"), F.col(name).alias("name"), F.col(people).alias("people"))
    rows = places.repartition(tasks, key).select(F.substring(plain(F.col(name)), 1, max(lengths)).alias("p"), place.alias("place")).filter(F.length("p") >= min(lengths))
    few = best(rows, "p").drop("rank").repartition(tasks, "place.key")
    cut = F.filter(F.array(*[F.lit(int(n)) for n in lengths]), lambda n: n <= F.length("p"))
    return best(few.select(F.explode(F.transform(cut, lambda n: F.col("p").substr(F.lit(1), n))).alias("prefix"), "place"), "prefix")


def search_names(searches: DataFrame, places: DataFrame, search: str = "search_id", query: str = "query", name: str = "name", people: str = "population", key: str = "insee") -> DataFrame:
    """(search, rank, key, name, people): the answers of `find_names` for a table of searches; those under two letters, or null, find none.

    Names are read once, into an index of prefixes as long as those that are asked for, of which
    there are few; equal queries share its entries.
    """
    trimmed = F.trim(F.col(query))
    asked = Tables(searches.sparkSession, "names").put(searches.filter(F.length(trimmed) >= 2).select(F.col(search).alias("__search"), plain(trimmed).alias("prefix")))
    lengths = [r.n for r in asked.select(F.length("prefix").alias("n")).distinct().collect()]
    if not lengths:
        lengths = [2]
    found = asked.join(prefix_index(places, lengths, name, people, key), "prefix")
    return found.select(F.col("__search").alias(search), "rank", F.col("place.key").alias(key), F.col("place.name").alias(name), F.col("place.people").alias(people))


def _number(url: Column, name: str) -> Column:
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
    v = F.when(F.trim(raw) != "", raw).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def parse_permalinks(links: DataFrame, url: str = "url") -> DataFrame:
    """links with origin, km and people: the query parameters o, r and p within their limits, else the defaults."""
    km, people = _number(F.col(url), "r"), _number(F.col(url), "p")
    return links.withColumns({
        "origin": F.coalesce(F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit("o")), F.lit(DEFAULT_ORIGIN)),
        "km": F.when(km.between(LEAST_KM, MOST_KM), km).otherwise(DEFAULT_KM),
        "people": F.when(people >= -1, people).otherwise(DEFAULT_PEOPLE),
    })


def attach_origins(searches: DataFrame, places: DataFrame, key: str = "insee", summer: str = "summer_tmax") -> DataFrame:
    """searches with origin_key, origin_lat, origin_lon, origin_summer; an unknown origin becomes the place with the hottest summer, one row."""
    known = places.select(F.col(key).alias("origin_key"), F.col("lat").alias("origin_lat"), F.col("lon").alias("origin_lon"), F.col(summer).alias("origin_summer"))
    first = known.orderBy(F.desc_nulls_last("origin_summer"), "origin_key").limit(1).select(*[F.col(c).alias(f"__{c}") for c in known.columns])
    found = searches.join(known, searches["origin"] == F.col("origin_key"), "left").crossJoin(F.broadcast(first))
    missing = F.col("origin_key").isNull()
    return found.select(*searches.columns, *[F.when(missing, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in known.columns])


def coolest(searches: DataFrame, places: DataFrame, key: str = "insee", summer: str = "summer_tmax", search: str = "search_id", top: int = TOP) -> DataFrame:
    """The coolest places within each search's radius that pass its preset, with rank, distance and difference to the origin.

    searches: search_id, origin_key, origin_lat, origin_lon, origin_summer, km, people. Ties go to
    the smaller key. Searches that ask the same are answered once, from a pyramid of cells with
    their coolest places (`pyramid.coolest_within`), so no search meets all places of its circle.
    """
    tables = Tables(searches.sparkSession, "coolest")
    question = {"la": "origin_lat", "lo": "origin_lon", "reach": "km", "people": "people"}
    searches = tables.put(searches.select(search, "origin_key", "origin_lat", "origin_lon", "origin_summer", "km", "people"))
    places = tables.put(places.select(key, "lat", "lon", summer, "population", "hosp", "station"))
    asked = tables.put(searches.select(*[F.col(c).cast("double").alias(q) for q, c in question.items()]).distinct().withColumn("q", F.monotonically_increasing_id()))
    answers = coolest_within(asked, places, tables, key, summer, top).withColumnsRenamed({"key": "__key", "km": "__km", "summer": "__summer"})
    numbered = searches.join(asked, [searches[c].cast("double").eqNullSafe(asked[q]) for q, c in question.items()]).select(searches[search], "origin_key", "origin_summer", "q")
    return numbered.join(answers, "q").select(search, "origin_key", "rank", F.col("__key").alias(key), F.col("__km").alias("km"), F.col("__summer").alias(summer), (F.col("__summer") - F.col("origin_summer")).alias("delta"))


def hottest(metrics: DataFrame, summer: str = "summer_tmax", key: str = "insee") -> DataFrame:
    """metrics from the hottest summer down, null last."""
    return metrics.orderBy(F.desc_nulls_last(summer), key)


def spot_check(metrics: DataFrame, summer: str = "summer_tmax", key: str = "insee", ends: int = 15, most: int = 40) -> DataFrame:
    """The hottest and the coolest rows, or all if there are few; two bounded top-k selections, of which the first tells how many there are."""
    bounded = hottest(metrics, summer, key).limit(most + 1)
    row = F.struct(*[F.col(f"`{c}`") for c in metrics.columns]).alias("row")
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(summer), key))
    head = bounded.select(row, n.alias("n"), at.alias("at")).filter((F.col("n") <= most) | (F.col("at") <= ends))
    tail = metrics.orderBy(F.asc_nulls_first(summer), F.desc(key)).limit(ends).select(row).join(F.broadcast(bounded.agg(F.count("*").alias("n"))), F.col("n") > most)  # one row
    return head.select("row").unionByName(tail.select("row")).select("row.*")


def export_rows(found: DataFrame) -> DataFrame:
    """Columns of the CSV export: whole kilometres, signed delta to one decimal, flags as 1 or 0, nulls empty when written."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    return found.select(
        "insee", "name", "dept", round_up(F.col("km")).cast("long").alias("distance_km"), "elevation_m", "population", "summer_tmax",
        F.format_string("%.1f", F.col("delta")).alias("delta"), "tropical_nights", "days35", "cdd18", "heat_pct", "flood_pct", "floods", "last_flood", "plan",
        flag("wildfire"), flag("clay"), flag("coastal"), flag("hosp"), flag("station"),
    )


def write_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def point_features(places: DataFrame, in_radius: Column | None = None, key: str = "insee", summer: str = "summer_tmax", people: str = "population") -> DataFrame:
    """(key, feature): one JSON point per place; in_radius is 1 everywhere without an origin."""
    inside = F.lit(1) if in_radius is None else F.coalesce(in_radius, F.lit(False)).cast("int")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(F.col(key).alias("insee"), F.col(summer).alias("jja"), F.col(people).alias("pop"), inside.alias("inRadius")).alias("properties"),
    )
    return places.select(key, F.to_json(feature).alias("feature"))


def delta_text(value: Column, origin: Column) -> Column:
    """Difference to the origin with its sign; null if either is missing."""
    return signed(value - origin)
