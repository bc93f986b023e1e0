"""Joins by distance: radius and nearest neighbour, through grid cells."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townmeter.functions.geo import EARTH_KM, destination, haversine_km, in_bbox
from townmeter.sources.scratch import Tables, checked

#: Half a great circle on this Earth, per degree.
KM_PER_DEGREE = math.pi * EARTH_KM / 180
#: Points that a point's cell holds on average, itself included, where a search for the nearest begins, and halvings of its radius at most.
HELD, HALVINGS = 3, 14


def cell_size(km: float, max_lat: float) -> tuple[float, float]:
    """Sides in degrees of cells that no circle of km around a point up to a latitude leaves by more than one."""
    if not 0 <= max_lat < 89:
        raise ValueError("cells need latitudes under 89 degrees")
    reach = math.sin(min(km / EARTH_KM, math.pi / 2)) / math.cos(math.radians(max_lat))
    if reach >= 1:
        raise ValueError("circles must not reach the poles")
    return 1.001 * km / KM_PER_DEGREE, 1.001 * math.degrees(math.asin(reach))


def _cells(lat: Column, lon: Column, size: tuple[float, float], height: Column | None = None, metres: float = 0.0) -> dict[str, Column]:
    cells = {"y": F.floor(lat / F.lit(size[0])), "x": F.floor(lon / F.lit(size[1]))}
    return cells if height is None else cells | {"z": F.floor(height / F.lit(float(metres or 1)))}


def pairs_within(left: DataFrame, right: DataFrame, km: float | Column, most_km: float, max_lat: float, left_at: tuple[str, str] = ("lat", "lon"), right_at: tuple[str, str] = ("lat", "lon"), into: str = "km", band: tuple[str, str, float] | None = None) -> DataFrame:
    """All pairs whose distance is at most km, inclusive, with the distance; columns of both sides must differ in name.

    km may depend on the left row and is at most most_km. A left row is put into its cell and the
    8 around it, a right row into its own, so a pair meets in one cell exactly; the distance
    decides. band names a column of each side that may differ by so much at most; cells are then
    as high as that, and a left row is in 27. Points near the date line don't meet across it. Null
    coordinates join nothing. A left row beyond max_lat, where cells would be too narrow, is an
    error. Pairs are made in spark.sql.shuffle.partitions tasks, however few bytes the sides have.
    """
    size, tasks = cell_size(most_km, max_lat), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (la, lo), (ra, ro) = left_at, right_at
    lh, rh, metres = band or (None, None, 0.0)
    step = (-1, 0, 1)
    around = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(z).alias("z")) for y in step for x in step for z in (step if band else (0,))])
    north = F.when(F.abs(F.col(la)) > max_lat, F.raise_error(F.lit(f"a latitude beyond {max_lat} degrees"))).otherwise(F.col(la))
    mine = _cells(north, F.col(lo), size, F.col(lh) if band else None, metres)
    a = left.withColumn("__d", F.explode(around)).withColumns({f"__cell_{c}": v + F.col(f"__d.{c}") for c, v in mine.items()}).drop("__d").repartition(tasks, *[f"__cell_{c}" for c in mine])
    b = right.withColumns({f"__right_{c}": v for c, v in _cells(F.col(ra), F.col(ro), size, F.col(rh) if band else None, metres).items()})
    joined = a.join(b, [F.col(f"__cell_{c}") == F.col(f"__right_{c}") for c in mine])
    reach = km if isinstance(km, Column) else F.lit(float(km))
    box = in_bbox(F.col(ra), F.col(ro), F.col(la), F.col(lo), reach, pad=0.01)
    if band:
        box = box & (F.abs(F.col(rh) - F.col(lh)) <= metres)
    found = joined.filter(box).withColumn(into, haversine_km(F.col(la), F.col(lo), F.col(ra), F.col(ro))).filter(F.col(into) <= reach)
    return found.drop(*[f"__{side}_{c}" for side in ("cell", "right") for c in mine])


def _halvings(points: DataFrame, at: list[str], km: float, max_lat: float, metres: float) -> int:
    """How often km is halved until a point of points shares its cell with few others on average."""
    for level in range(HALVINGS):
        cells = _cells(F.col(at[0]), F.col(at[1]), cell_size(km / 2**level, max_lat), F.col(at[2]) if at[2:] else None, metres)
        held = points.groupBy(*cells.values()).agg(F.count("*").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("held")).first().held
        if (held or 0) <= HELD:
            return level
    return HALVINGS


def nearest_within(left: DataFrame, right: DataFrame, left_key: str, right_key: str, km: float, max_lat: float, band: tuple[str, str, float] | None = None, left_at: tuple[str, str] = ("lat", "lon"), right_at: tuple[str, str] = ("lat", "lon"), into: str = "km") -> DataFrame:
    """Each left key's nearest right row within km, and within the band of `pairs_within`, ties to the smaller right key; left rows without one are left out.

    Right rows of one point (and height) are one point with the smallest key, left rows of one
    point are searched for once. The search begins with a radius at which points have few
    neighbours and doubles it for rows that found none, up to km: what is found within a radius is
    the nearest. So a row meets a few points in a round, however dense these lie. Rows are dealt
    out by key before a least row is taken, which sorts them, as a small file holds very many. The
    rounds run when this is called.
    """
    tables = Tables(left.sparkSession, "nearest")
    mine, theirs = [*left_at, *(band or ())[:1]], [*right_at, *(band or ())[1:2]]
    others = [c for c in right.columns if c != right_key]
    rows = right.dropna(subset=theirs).repartition(right_key).groupBy(*theirs).agg(F.min(F.struct(right_key, *[c for c in others if c not in theirs])).alias("__row"))
    points = tables.put(rows.select(*theirs, "__row.*"))
    waiting, found = tables.put(left.select(*mine).dropna().distinct()), []
    for level in range(_halvings(points, theirs, km, max_lat, band[2] if band else 0.0), -1, -1):
        pairs = pairs_within(waiting, points, km / 2**level, km / 2**level, max_lat, left_at, right_at, into, band)
        best = tables.put(pairs.groupBy(*mine).agg(F.min(F.struct(into, right_key, *others)).alias("__best")))
        found.append(best)
        if level:
            waiting = tables.put(waiting.join(best, mine, "left_anti"))
            if not waiting.limit(1).count():
                break
    answers = checked(functools.reduce(DataFrame.unionByName, found))
    rest = [c for c in left.columns if c != left_key]
    best = left.join(answers, mine).repartition(left_key).groupBy(left_key).agg(F.min(F.struct(F.col(f"__best.{into}").alias(into), F.col(f"__best.{right_key}").alias(right_key), *rest, *[F.col(f"__best.{c}").alias(c) for c in others])).alias("best"))
    return best.select(left_key, "best.*")


def places_in_radius(places: DataFrame, lat: float, lon: float, km: float, at: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """Places within km of one origin, with the distance: a filter, whose box reaches the scan."""
    la, lo = F.col(at[0]), F.col(at[1])
    box = in_bbox(la, lo, F.lit(float(lat)), F.lit(float(lon)), F.lit(float(km)), pad=0.01)
    return places.filter(box).withColumn("km", haversine_km(F.lit(float(lat)), F.lit(float(lon)), la, lo)).filter(F.col("km") <= km)


def rings(points: DataFrame, key: str, km: float, corners: int = 72, at: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """(key, i, ring_lat, ring_lon): a ring of km around each point, from north through east, its first corner repeated at the end.

    Points are dealt out by key before they become corners, of which a small file makes very many.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.select(key, *at).repartition(tasks, key)
    rows = dealt.select(key, *at, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(corners).cast("long"))).alias("i"))
    lat, lon = destination(F.col(at[0]), F.col(at[1]), F.lit(float(km)), F.col("i") * F.lit(360.0 / corners))
    return rows.select(key, "i", lat.alias("ring_lat"), lon.alias("ring_lon"))
