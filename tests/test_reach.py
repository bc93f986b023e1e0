"""Searches in circles, analogs and warming levels against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from townmeter.operators import analogs, explore, extras, near, pyramid


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


PLACE = "insee string, lat double, lon double, summer_tmax double, population long, hosp boolean, station boolean"
SEARCH = "search_id long, origin_key string, origin_lat double, origin_lon double, origin_summer double, km double, people double"


def brute(searches, places, top=15):
    out = {}
    for s, _, la, lo, _, reach, people in searches:
        if None in (la, lo, reach, people):
            continue
        near = [p for p in places if None not in p[1:4] and km(la, lo, p[1], p[2]) <= reach and ((p[5] and p[6]) if people == -1 else (p[4] or 0) >= people)]
        best = sorted(near, key=lambda p: (p[3], p[0]))[:top]
        if best:
            out[s] = [(i + 1, p[0]) for i, p in enumerate(best)]
    return out


def by_search(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.search_id, []).append((r["rank"], r.insee))
    return {s: sorted(v) for s, v in got.items()}


def scattered(draw, n, lat, lon):
    return [(f"{i:05d}", draw.uniform(*lat), draw.uniform(*lon), round(draw.uniform(10, 30), 1), draw.choice([None, 0, 500, 1000, 7000, 150000]), draw.random() < 0.3, draw.choice([True, False, None])) for i in range(n)]


def asked(draw, n, lat, lon, reach):
    return [(i, "x", draw.uniform(*lat), draw.uniform(*lon), 20.0, draw.uniform(*reach), draw.choice([-1.0, -0.5, 0.0, 300.0, 1000.0, 5000.0, 70000.0, 1e7])) for i in range(n)]


@pytest.mark.parametrize("lat, lon, reach", [((42, 51), (-5, 9), (25, 500)), ((-90, 90), (-180, 180), (500, 9000)), ((70, 90), (-180, 180), (50, 1500)), ((-3, 3), (176, 180), (30, 400)), ((44, 44.2), (3, 3.2), (0, 12))])
def test_circles_anywhere(spark, lat, lon, reach):
    draw = random.Random(hash((lat, lon)))
    places = scattered(draw, 600, lat, lon)
    if lon == (176, 180):
        places = [(k, la, lo if i % 2 else lo - 356, *rest) for i, (k, la, lo, *rest) in enumerate(places)]
    searches = asked(draw, 40, lat, lon, reach)
    got = explore.coolest(spark.createDataFrame(searches, SEARCH), spark.createDataFrame(places, PLACE))
    assert by_search(got) == brute(searches, places)


def test_open_rim_cells_go_down_to_places(spark):
    """Cool places crowd behind the rim: their cells' lists hold nothing of the circle; many share one point."""
    draw = random.Random(5)
    far = [(f"a{i:04d}", 45.0 + draw.uniform(0.30, 0.34), 3.0, 10.0, 0, True, True) for i in range(200)]
    same = [(f"b{i:04d}", 45.25, 3.0, 15.0, i, True, True) for i in range(60)]
    inner = [(f"c{i:04d}", 45.0 + draw.uniform(-0.05, 0.05), 3.0, 20.0 + i % 7, 0, True, True) for i in range(30)]
    places = far + same + inner
    searches = [(i, "x", 45.0, 3.0, 20.0, r, n) for i, (r, n) in enumerate((r, n) for r in (27.0, 28.5, 32.0, 34.0, 40.0) for n in (-1.0, 0.0, 50.0))]
    assert by_search(explore.coolest(spark.createDataFrame(searches, SEARCH), spark.createDataFrame(places, PLACE))) == brute(searches, places)


def test_odd_searches_and_empty_tables(spark):
    places = [("a", 45.0, 3.0, 20.0, None, None, None), ("b", None, 3.0, 1.0, 5, True, True), ("c", 45.0, 3.0, None, 5, True, True), ("d", 45.0, 3.0, 20.0, 0, True, True)]
    searches = [(1, "x", 45.0, 3.0, 20.0, 0.0, 0.0), (2, "x", 45.0, 3.0, None, None, 0.0), (3, "x", None, 3.0, 20.0, 50.0, 0.0), (4, "x", 45.0, 3.0, 20.0, 50.0, None), (5, "x", 45.0, 3.0, 20.0, -1.0, 0.0), (6, "x", 45.0, 3.0, 20.0, 50.0, -1.0)]
    s, p = spark.createDataFrame(searches, SEARCH), spark.createDataFrame(places, PLACE)
    assert by_search(explore.coolest(s, p)) == {1: [(1, "a"), (2, "d")], 6: [(1, "d")]}
    assert explore.coolest(s.limit(0), p).count() == 0 and explore.coolest(s, p.limit(0)).count() == 0


def test_lists_hold_the_coolest_of_each_cell(spark):
    from townmeter.sources.scratch import Tables

    places = scattered(random.Random(1), 500, (44, 46), (2, 5))
    lists = pyramid.cool_lists(spark.createDataFrame(places, PLACE), Tables(spark, "test"), "insee", "summer_tmax", 4).collect()
    assert {r.level for r in lists} == set(range(pyramid.COARSEST, pyramid.FINEST + 1))
    for level in (3, 9, 13):
        want = {}
        for p in sorted(places, key=lambda p: (p[3], p[0])):
            side = 360 / 2**level
            want.setdefault((math.floor((p[1] + 90) / side), math.floor((p[2] + 180) / side)), []).append(p[0])
        assert {(r.y, r.x): [x.key for x in r.list] for r in lists if r.level == level and r["class"] == pyramid.ALL} == {k: v[:4] for k, v in want.items()}


def test_pairs_beyond_the_latitude_are_an_error(spark):
    a = spark.createDataFrame([(1, 70.0, 0.0)], "i int, lat double, lon double")
    b = spark.createDataFrame([(2, 60.1, 9.0)], "j int, lat2 double, lon2 double")
    with pytest.raises(Exception, match="latitude beyond"):
        near.pairs_within(a, b, 40.0, 40.0, 60.0, right_at=("lat2", "lon2")).collect()


def test_pairs_at_the_highest_latitude(spark):
    draw = random.Random(2)
    left = [(i, draw.uniform(55, 60), draw.uniform(0, 20)) for i in range(60)]
    right = [(i, draw.uniform(53, 64), draw.uniform(-9, 29)) for i in range(200)]
    got = near.pairs_within(spark.createDataFrame(left, "i int, lat double, lon double"), spark.createDataFrame(right, "j int, lat2 double, lon2 double"), 500.0, 500.0, 60.0, right_at=("lat2", "lon2"))
    assert sorted((r.i, r.j) for r in got.select("i", "j").collect()) == sorted((a[0], b[0]) for a in left for b in right if km(*a[1:], *b[1:]) <= 500)


def brute_analogs(projected, present):
    whole = [r for r in present if None not in r[1:]]
    n, d = len(whole), len(whole[0]) - 1
    mean = [sum(r[1 + i] for r in whole) / n for i in range(d)]
    spread = [math.sqrt(sum((r[1 + i] - mean[i]) ** 2 for r in whole) / n) or 1.0 for i in range(d)]
    out = {}
    for q in projected:
        if None in q[1:]:
            continue
        far = [(round(math.sqrt(sum(((q[1 + i] - r[1 + i]) / spread[i]) ** 2 for i in range(d))), 9), r[0]) for r in whole if r[0] != q[0]]
        if far:
            out[q[0]] = min(far)
    return out


@pytest.mark.parametrize("columns, leaf", [(1, 40), (2, 8), (5, 20)])
def test_analogs_equal_brute_force(spark, monkeypatch, columns, leaf):
    monkeypatch.setattr(analogs, "LEAF", leaf)
    draw = random.Random(columns)
    names = [f"v{i}" for i in range(columns)]
    schema = "k string, " + ", ".join(f"{c} double" for c in names)
    point = lambda centre, width: tuple(round(draw.gauss(centre, width), 1) for _ in names)
    dense, wide = [(f"d{i:03d}", *point(5, 0.2)) for i in range(200)], [(f"w{i:03d}", *point(0, 50)) for i in range(100)]
    present = dense + wide + [("same1", *[5.0] * columns), ("same2", *[5.0] * columns), ("same0", *[5.0] * columns), ("none", *[None] * columns)]
    projected = [(k, *(v and v + 1.0 for v in rest)) for k, *rest in present[::2]] + [("same0", *[5.0] * columns), ("far", *[1e4] * columns), ("gone", *[None] * columns)]
    projected = list({p[0]: p for p in projected}.values())
    got = analogs.climate_analogs(spark.createDataFrame(projected, schema), spark.createDataFrame(present, schema), "k", names).collect()
    assert {r.k: (pytest.approx(r.distance, abs=2e-9), r.analog) for r in got} == brute_analogs(projected, present)


def test_analogs_of_few_places(spark):
    one = spark.createDataFrame([("a", 1.0, 2.0)], "k string, x double, y double")
    two = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0)], "k string, x double, y double")
    assert analogs.climate_analogs(one, one, "k", ["x", "y"]).collect() == []
    assert [tuple(r) for r in analogs.climate_analogs(one, two, "k", ["x", "y"]).collect()] == [("a", "b", 0.0)]
    assert analogs.climate_analogs(one, one.limit(0), "k", ["x", "y"]).collect() == [] == analogs.climate_analogs(one.limit(0), two, "k", ["x", "y"]).collect()


def test_warming_levels(spark):
    rows = [(m, p, y, 10.0 + p + rise * max(0, y - 2005) + (0.5 * p * (y > 2040))) for m, rise in (("hot", 0.1), ("mild", 0.04), ("still", 0.0)) for p in (0, 1) for y in range(1991, 2101)]
    df = spark.createDataFrame(rows, "model string, place long, yr int, v double")
    crossed = {(r.model, r.level): (r.first_year, r.last_year, r.warming) for r in extras.warming_crossings(df, "model", "yr", "v").collect()}
    mean = lambda m, a, b, ps=(0, 1): sum(v for mm, p, y, v in rows if mm == m and p in ps and a <= y <= b) / (len(ps) * (b - a + 1))
    want = {}
    for m in ("hot", "mild", "still"):
        for level in (2.0, 2.7, 4.0):
            for y in range(1991, 2082):
                if (w := mean(m, y, y + 19) - mean(m, 1991, 2020)) >= level:
                    want[m, level] = (y, y + 19, pytest.approx(w))
                    break
    assert crossed == want and not any(m == "still" for m, _ in want) and ("mild", 4.0) not in want
    got = {(r.place, r.level): (r.models, r.delta, r.least, r.most) for r in extras.warming_levels(df, "model", "place", "yr", "v").collect()}
    for (place, level), (models, delta, least, most) in got.items():
        own = [mean(m, *want[m, level][:2], (place,)) - mean(m, 1991, 2020, (place,)) for m in ("hot", "mild") if (m, level) in want]
        assert (models, delta, least, most) == (len(own), pytest.approx(sum(own) / len(own)), pytest.approx(min(own)), pytest.approx(max(own)))
    assert set(got) == {(p, level) for p in (0, 1) for level in (2.0, 2.7, 4.0)}
    short = df.filter("yr >= 2005")
    assert extras.warming_crossings(short, "model", "yr", "v").count() == 0
    assert extras.warming_crossings(df.filter("yr != 2050"), "model", "yr", "v").filter(F.col("first_year").between(2031, 2050)).count() == 0
    with pytest.raises(ValueError):
        extras.warming_crossings(df, "model", "yr", "v", span=10)
