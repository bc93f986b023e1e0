"""Downscaling by blocks, bootstrap by arrays, name searches, overviews and gates against brute force."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from townmeter.operators import explore, extras, grid, validate


def field(draw, axes):
    nodes = [(i * axes.n_lon + j, draw.random() < 0.8, draw.uniform(0, 900)) for i in range(axes.n_lat) for j in range(axes.n_lon)]
    places = [(f"p{k}", draw.uniform(axes.lat0 + axes.dlat * (axes.n_lat + 1), axes.lat0 + 0.1), draw.uniform(axes.lon0 - 0.1, axes.lon0 + axes.dlon * (axes.n_lon + 1)), draw.choice([None, 300.0])) for k in range(150)]
    return nodes, places


@pytest.mark.parametrize("block", [1, 2, 3, 7, 32])
def test_blocks_give_the_same_days(spark, monkeypatch, block):
    monkeypatch.setattr(grid, "BLOCK", block)
    draw = random.Random(block)
    axes = grid.Axes(46.0, -0.1, 15, 1.0, 0.1, 11)
    nodes, places = field(draw, axes)
    days = [(n, dt.date(2020, 7, d), draw.choice([None, float("nan")]) if draw.random() < 0.01 else 280 + draw.uniform(0, 30), 275 + draw.uniform(0, 9)) for n, *_ in nodes for d in (1, 2)]
    at, daily = spark.createDataFrame(places, "insee string, lat double, lon double, elevation double"), spark.createDataFrame(days, "node long, day date, tmax float, tmin float")
    weights = grid.corner_weights(at, spark.createDataFrame(nodes, "node long, is_land boolean, elev double"), axes, "insee")
    heights = grid.place_elevations(weights, at, "insee", "elevation")
    whole = sorted(map(tuple, grid.downscale(daily, weights, heights, "insee").collect()))
    assert sorted(map(tuple, grid.downscale(daily, weights, heights, "insee", n_lon=axes.n_lon).collect())) == whole
    assert len(whole) == 2 * heights.count() > 100 and any(t is None for _, _, t, _ in whole)


def test_one_day_is_dealt_to_many_tasks(spark):
    axes = grid.Axes(46.0, -0.1, 100, 1.0, 0.1, 100)
    ids = spark.range(axes.n_lat * axes.n_lon).withColumnRenamed("id", "node")
    day = F.date_add(F.lit("2020-07-01").cast("date"), F.floor(F.col("node") / 20_000).cast("int"))
    daily = ids.select("node", day.alias("day"), F.lit(290.0).alias("tmax"), F.lit(280.0).alias("tmin"))
    at = spark.createDataFrame([("p", 45.0, 2.0)], "insee string, lat double, lon double")
    weights = grid.corner_weights(at, ids.select("node", F.lit(True).alias("is_land"), F.lit(0.0).alias("elev")), axes, "insee")
    plan = grid.downscale(daily, weights, grid.place_elevations(weights, at.withColumn("e", F.lit(0.0)), "insee", "e"), "insee", n_lon=axes.n_lon)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(day" in plan and "__block" in plan
    halo = ids.select(F.explode(F.array_distinct(F.array(*[(F.floor(F.greatest(F.floor(F.col("node") / 100) - a, F.lit(0)) / 32) * 100 + F.floor(F.greatest(F.col("node") % 100 - b, F.lit(0)) / 32)) for a in (0, 1) for b in (0, 1)]))).alias("b"))
    assert halo.count() < 1.1 * 10_000 and halo.distinct().count() == 16


def test_bootstrap_equals_drawing(spark):
    draw = random.Random(8)
    rows = [(k, 2000 + y, draw.choice([None, draw.gauss(20, 3)])) for k in range(30) for y in range(25) if draw.random() < 0.8] + [(99, 2001, 5.0), (98, 2003, None)]
    years = sorted({y for _, y, _ in rows})
    picks = [[years[int(hashlib.md5(f"{r}:{s}".encode()).hexdigest()[:8], 16) % len(years)] for s in range(len(years))] for r in range(50)]
    want = {}
    for k in {k for k, *_ in rows}:
        own = {y: v for kk, y, v in rows if kk == k and v is not None}
        means = [np.mean(x) for p in picks if (x := [own[y] for y in p if y in own])]
        if own and means:
            want[k] = tuple(pytest.approx(v) for v in (np.mean(list(own.values())), *np.quantile(means, [0.05, 0.95])))
    df = extras.bootstrap_bands(spark.createDataFrame(rows, "k long, y int, v double"), "k", "y", "v", replicates=50)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange") == 1 == plan.count("ArrowEvalPython")
    assert {r.k: (r.mean, r.low, r.high) for r in df.collect()} == want and 99 in want and 98 not in want


NAMES = ["Évreux", "Evron", "evry", "Éze", "Ézy", "Œuilly", "Saint-Étienne", "Saint-Cloud", "Lyon", "L", "", None]


def test_name_searches_equal_single_ones(spark):
    draw = random.Random(2)
    places = spark.createDataFrame([(f"{i:03d}", draw.choice(NAMES), draw.choice([None, 0, 10, 1000, draw.randint(0, 99)])) for i in range(300)], "insee string, name string, population long")
    asked = [" EV", "év", "e", "saint-É", "saint", "Saint-Étienne and more", "œ", "Œu", "  ", None, "lyon", "ev", "x y"]
    got = {}
    for r in explore.search_names(spark.createDataFrame(list(enumerate(asked)), "search_id int, query string"), places).collect():
        got.setdefault(r.search_id, []).append((r["rank"], r.insee, r.name, r.population))
    for i, q in enumerate(asked):
        want = [(k + 1, r.insee, r.name, r.population) for k, r in enumerate(explore.find_names(places, q).collect())] if q else []
        assert sorted(got.get(i, [])) == want
    assert explore.search_names(spark.createDataFrame([], "search_id int, query string"), places).count() == 0


def test_every_level_is_the_direct_mean(spark):
    draw = random.Random(3)
    rows = [(draw.uniform(-5, 5), draw.uniform(-5, 5), draw.choice([None, draw.random()])) for _ in range(400)] + [(None, 1.0, 1.0), (4.99, -4.99, None)]
    df = spark.createDataFrame(rows, "lat double, lon double, v double")
    got = {(r.level, r.cell_y, r.cell_x): (r.places, r.mean_v) for r in extras.overview_pyramid(df, 0.5, 5, ["v"]).collect()}
    want = {}
    for k in range(5):
        for r in extras.cell_overview(df.filter("lat is not null"), 0.5 * 2**k, ["v"]).collect():
            want[k, r.cell_y, r.cell_x] = (r.places, r.mean_v if r.mean_v is None else pytest.approx(r.mean_v))
    assert got == want


def test_terrain_gates(spark):
    df = spark.createDataFrame([(100.0, 10, 12.0), (150.0, 10, 7.0), (700.0, 3, 3.0), (700.0, None, 3.0), (1200.0, 0, 9.0)], "alti double, model long, seen double")
    got = {r.gate: (r.stations, r.value, r.passed) for r in validate.terrain_gates(df, "model", "seen", 2.5).collect()}
    assert got == {"hot days <200 m": (2, 2.5, True), "hot days 600–1000 m": (1, 0.0, True), "hot days ≥1000 m": (1, 9.0, False)}
