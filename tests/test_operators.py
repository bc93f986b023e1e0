"""Small fixtures with known results."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from townmeter.functions import climate, geo, labels, scores
from townmeter.operators import dataset, explore, extras, grid, hazards, incremental, indices, livability, near, normalise, referential, validate
from townmeter.sources import files

DAY = dt.timedelta(days=1)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def series(spark, years, changes=(), extra=()):
    """Daily rows with 25 / 12 / 0 and changes (year index day, column, value)."""
    rows = []
    for y in years:
        d = dt.date(y, 1, 1)
        while d.year == y:
            rows.append([d, 25.0, 12.0, 0.0])
            d += DAY
    rows += [list(r) for r in extra]
    for i, c, v in changes:
        rows[i][c] = v
    return spark.createDataFrame([("a", *r) for r in rows], "insee string, day date, tmax double, tmin double, precip double")


def hot(spark):
    changes = [(i, 1, 31.0) for i in range(10, 20)] + [(i, 1, 36.0) for i in (100, 101, 102, 105, 415, 416)] + [(i, 1, 31.0) for i in range(385, 391)]
    extra = [(dt.date(2023, 1, 1) + DAY * i, 40.0 if i < 5 else 25.0, 12.0, 0.0) for i in range(10)]
    return series(spark, (2021, 2022), changes, extra)


@pytest.mark.parametrize(("threshold", "want"), [(30, 11.0), (35, 3.0), (31, 11.0), (31.5, 3.0)])
def test_day_rate_skips_short_years(spark, threshold, want):
    r = indices.day_rate(hot(spark), ["insee"], "tmax", threshold).first()
    assert (r.value, r.years) == (want, 2)


def test_day_rate_drops_years_with_gaps(spark):
    s = series(spark, (2021, 2022), [(i, 1, None) for i in range(100)] + [(i, 1, 31.0) for i in range(400, 410)])
    r = indices.day_rate(s, ["insee"], "tmax", 30).first()
    assert (r.value, r.years) == (10.0, 1)
    r = indices.day_rate(series(spark, (2021,), [(i, 1, None) for i in range(365)]), ["insee"], "tmax", 30).first()
    assert (r.value, r.years) == (None, 0)


def layer(spark, s, **how):
    return indices.layer_indices(indices.yearly(s, ["insee"], **how), ["insee"], {"all": (2000, 2030)}).first()


def test_tropical_nights_are_inclusive(spark):
    s = series(spark, (2021, 2022), [(i, 2, 21.0) for i in range(20)] + [(i, 2, 20.0) for i in range(365, 375)])
    assert layer(spark, s).tropical_nights == 15.0


def test_cooling_degree_days(spark):
    s = series(spark, (2021, 2022), [(i, 1, 28.0) for i in range(365)] + [(i, 2, 18.0) for i in range(365)] + [(i, 1, 20.0) for i in range(365, 730)] + [(i, 2, 10.0) for i in range(365, 730)])
    assert layer(spark, s).cdd18 == 912.5


def test_summer_mean_drops_summers_with_gaps(spark):
    first = (dt.date(2021, 6, 1) - dt.date(2021, 1, 1)).days
    changes = [(first + 365 * y + i, 1, 30.0) for y in (0, 1) for i in range(92)] + [(first + 365 + i, 1, None) for i in range(10)]
    r = layer(spark, series(spark, (2021, 2022), changes))
    assert (r.summer_tmax, r.summers) == (30.0, 1)


def test_rain_and_gusts(spark):
    s = series(spark, (2021, 2022), [(200, 3, 120.5), (50, 3, 40.0), (60, 3, 55.0), (600, 3, 41.0), (250, 3, 120.5)])
    r = layer(spark, s)
    assert (r.rx1day, r.rx1day_date, r.rain40, r.gust100) == (120.5, dt.date(2021, 7, 20), 2.5, None)
    windy = s.withColumn("gust", F.when(F.dayofyear("day") <= 2, 110.0).otherwise(50.0))
    assert layer(spark, windy, gust="gust").gust100 == 2.0


def test_spells_cross_years_only_in_the_absolute_one(spark):
    r = indices.longest_spells(hot(spark), ["insee"], "tmax", 35).first()
    assert (r.longest, r.mean_longest, r.years) == (5, 2.5, 2)
    ends = series(spark, (2021, 2022), [(i, 1, 36.0) for i in range(360, 370)])
    r = indices.longest_spells(ends, ["insee"], "tmax", 35).first()
    assert (r.longest, r.mean_longest) == (10, 5.0)


def test_a_null_breaks_a_spell_and_a_missing_row_does_not(spark):
    s = series(spark, (2021,), [(10, 1, 36.0), (11, 1, 36.0), (12, 1, None), (13, 1, 36.0)])
    assert indices.longest_spells(s, ["insee"], "tmax", 35).first().longest == 2
    gone = series(spark, (2021,), [(10, 1, 36.0), (11, 1, 36.0), (12, 1, 36.0), (13, 1, 36.0)]).filter("dayofyear(day) != 13")
    assert indices.longest_spells(gone, ["insee"], "tmax", 35).first().longest == 3
    assert indices.longest_spells(gone, ["insee"], "tmax", 35, calendar=True).first().longest == 2


def test_no_full_year_means_no_spell(spark):
    assert indices.longest_spells(series(spark, (), extra=[(dt.date(2021, 1, 1), 40.0, 1.0, 0.0)]), ["insee"], "tmax", 35).count() == 0


def test_layer_gate(spark):
    rows = spark.createDataFrame([("a", "normals", 1.0, 19), ("b", "normals", 1.0, 20), ("a", "recent", 1.0, 1)], "insee string, layer string, x double, summers long")
    got = {(r.insee, r.layer): r.x for r in indices.gate_layer(rows, "normals", ["x"]).collect()}
    assert got == {("a", "normals"): None, ("b", "normals"): 1.0, ("a", "recent"): 1.0}


def test_series_violations(spark):
    rows = [("dup", ["2021-01-01", "2021-01-01"], [1.0, 2.0]), ("down", ["2021-01-02", "2021-01-01"], [1.0, 2.0]), ("short", ["2021-01-01"], [1.0, 2.0]), ("form", ["2021/01/01"], [1.0]), ("good", ["2021-01-01", "2021-01-02"], None), ("none", [], [])]
    df = spark.createDataFrame(rows, "k string, days array<string>, v array<double>")
    assert sorted(tuple(r) for r in indices.series_violations(df, "k", "days", ["v"]).collect()) == [("down", "not ascending"), ("dup", "not ascending"), ("form", "bad date"), ("short", "length of v")]


def pct(spark, values):
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "indicator string, i int, value double")
    return [r.pct for r in normalise.percentile_ranks(df).orderBy("i").collect()]


def test_percentile_ranks(spark):
    assert pct(spark, [10.0, 20.0, 30.0, 40.0, 50.0]) == [0, 25, 50, 75, 100]
    assert pct(spark, [1.0, 2.0, 2.0, 3.0]) == [0, 50, 50, 100]
    assert pct(spark, [10.0, None, 20.0]) == [0, None, 100]
    assert pct(spark, [5.0]) == [50]
    assert pct(spark, [50.0, 10.0, 30.0]) == [100, 0, 50]


def test_winsorise(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    r = normalise.winsorise(df, "v", 0.05, 0.95).agg(F.min("winsorised").alias("a"), F.max("winsorised").alias("b")).first()
    assert (r.a, r.b) == (5.0, 95.0)
    df = spark.createDataFrame([(float(i),) for i in range(1, 100)] + [(100000.0,)], "v double")
    assert 99 <= normalise.winsorise(df, "v").agg(F.max("winsorised")).first()[0] < 1100
    with pytest.raises(ValueError):
        normalise.quantiles(df, "v", [1.5])


@pytest.mark.parametrize(("subs", "want", "coverage"), [
    ([(20.0, 1.0), (60.0, 1.0)], 60.0, 1.0), ([(0.0, 3.0), (100.0, 1.0)], 75.0, 1.0), ([(40.0, 1.0), (None, 1.0)], None, 0.5),
    ([(30.0, 1.0), (60.0, 1.0), (None, 1.0)], 55.0, 2 / 3), ([], None, 0.0),
])
def test_composite_score(spark, subs, want, coverage):
    df = spark.createDataFrame([(subs,)], "s array<struct<burden: double, weight: double>>").select(scores.composite_score(F.col("s")).alias("r")).first().r
    assert df.score == want and df.coverage == pytest.approx(coverage)


def test_negative_weight_fails(spark):
    with pytest.raises(Exception, match="negative weight"):
        spark.createDataFrame([([(1.0, -1.0)],)], "s array<struct<burden: double, weight: double>>").select(scores.composite_score(F.col("s"))).collect()


def test_haversine_and_box(spark):
    lit = F.lit
    assert 388 < value(spark, geo.haversine_km(lit(48.8566), lit(2.3522), lit(45.764), lit(4.8357))) < 396
    assert value(spark, geo.haversine_km(lit(1.0), lit(2.0), lit(1.0), lit(2.0))) == 0
    assert value(spark, geo.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) == pytest.approx(111.19, abs=0.01)
    assert value(spark, geo.in_bbox(lit(45.0), lit(1.2), lit(45.0), lit(0.0), lit(100.0)))
    assert not value(spark, geo.in_bbox(lit(0.0), lit(1.2), lit(0.0), lit(0.0), lit(100.0)))


def test_downscaling_functions(spark):
    b = lambda fx, fy: value(spark, climate.bilinear(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0), F.lit(fx), F.lit(fy)))
    assert [b(0.0, 0.0), b(1.0, 0.0), b(0.0, 1.0), b(1.0, 1.0), b(0.5, 0.5)] == [1, 2, 3, 4, 2.5]
    for bad in (1.1, -0.1, float("nan")):
        with pytest.raises(Exception, match="fractions"):
            b(bad, 0.5)
    assert value(spark, climate.lapse_adjust(F.lit(30.0), F.lit(500.0), climate.LAPSE_TMAX)) == pytest.approx(26.75)
    assert value(spark, climate.lapse_adjust(F.lit(30.0), F.lit(-200.0), climate.LAPSE_TMAX)) == pytest.approx(31.3)
    assert value(spark, climate.elevation_confident(F.lit(300.0), F.lit(100.0))) and not value(spark, climate.elevation_confident(F.lit(300.1), F.lit(100.0)))


def test_local_days_follow_daylight_saving(spark):
    stamp = lambda s: dt.datetime.fromisoformat(s)
    rows = [("2024-03-30T22:59:00", 1.0), ("2024-03-30T23:00:00", 2.0), ("2024-03-31T21:59:00", 9.0), ("2024-03-31T22:00:00", 3.0), ("2023-12-31T23:00:00", 7.0), ("2024-12-31T23:00:00", 8.0), ("2024-06-01T00:00:00", float("nan"))]
    df = spark.createDataFrame([(1, s, v) for s, v in rows], "node int, s string, t2m double").withColumn("ts", F.to_timestamp("s"))
    got = {str(r.day): (r.tmax, r.tmin) for r in grid.hourly_to_daily(df, year=2024).collect()}
    assert got == {"2024-03-30": (1.0, 1.0), "2024-03-31": (9.0, 2.0), "2024-04-01": (3.0, 3.0), "2024-01-01": (7.0, 7.0), "2024-06-01": (None, None)}
    assert stamp("2024-01-01")


def test_sea_corners_are_masked(spark):
    axes = grid.Axes(1.0, -1.0, 2, 0.0, 1.0, 2)
    nodes = spark.createDataFrame([(0, True, 100.0), (1, False, 0.0), (2, True, 300.0), (3, True, 500.0)], "node int, is_land boolean, elev double")
    places = spark.createDataFrame([("mid", 0.5, 0.5, 400.0), ("sea", 1.0, 1.0, None), ("out", 9.0, -9.0, None)], "insee string, lat double, lon double, elevation double")
    w = grid.corner_weights(places, nodes, axes, "insee")
    assert {r.node: round(r.w, 6) for r in w.filter("insee = 'mid'").collect()} == {0: 0.333333, 2: 0.333333, 3: 0.333333}
    assert w.filter("insee = 'sea'").count() == 0
    e = {r.insee: r for r in grid.place_elevations(w, places, "insee", "elevation").collect()}
    assert (e["mid"].grid_m, e["mid"].difference_m, e["mid"].coastal) == (pytest.approx(300.0), pytest.approx(100.0), True)
    assert (e["out"].grid_m, e["out"].difference_m) == (100.0, 0.0)
    days = spark.createDataFrame([(n, dt.date(2020, 1, d), 300.0 if (n, d) != (2, 2) else float("nan"), 290.0) for n in range(4) for d in (1, 2)], "node int, day date, tmax double, tmin double")
    got = {(r.insee, r.day.day): (r.tmax, r.tmin) for r in grid.downscale(days, w, grid.place_elevations(w, places, "insee", "elevation"), "insee").collect()}
    assert got[("mid", 1)] == (pytest.approx(26.2), pytest.approx(16.55)) and got[("mid", 2)][0] is None and got[("out", 2)][0] == pytest.approx(26.85)


def test_decrees_and_registers(spark):
    rows = [("1", "a", "F", "2000-01-01"), ("1", "a", "F", "2000-01-01T00:00"), ("2", "a", "F", "1999-12-31"), ("3", "a", "W", ""), ("4", "a", "F", None), ("5", "b", "other", "2001-01-01"), ("6", "", "F", "2001-01-01"), ("7", "c", None, "2001-01-01")]
    d = spark.createDataFrame(rows, "id string, place string, label string, date string")
    got = {r.place: tuple(r)[1:] for r in hazards.decree_counts(d, "id", "place", "label", "date", ("F",), "W", "D").collect()}
    assert got == {"a": (3, 1, "2000-01-01", 1, 0), "b": (0, 0, None, 0, 0)}
    plans = spark.createDataFrame([("a", "Inondation", None, "", "Prescrit"), ("a", "x", "SUBMERSION", "", "PPR opposable"), ("b", "Séisme", "", "", "Approuvé"), ("c", "inondation", "", "", "autre")], "p string, r1 string, r2 string, r3 string, s string")
    states = hazards.plan_states(plans, "p", ["r1", "r2", "r3"], "s")
    assert {r.place: r.plan for r in states.collect()} == {"a": "approved", "c": None}
    flags = hazards.presence(spark.createDataFrame([("z", "Feu de forêt"), ("y", "autre")], "p string, r string"), "p", wildfire=F.col("r") == hazards.WILDFIRE_LABEL)
    merged = {r.place: r for r in hazards.merge_registers(hazards.decree_counts(d, "id", "place", "label", "date", ("F",), "W", "D"), states, flags).collect()}
    assert set(merged) == {"a", "b", "c", "z"} and merged["z"].wildfire and merged["z"].floods == 0 and merged["z"].last_flood is None and not merged["a"].wildfire


def test_services_and_trend(spark):
    f = spark.createDataFrame([("a", "D101"), ("a", "C301"), ("a", "C302"), ("b", "X"), ("b", "D201")], "DEPCOM string, TYPEQU string")
    got = {r.place: r for r in livability.facility_counts(f).collect()}
    assert (got["a"].hospital, got["a"].lycee, got["a"].gp) == (1, 2, None) and got["b"].gp == 1
    p = spark.createDataFrame([("a", "2017", 100.0), ("a", "2021", 110.0), ("b", "2017", 0.0), ("b", "2021", 5.0)], "codgeo string, annee_rp string, pmun double")
    assert [tuple(r) for r in livability.population_trend(p).collect()] == [("a", 2.41)]


def test_nearest_keeps_the_smaller_key_on_ties(spark):
    left = spark.createDataFrame([(1, 45.0, 0.0, 100.0), (2, 10.0, 0.0, 0.0)], "s int, lat double, lon double, alti double")
    right = spark.createDataFrame([("b", 45.05, 0.0, 100.0), ("a", 44.95, 0.0, 100.0), ("c", 45.0, 0.0, 900.0), ("d", 45.0, 0.0, None)], "p string, place_lat double, place_lon double, place_m double")
    got = validate.match_stations(left, right, "s", "p").collect()
    assert [(r.s, r.p) for r in got] == [(1, "a")]


def test_pairs_equal_a_full_comparison(spark):
    pts = [(i, 42 + (i * 37 % 900) / 100, -1 + (i * 53 % 800) / 100) for i in range(300)]
    a = spark.createDataFrame(pts, "i int, lat double, lon double")
    b = a.toDF("j", "lat2", "lon2")
    got = near.pairs_within(a, b, 40.0, 40.0, 60.0, right_at=("lat2", "lon2")).select("i", "j")
    want = a.crossJoin(b).filter(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= 40).select("i", "j")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_permalinks(spark):
    urls = ["https://x/?o=2A004&r=25&p=-1", "https://x/?r=24.9&p=-2", "https://x/", "https://x/?r=Infinity&p=NaN", "https://x/?o=&r=500&p=0", None, "no url"]
    got = [(r.origin, r.km, r.people) for r in explore.parse_permalinks(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")).orderBy("i").collect()]
    assert got[:4] == [("2A004", 25.0, -1.0), ("34172", 150.0, 1000.0), ("34172", 150.0, 1000.0), ("34172", 150.0, 1000.0)] and got[4][1:] == (500.0, 0.0)
    assert got[5] == ("34172", 150.0, 1000.0) and got[6] == ("34172", 150.0, 1000.0)


def test_labels(spark):
    assert [value(spark, labels.round_up(F.lit(x))) for x in (2.5, -2.5)] == [3.0, -2.0]
    assert value(spark, labels.plain(F.lit("Évreux Œuvre"))) == "evreux œuvre"
    assert [value(spark, labels.department(F.lit(x))) for x in ("2A004", "97411", "34172")] == ["2A", "974", "34"]
    bands = [value(spark, labels.tie_band(F.lit(v), F.lit(25.0), F.lit(False))) for v in (25.4, 24.0, 23.0, 26.0, 27.0)]
    assert bands == ["similar", "cooler", "clearly cooler", "warmer", "clearly warmer"]
    assert [value(spark, labels.elevation_band(F.lit(m))) for m in (199.9, 200.0, 999.0, 1000.0)] == ["<200 m", "200–600 m", "600–1000 m", "≥1000 m"]


def test_referential(spark, tmp_path):
    point = lambda lon, lat: {"type": "Point", "coordinates": [lon, lat]}
    raw = [{"nom": "A", "code": "01001", "codeDepartement": "01", "centre": point(1, 45), "mairie": point(1.5, 45.5), "population": 10}, {"nom": "B", "code": "2A004", "codeDepartement": "2A", "centre": point(8, 41)}, {"nom": "C", "code": "3", "codeDepartement": "3"}]
    (tmp_path / "raw.json").write_text(json.dumps(raw))
    df = files.read_raw_places(spark, str(tmp_path / "raw.json"))
    got = {r.insee: (r.lat, r.lon, r.coord_source, r.population) for r in referential.ingest(df).collect()}
    assert got == {"01001": (45.5, 1.5, "mairie", 10), "2A004": (41.0, 8.0, "centre", None)}
    heights = spark.createDataFrame([(45.5000001, 1.5, 200.0)], "lat double, lon double, height double")
    c = referential.ingest_counts(referential.attach_elevation(referential.to_places(df), heights)).first()
    assert tuple(c) == (2, 1, 1, 1)


def test_registers_are_read_with_quotes(spark, tmp_path):
    (tmp_path / "cat_1.csv").write_text("a;b\nold;old\n")
    (tmp_path / "cat_2.csv").write_text(' a ;"b"\n"x;""y""";2\n\n3;\n')
    path = files.latest_file(spark, str(tmp_path), "cat_")
    assert path.endswith("cat_2.csv")
    assert [tuple(r) for r in files.read_register(spark, path, ["a", "b"]).collect()] == [('x;"y"', "2"), ("3", None)]
    with pytest.raises(ValueError):
        files.read_register(spark, path, ["missing"])
    with pytest.raises(FileNotFoundError):
        files.latest_file(spark, str(tmp_path), "none")


def test_stations_from_two_files(spark, tmp_path):
    head = "NUM_POSTE;NOM_USUEL;LAT;LON;ALTI;AAAAMMJJ;TX;TN\n"
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write(head + " 1 ;S;45.0;1.0;100;20200701;30.5;21\n1;S;45.0;1.0;100;20200702;;19\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write(head + "1;S;45.0;1.0;100;20200801;32.5;\n")
    a = validate.station_aggregates(files.read_stations(spark, [str(tmp_path / "a.csv.gz"), str(tmp_path / "b.csv.gz")])).first()
    assert (a.summer_sum, a.summer_days, a.tropical, a.nights, a.name) == (63.0, 2, 1, 2, "S")


def test_series_files_round_trip(spark, tmp_path):
    data = {"meta": {"insee": "01001", "name": "A", "dept": "01"}, "daily": {"time": ["2020-01-01", "2020-01-02"], "temperature_2m_max": [1.234, None], "temperature_2m_min": [0.5, 0.25]}}
    (tmp_path / "s.json").write_text(json.dumps(data))
    df = files.read_series(spark, str(tmp_path / "s.json"))
    assert [(r.insee, str(r.day), r.tmax, r.tmin, r.precip) for r in df.orderBy("pos").collect()] == [("01001", "2020-01-01", 1.234, 0.5, None), ("01001", "2020-01-02", None, 0.25, None)]
    files.write_series(df.drop("pos"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("tmax is not null").first().tmax == 1.23


def test_export_round_trip(spark, tmp_path):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(
        F.lit("01").alias("insee"), F.lit('a "b", c').alias("name"), F.lit("01").alias("dept"), F.lit(12.5).alias("km"), none.alias("elevation_m"), F.lit(5).alias("population"), F.lit(24.5).alias("summer_tmax"), F.lit(-1.25).alias("delta"),
        *[none.alias(c) for c in ("tropical_nights", "days35", "cdd18", "heat_pct", "flood_pct")], F.lit(0).alias("floods"), F.lit(None).cast("string").alias("last_flood"), F.lit("approved").alias("plan"),
        *[F.lit(c == "clay").alias(c) for c in ("wildfire", "clay", "coastal", "hosp", "station")],
    )
    explore.write_export(explore.export_rows(row).coalesce(1), str(tmp_path / "x"))
    text = next((tmp_path / "x").glob("*.csv")).read_text().splitlines()
    assert len(text[0].split(",")) == 21 and text[1].startswith('01,"a ""b"", c",01,13,,5,24.5,-1.') and text[1].endswith("approved,0,1,0,0,0")


def test_resume_writes_only_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "p")
    incremental.write_pending(spark.createDataFrame([(1, 2020), (2, 2021)], "v int, year int"), path, "year")
    incremental.write_pending(spark.createDataFrame([(3, 2021)], "v int, year int"), path, "year")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 3]
    t = spark.createDataFrame([(1,), (2,)], "k int")
    assert [r.k for r in incremental.pending(t, t.filter("k = 1"), ["k"]).collect()] == [2]
    assert incremental.pending(t, t, ["k"], force=True).count() == 2


def test_gate_and_assembly(spark):
    m = spark.createDataFrame([("a", 8, 25.0), ("b", 7, 25.0), ("c", 9, None), ("d", 9, 20.0), ("x", 9, 20.0)], "insee string, summers long, summer_tmax double")
    p = spark.createDataFrame([(k, 1.0) for k in "abcd"], "insee string, lat double")
    kept = dataset.gate_places(m, p)
    assert sorted(r.insee for r in kept.filter("kept").collect()) == ["a", "d"]
    h = spark.createDataFrame([("a", 3, 1, "2001")], "place string, floods long, floods_2000 long, last_flood string")
    s = spark.createDataFrame([("d", 2, None)], "place string, hospital long, gp long")
    got = {r.insee: (r.floods, r.last_flood, r.hosp, r.gp) for r in dataset.assemble(kept.filter("kept").drop("kept"), p, h, s).collect()}
    assert got == {"a": (3, "2001", False, 0), "d": (0, None, True, 0)}
    unknown = {r.insee: (r.floods, r.hosp) for r in dataset.assemble(kept.filter("kept").drop("kept"), p, h, s, unknown=True).collect()}
    assert unknown == {"a": (3, None), "d": (None, True)}


def test_warming_overlay(spark):
    rows = [("a", y, 10.0 if y < 2000 else 12.0) for y in range(1980, 2020)]
    df = spark.createDataFrame(rows, "k string, y int, v double")
    normal = spark.createDataFrame([("a", 20.0)], "k string, normal double")
    r = extras.warming_overlay(df, "k", "y", "v", (1980, 1999), (2000, 2019), normal).first()
    assert (r.delta, r.projected) == (2.0, 22.0)
    with pytest.raises(ValueError):
        extras.warming_overlay(df, "k", "y", "v", (1980, 1990), (2000, 2019), normal)
