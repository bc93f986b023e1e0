"""Work and memory that must grow no faster than the input, whatever groups it holds."""

import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import connection
from tests.test_whole_jobs import km
from townmeter.jobs import queries as own
from townmeter.operators import explore, near, validate


def brute_nearest(stations, places, reach, metres):
    best = {}
    for s, lat, lon, alti in stations:
        met = [(km(lat, lon, p_lat, p_lon), p, p_lat, p_lon, m) for p, p_lat, p_lon, m in places if m is not None and alti is not None and p_lat is not None and abs(m - alti) <= metres]
        met = [x for x in met if x[0] <= reach]
        if met:
            best[s] = min(met)
    return best


@pytest.mark.parametrize("spread", [0.0, 0.02, 1.5])
def test_nearest_meets_few_pairs_however_dense(spark, monkeypatch, spread):
    """Copies of one point, a town within 2 km, a country; and rows that find their place at the largest radius only."""
    draw = random.Random(4)
    at = lambda: (45 + round(draw.uniform(0, spread), 4), 5 + round(draw.uniform(0, spread), 4), float(draw.choice([100, 300, 900])))
    places = [(f"{i:05d}", *at()) for i in draw.sample(range(9000), 900)] + [("n1", None, 5.0, 100.0), ("n2", 45.0, 5.0, None), ("far", 44.8, 5.0, 100.0)]
    stations = [(i, *at()) for i in range(500)] + [(600, 44.99, 4.8, 100.0), (601, 44.58, 5.0, 250.0), (602, 44.7, 5.0, 260.0), (603, 45.0, 5.0, None), (604, None, 5.0, 100.0), (605, 44.9, 5.0, 800.0)]
    made, plain = [], near.pairs_within
    monkeypatch.setattr(near, "pairs_within", lambda *a, **b: (made.append((df := plain(*a, **b)).count()), df)[1])
    left, right = spark.createDataFrame(stations, "s int, lat double, lon double, alti double"), spark.createDataFrame(places, "p string, place_lat double, place_lon double, place_m double")
    got = {r.s: (pytest.approx(r.km), r.p, r.place_lat, r.place_lon, r.place_m) for r in validate.match_stations(left, right, "s", "p", km=25.0).collect()}
    want = brute_nearest([s for s in stations if s[1] is not None], places, 25.0, 150.0)
    assert got == want and {600, 605} <= set(want) and 601 in want and 603 not in want
    assert sum(made) < 30 * len(stations)


def test_rows_of_one_file_are_not_sorted_in_one_task(spark, monkeypatch):
    """Places of few points and stations of one task: what is grouped by a least row is dealt out before."""
    held, plain = {}, type(spark.range(0)).groupBy
    stations = spark.range(400).coalesce(1).select(F.col("id").alias("s"), (F.col("id") % 3 * 0.01 + 45).alias("lat"), F.lit(5.0).alias("lon"), F.lit(100.0).alias("alti"))
    places = spark.range(1200).coalesce(1).select(F.format_string("%04d", "id").alias("p"), (F.col("id") % 2 * 0.01 + 45).alias("place_lat"), F.lit(5.0).alias("place_lon"), F.lit(100.0).alias("place_m"))

    def grouped(df, *cols):
        if all(isinstance(c, str) for c in cols) and cols in (("s",), ("place_lat", "place_lon", "place_m")):
            held[cols] = [r["count"] for r in plain(df, F.spark_partition_id()).count().collect()]
        return plain(df, *cols)

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    monkeypatch.setattr(type(stations), "groupBy", grouped)
    try:
        got = {r.s: r.p for r in validate.match_stations(stations, places, "s", "p", km=25.0).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {i: "0000" if i % 3 == 0 else "0001" for i in range(400)}
    assert {k: sum(v) for k, v in held.items()} == {("s",): 400, ("place_lat", "place_lon", "place_m"): 1200}
    assert all(max(v) < sum(v) / 2 for v in held.values())


def copied(spark, path, times):
    """A folder with the tables of stations and places repeated with keys that give the same points."""
    for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("lineitem", "l_suppkey")):
        rows = spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
        rows.crossJoin(spark.range(times).withColumnRenamed("id", "__i")).withColumn(k, (F.col(k) + F.col("__i") * 7200).cast(rows.schema[k].dataType)).drop("__i").write.parquet(f"{path}/{t}.parquet")
    return str(path)


def test_stations_are_summed_without_sorting_their_days(spark):
    rows = [(1, "2020-07-02", 30.0, 21.0, "b", 45.0), (1, "2020-07-01", 32.0, None, "a", 44.0), (1, "2020-01-01", 1.0, 0.0, "b", 45.0), (2, None, 9.0, 25.0, "d", 1.0), (2, "2020-08-01", None, 19.0, "c", 2.0), (3, "2020-08-01", None, None, None, None)]
    df = validate.station_aggregates(spark.createDataFrame(rows, "station int, day string, tx double, tn double, name string, lat double").withColumn("day", F.to_date("day")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("SortAggregate") < plan.index("HashAggregate")
    assert sorted(map(tuple, df.collect())) == [(1, 62.0, 2, 1, 2, "b", 45.0), (2, None, 0, 1, 2, "d", 1.0), (3, None, 0, 0, 0, None, None)]


def test_stations_without_a_place_are_held_once_a_task(spark):
    rows = [(1, "2020-07-02", 30.0, 21.0), (1, "2020-07-01", 32.0, None), (1, "2020-01-01", 1.0, 20.0), (2, None, 9.0, 25.0), (2, "2020-08-01", None, 19.0), (3, "2020-08-01", None, None), (None, "2020-07-01", 5.0, 6.0)]
    df = validate.station_aggregates(spark.createDataFrame(rows, "station int, day string, tx double, tn double").withColumn("day", F.to_date("day")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan
    assert df.columns == ["station", "summer_sum", "summer_days", "tropical", "nights"]
    assert sorted(map(tuple, df.collect()), key=str) == [(1, 62.0, 2, 2, 2), (2, None, 0, 1, 2), (3, None, 0, 0, 0), (None, 5.0, 1, 0, 1)]


@pytest.mark.parametrize("name", ["band_stats", "release_gates", "station_report", "terrain_gates"])
def test_copies_of_stations_and_places_make_no_pairs(spark, tmp_path, monkeypatch, name):
    plain, made = near.pairs_within, {}
    for times in (1, 5):
        monkeypatch.setattr(near, "pairs_within", lambda *a, **b: (made.__setitem__(times, made.get(times, 0) + (df := plain(*a, **b)).count()), df)[1])
        own.queries()[name](spark, copied(spark, tmp_path / str(times), times)).collect()
    assert 0 < made[5] == made[1]


@pytest.mark.parametrize("name", ["station_report", "terrain_gates"])
def test_days_are_summed_before_they_leave_their_task(spark, monkeypatch, name):
    """The exchange holds a station once a task, not its days, whether or not stations are few enough to be broadcast."""
    path, kept = "/root/testdata/sf0.01", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    seen, plain = [], validate.station_indices
    monkeypatch.setattr(validate, "station_indices", lambda df, **a: (seen.append(df), plain(df, **a))[1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own.queries()[name](spark, path)
        got = {r.station_id: (r.summer_sum, r.summer_days, r.tropical, r.nights) for r in seen[0].collect()}
        sent = exchanged(seen[0])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    stations, tasks = spark.read.parquet(f"{path}/supplier.parquet").count(), spark.read.parquet(f"{path}/lineitem.parquet").rdd.getNumPartitions()
    want = connection(path).execute(f"with {own._AGG} select station_id, summer_sum, summer_days, tropical, nights from agg").fetchall()
    assert got == {r[0]: r[1:] for r in want} and len(got) == stations
    assert 0 < sent <= stations * (tasks + 2)


def exchanged(df):
    """Rows that were written to exchanges while df was collected, without adaptive execution."""
    def walk(plan):
        own_rows = plan.metrics().get("shuffleRecordsWritten").get().value() if plan.nodeName() == "Exchange" else 0
        return own_rows + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))
    return walk(df._jdf.queryExecution().executedPlan())


def rows_made(df, node):
    """Rows that the nodes of a name put out while df was collected, without adaptive execution."""
    def walk(plan):
        own_rows = plan.metrics().get("numOutputRows").get().value() if plan.nodeName().startswith(node) else 0
        return own_rows + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))
    return walk(df._jdf.queryExecution().executedPlan())


def test_names_are_cut_before_their_prefixes_are_made(spark):
    places = spark.range(3000).select(F.format_string("%04d", "id").alias("insee"), F.when(F.col("id") % 3 == 0, "Évreux").when(F.col("id") % 3 == 1, "Evry").otherwise("Évreux-Nord").alias("name"), (F.col("id") * 7 % 1000).alias("population"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = explore.prefix_index(places, [2, 4, 6])
        got = {(r.prefix, r["rank"]): r.place.key for r in df.collect()}
        assert rows_made(df, "Generate") == 8 * (3 + 2)  # "evreux" and "evry"
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    rows = [(-r.population, r.insee, r.name.replace("É", "E").lower()) for r in places.collect()]
    want = {}
    for n in (2, 4, 6):
        for prefix in {x[2][:n] for x in rows if len(x[2]) >= n}:
            want |= {(prefix, i + 1): x[1] for i, x in enumerate(sorted(x for x in rows if x[2].startswith(prefix))[:8])}
    assert got == want


@pytest.mark.parametrize("name", ["rings_of_all", "radius_rings"])
def test_rings_of_one_file_are_made_in_many_tasks(spark, sf_dir, name):
    df = own.queries()[name](spark, sf_dir)
    source = "customer" if name == "rings_of_all" else "supplier"
    assert spark.read.parquet(f"{sf_dir}/{source}.parquet").rdd.getNumPartitions() == 1
    held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 1 and sum(held) == 73 * spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
