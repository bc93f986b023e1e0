"""Queries and operators that must leave nothing of their input out."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from townmeter.functions import labels
from townmeter.jobs import queries as own
from townmeter.jobs.tables import places
from townmeter.operators import explore


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def brute_coolest(searches, rows):
    """{search: [(rank, insee)]} of (search, origin, km, people) over places as rows."""
    known = {p.insee: p for p in rows}
    first = min(rows, key=lambda p: (-p.summer_tmax, p.insee))
    out = {}
    for s, origin, reach, people in searches:
        o = known.get(origin, first)
        near = [p for p in rows if km(o.lat, o.lon, p.lat, p.lon) <= reach and (p.hosp and p.station if people == -1 else (p.population or 0) >= people)]
        best = sorted(near, key=lambda p: (p.summer_tmax, p.insee))[:15]
        if best:
            out[s] = [(i + 1, p.insee) for i, p in enumerate(best)]
    return out


def by_search(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.search_id, []).append((r["rank"], r.insee))
    return {s: sorted(v) for s, v in got.items()}


def test_all_permalinks_are_searched_with_their_radius(spark, sf_dir):
    links = [(r.page_id, r.origin, r.km, r.people) for r in own.queries()["permalinks"](spark, sf_dir).collect()]
    want = brute_coolest(links, places(spark, sf_dir).collect())
    assert by_search(own.queries()["coolest_of_permalinks"](spark, sf_dir)) == want
    assert {s % 8 for s in want} == set(range(8)) and {k for s, _, k, _ in links if s in want} == {80.0, 150.0, 300.5}


@pytest.mark.parametrize("times", [1, 3])
def test_coolest_equals_brute_force_up_to_the_largest_radius(spark, sf_dir, times):
    p = places(spark, sf_dir)
    searches = [(i + 1000 * t, f"{i:06d}", r, n) for t in range(times) for i, (r, n) in enumerate((r, n) for r in (20.0, 25.0, 99.5, 100.0, 300.5, 500.0) for n in (-1.0, 0.0, 5000.0))]
    df = spark.createDataFrame(searches, "search_id long, origin string, km double, people double")
    assert by_search(explore.coolest(explore.attach_origins(df, p), p)) == brute_coolest(searches, p.collect())


def test_whole_texts_of_all_documents_are_made_plain(spark, sf_dir):
    bare = lambda x: "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = own.queries()["plain_texts"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.plain) for r in got) == sorted((r.doc_id, bare(r.text)) for r in rows)
    words = ["Škocjan", "Ăvram", "e\u0301te\u0301", "œuvre", "ÅNGSTRÖM", "Ὀδυσσεύς", None]
    named = spark.createDataFrame([(w,) for w in words], "w string").select(labels.plain(F.col("w")).alias("p")).collect()
    assert [r.p for r in named] == ["skocjan", "avram", "ete", "œuvre", "angstrom", "οδυσσευς", None]
    assert max(len(r.plain) for r in got) > 200 and len({r.lang for r in rows}) > 3


def test_every_place_has_rings(spark, sf_dir):
    got = own.queries()["rings_of_all"](spark, sf_dir).collect()
    assert sorted((r.insee, r.i) for r in got) == sorted((p.insee, i) for p in places(spark, sf_dir).collect() for i in range(73))


def test_grid_means_take_all_parts(spark):
    bigger = "/root/testdata/sf0.1"
    parts = spark.read.parquet(f"{bigger}/part.parquet").select("p_partkey", "p_retailprice").collect()
    assert len(parts) > 7371
    want = {}
    for p in parts:
        if p.p_partkey % 7371 % 7:
            want.setdefault(p.p_partkey % 3, []).append(float(p.p_retailprice) / 100 - 3.15)
    got = {r.file: r.mean_c for r in own.queries()["grid_qc_parts"](spark, bigger).collect()}
    assert got == pytest.approx({k: sum(v) / len(v) for k, v in want.items()}, abs=1e-5)
