"""Ranks and quantiles of whole populations against brute force."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from townmeter.operators import extras, normalise


def ranks(rows):
    """{i: pct} of (i, group, value)."""
    out = {}
    for i, g, v in rows:
        own = [x for _, h, x in rows if h == g and x is not None]
        if v is None:
            out[i] = None
        elif len(own) <= 1:
            out[i] = 50.0
        else:
            out[i] = (sum(x < v for x in own) + (sum(x == v for x in own) - 1) / 2) / (len(own) - 1) * 100
    return out


def population(draw, n):
    return [(i, draw.choice(["a", "b", "c", None]), draw.choice([None, 0.0, 0.0, 0.0, float(draw.randint(-5, 5)), draw.gauss(0, 100)])) for i in range(n)] + [(n, "alone", 3.0)]


@pytest.mark.parametrize("few, hot", [(50_000, 1000), (0, 1000), (0, 10), (0, 10**9)])
def test_ranks_equal_brute_force(spark, monkeypatch, few, hot):
    monkeypatch.setattr(normalise, "BROADCAST_ROWS", few)
    monkeypatch.setattr(normalise, "HOT", hot)
    rows = population(random.Random(few + hot), 500)
    df = spark.createDataFrame(rows, "i long, indicator string, value double").select("*", *[F.lit(1).alias(c) for c in ("g", "v", "n", "ties", "below")])
    got = {r.i: r.pct for r in normalise.percentile_ranks(df).collect()}
    assert got == {i: p if p is None else pytest.approx(p) for i, p in ranks(rows).items()}


def test_ranks_of_no_rows(spark):
    df = spark.createDataFrame([], "i long, indicator string, value double")
    assert normalise.percentile_ranks(df).collect() == []
    df = spark.createDataFrame([(1, "a", None)], "i long, indicator string, value double")
    assert [r.pct for r in normalise.percentile_ranks(df).collect()] == [None]


def test_all_indicators_take_one_range_exchange(spark):
    df = spark.range(1000).select("id", *[(F.col("id") * k % 97).cast("double").alias(f"c{k}") for k in range(1, 6)])
    plan = normalise.rank_columns(df, "id", [f"c{k}" for k in range(1, 6)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 0 and plan.count("Join") == 1  # the range exchange is in the written positions
    got = normalise.rank_columns(df, "id", ["c1", "c2"]).collect()
    want = ranks([((r.id, c), c, float(r.id * k % 97)) for r in got for k, c in ((1, "c1"), (2, "c2"))])
    assert all(r[f"{c}_pct"] == pytest.approx(want[r.id, c]) for r in got for c in ("c1", "c2"))


def test_sensitivity_equals_brute_force(spark):
    draw = random.Random(4)
    rows = [(i, float(draw.randint(0, 9)), float(draw.randint(0, 9)) if i % 9 else None) for i in range(200)]
    got = {r.k: (r["rank"], r.best, r.worst, r.flips) for r in extras.weight_sensitivity(spark.createDataFrame(rows, "k long, a double, b double"), "k", ["a", "b"], [2.0, 1.0]).collect()}
    whole = [r for r in rows if r[2] is not None]
    sets = [(2.0, 1.0), (1.6, 1.0), (2.4, 1.0), (2.0, 0.8), (2.0, 1.2)]
    scores = [{k: round(a * w / (w + v) + b * v / (w + v), 6) for k, a, b in whole} for w, v in sets]
    place = [{k: 1 + sum(x < s[k] for x in s.values()) for k in s} for s in scores]
    assert got == {k: (place[0][k], min(p[k] for p in place), max(p[k] for p in place), len({p[k] for p in place}) > 1) for k, *_ in whole}


VALUES = [-math.inf, -1e308, -2.5, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1.0 + 2**-51, 3.25, 3.25, 1e300, math.inf]


def test_bits_order_like_doubles(spark):
    df = spark.createDataFrame([(v,) for v in random.Random(1).sample(VALUES, len(VALUES))], "v double")
    got = [r.v for r in df.select("v", normalise.order_bits(F.col("v")).alias("b")).orderBy("b").collect()]
    assert list(map(repr, got)) == list(map(repr, VALUES))


@pytest.mark.parametrize("bits", [16, 32, 8])
def test_quantiles_equal_sorted_values(spark, monkeypatch, bits):
    monkeypatch.setattr(normalise, "BITS", bits)
    draw = random.Random(bits)
    rows = [(draw.choice(["a", None, "c"]), draw.choice([1, 2]), draw.choice([0.0, 7.5, None, draw.gauss(0, 1), draw.gauss(1e6, 1e-3), -draw.random()])) for _ in range(3000)] + [("empty", 1, None), ("one", 1, 4.0), ("two", 1, 1.0), ("two", 1, 2.0)]
    at = (0.0, 0.01, 0.5, 0.5, 0.977, 1.0)
    got = {(r.g1, r.k2): [r[f"q{i}"] for i in range(len(at))] for r in normalise.quantiles(spark.createDataFrame(rows, "g1 string, k2 int, v double"), "v", at, ["g1", "k2"]).collect()}
    want = {}
    for g, k, _ in rows:
        own = sorted(v for a, b, v in rows if (a, b) == (g, k) and v is not None)
        pos = [p * (len(own) - 1) for p in at]
        want[g, k] = [pytest.approx(own[math.floor(p)] + (own[math.ceil(p)] - own[math.floor(p)]) * (p - math.floor(p)), rel=1e-12) for p in pos] if own else [None] * len(at)
    assert got == want
    whole = normalise.quantiles(spark.createDataFrame(rows, "g1 string, k2 int, v double"), "v", at).collect()
    numbers = [v for *_, v in rows if v is not None]
    con = duckdb.connect()
    assert [tuple(r) for r in whole] == [tuple(pytest.approx(con.execute("select quantile_cont(v, ?) from (select unnest(?) as v)", [p, numbers]).fetchone()[0], rel=1e-12) for p in at)]


def test_quantiles_of_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert [tuple(r) for r in normalise.quantiles(df, "v", (0.5,)).collect()] == [(None,)]
    assert normalise.quantiles(df, "v", (0.5,), ["g"]).collect() == []
