"""Spells as summaries of years against a walk over the days."""

import datetime as dt
import random

import pytest

from townmeter.operators import indices

SCHEMA = "place string, day date, v double"


def walk(rows, threshold, calendar, cut):
    """Longest run of (day, value) rows in order; cut: runs end with the year."""
    best, run, last = 0, 0, None
    for day, v in sorted(rows):
        if last and ((calendar and (day - last).days != 1) or (cut and day.year != last.year)):
            run = 0
        run = run + 1 if v is not None and v >= threshold else 0
        best, last = max(best, run), day
    return best


def brute(rows, threshold, min_days, calendar):
    out = {}
    for place in {r[0] for r in rows}:
        own = [(d, v) for p, d, v in rows if p == place]
        years = {y: [(d, v) for d, v in own if d.year == y] for y in {d.year for d, _ in own}}
        full = [y for y, days in years.items() if sum(v is not None for _, v in days) >= min_days]
        if full:
            out[place] = (walk(own, threshold, calendar, False), pytest.approx(sum(walk(years[y], threshold, calendar, True) for y in full) / len(full)), len(full))
    return out


def days(draw, share, hot, years=(2019, 2020, 2021, 2023)):
    first = dt.date(years[0], 1, 1)
    every = (first + dt.timedelta(i) for i in range(366 * 5))
    return [(d, draw.choice([None, 0.0]) if draw.random() > hot else 9.0) for d in every if d.year in years and draw.random() < share]


def series(seed):
    draw = random.Random(seed)
    rows = [(f"p{i}", d, v) for i, (share, hot) in enumerate(((1.0, 0.99), (1.0, 0.999), (0.9, 0.97), (0.5, 0.8), (1.0, 0.1), (1.0, 1.0), (0.97, 1.0))) for d, v in days(draw, share, hot)]
    return rows + [("edge", dt.date(2019, 12, 31), 9.0), ("edge", dt.date(2020, 1, 1), 9.0), ("leap", dt.date(2020, 12, 30), 9.0), ("leap", dt.date(2020, 12, 31), 9.0), ("leap", dt.date(2021, 1, 1), 9.0)]


def found(df):
    return {r.place: (r.longest, r.mean_longest, r.years) for r in df.collect()}


@pytest.mark.parametrize("calendar, min_days", [(False, 300), (True, 300), (False, 1), (True, 1)])
def test_spells_equal_a_walk(spark, calendar, min_days):
    rows = series(min_days)
    got = indices.longest_spells(spark.createDataFrame(rows, SCHEMA), ["place"], "v", 5.0, min_days=min_days, calendar=calendar)
    assert found(got) == brute(rows, 5.0, min_days, calendar)


def test_a_new_year_only_adds_its_summary(spark):
    rows = series(7)
    df = spark.createDataFrame(rows, SCHEMA)
    one = lambda part: indices.spell_summaries(part, ["place"], "v", 5.0)
    old, new = one(df.filter("year(day) < 2021")), one(df.filter("year(day) >= 2021"))
    assert found(indices.merge_spells(new.unionByName(old), ["place"], 300)) == brute(rows, 5.0, 300, False)
    assert old.count() == len({(p, d.year) for p, d, _ in rows if d.year < 2021})


def test_days_are_not_shuffled(spark):
    df = spark.createDataFrame(series(1), SCHEMA)
    plan = indices.longest_spells(df, ["place"], "v", 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange") == 2
    before = plan[plan.rindex("Exchange") :]
    assert "partial_bit_or" in before  # days are summed up before the first exchange
