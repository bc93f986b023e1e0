"""The places that none beats, against comparing all pairs."""

import random

import pytest

from townmeter.operators import extras


def brute(rows):
    whole = [r for r in rows if None not in r[1:]]
    beats = lambda a, b: all(x <= y for x, y in zip(a[1:], b[1:])) and a[1:] != b[1:]
    return sorted(r for r in whole if not any(beats(q, r) for q in whole))


def opposed(draw, n):
    """Parts of one: who has less of one has more of the others."""
    cuts = sorted(draw.random() for _ in range(n - 1))
    return [float(b - a) for a, b in zip([0, *cuts], [*cuts, 1])]


KINDS = {
    "independent": lambda d, n: [d.random() for _ in range(n)],
    "opposed": opposed,
    "lattice": lambda d, n: [float(d.randint(0, 4)) for _ in range(n)],
    "skewed": lambda d, n: [d.random() ** 9 for _ in range(n)],
}


@pytest.mark.parametrize("kind, columns", [("independent", 1), ("independent", 2), ("independent", 5), ("opposed", 2), ("opposed", 5), ("lattice", 3), ("skewed", 3)])
def test_front_equals_all_pairs(spark, columns, kind):
    draw = random.Random(f"{kind}{columns}")
    rows = [(i, *KINDS[kind](draw, columns)) for i in range(250)] + [(900, *[None] * columns)]
    rows += [(1000 + i, *rows[i][1:]) for i in range(0, 250, 5)]
    names = [f"c{i}" for i in range(columns)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in names))
    assert sorted(map(tuple, extras.pareto_front(df, "k", names).collect())) == brute(rows)


def test_front_of_few_cells(spark, monkeypatch):
    draw = random.Random(1)
    rows = [(i, draw.gauss(0, 1), draw.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    for cells in (1, 4, 100_000):
        monkeypatch.setattr(extras, "CELLS", cells)
        assert sorted(map(tuple, extras.pareto_front(df, "k", ["a", "b"]).collect())) == brute(rows)
    assert extras.pareto_front(df.limit(0), "k", ["a", "b"]).collect() == []
    one = [(1, 2.0, 2.0), (2, 2.0, 2.0)]
    assert sorted(map(tuple, extras.pareto_front(spark.createDataFrame(one, "k long, a double, b double"), "k", ["a", "b"]).collect())) == one
