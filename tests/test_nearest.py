"""Nearest places against all distances, on places spread evenly, in clusters far apart, and on one spot."""

import random

import pytest

from gridspark.operators.nearest import nearest_source


def brute(places, points, needed, visited, reach):
    by_place = {}
    for loc, x, y, z, item, n in places:
        if loc not in visited and None not in (x, y, z):
            by_place.setdefault((loc, x, y, z), []).append((item, n))
    out = set()
    for q, px, py, pz in points:
        found = []
        for (loc, x, y, z), held in by_place.items():
            d = (x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2
            if any(item in needed and n > 0 for item, n in held if item):
                found.append((d, False, loc))
            elif all(item is None for item, _ in held) and d <= reach * reach:
                found.append((d, True, loc))
        if found:
            out.add((q, min(found)[2], float(min(found)[0])))
    return out


def spreads():
    rng = random.Random(17)
    even = [[rng.randrange(-60, 60) for _ in range(3)] for _ in range(300)]
    far = [[c * 10**6 + rng.randrange(40) for _ in range(3)] for c in (-3, 0, 1, 900) for _ in range(60)]
    return {"even": even, "far": far, "spot": [[5, 5, 5]] * 30}


@pytest.mark.parametrize("name", ["even", "far", "spot"])
def test_nearest_source(spark, name):
    rng = random.Random(18)
    spots = spreads()[name]
    places = [(loc, *spot, rng.choice(("a", "b", "c", None)), rng.randrange(-1, 4)) for loc, spot in enumerate(spots) for _ in range(rng.randint(1, 2))]
    places += [(9000, None, 1, 1, "a", 5)]
    points = [(q, *(s + rng.randrange(-6, 7) for s in rng.choice(spots))) for q in range(120)] + [(500, 10**7, 0, -(10**7)), (501, *spots[0])]
    args = ["a", "b"], [3, 4], 7.0
    got = nearest_source(
        spark.createDataFrame(places, "loc int, x int, y int, z int, item string, n int"),
        spark.createDataFrame([*points, (502, None, 0, 0)], "q int, x int, y int, z int"),
        *args,
    )
    assert {tuple(r) for r in got.collect()} == brute(places, points, *args)


def test_tables_of_needs_and_no_places(spark):
    places = spark.createDataFrame([(1, 0, 0, 0, "a", 1), (2, 9, 9, 9, "b", 1), (3, 1, 0, 0, None, None)], "loc int, x int, y int, z int, item string, n int")
    points = spark.createDataFrame([(None, 0, 0, 0), (1, 8, 8, 8)], "q int, x int, y int, z int")
    needs, seen = spark.createDataFrame([("a",), ("b",)], "item string"), spark.createDataFrame([(1,)], "loc int")
    assert {tuple(r) for r in nearest_source(places, points, needs, seen, 2.0).collect()} == {(None, 3, 1.0), (1, 2, 3.0)}
    assert nearest_source(places.where("false"), points, ["a"]).count() == 0
    flat = nearest_source(places, points, ["b"], axes=("x", "z"), reach=0.5)
    assert {tuple(r) for r in flat.collect()} == {(None, 2, 162.0), (1, 2, 2.0)}
