"""Otsu's threshold on exact values, against a walk over the sorted values."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.functions.palette import with_oklab
from gridspark.operators import histogram as H
from gridspark.operators import neighbours as N


def by_walk(values):
    values = sorted(values)
    total, n, low, best = sum(values), len(values), 0.0, (-1.0, values[0])
    for k, v in enumerate(values):
        if k and v != values[k - 1]:
            w = k / n
            gap = low / k - (total - low) / (n - k)
            best = max(best, (w * (1 - w) * gap * gap, v), key=lambda b: b[0])
        low += v
    return best[1]


def test_values_on_any_scale(spark):
    rng = random.Random(12)
    groups = {
        "tiny": [1e-7] * 5 + [2e-7] * 4 + [3e-7] * 2 + [9e-7] * 6,
        "constant": [0.25] * 9,
        "signs": [-3.5, -3.4, -0.1, 0.0, 0.0, 2.5, 1e-300, -1e-300, 7.0],
        "wide": [10.0**e for e in range(-20, 20)],
        None: [rng.gauss(0.2, 0.05) for _ in range(300)] + [rng.gauss(0.7, 0.1) for _ in range(300)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("tiny", None), ("tiny", float("nan"))]
    got = {r.g: r.threshold for r in H.otsu_threshold(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {k: by_walk(vs) for k, vs in groups.items()}
    alone = H.otsu_threshold(spark.createDataFrame([(v,) for v in groups["tiny"]], "v double"), [], "v").collect()
    assert [tuple(r) for r in alone] == [(by_walk(groups["tiny"]),)]


def test_a_group_of_distinct_values_is_spread(spark, monkeypatch):
    from gridspark.operators import scan

    monkeypatch.setattr(H, "scan", lambda *a, **k: scan.scan(*a, width=64, **k))
    rng = random.Random(13)
    values = [rng.lognormvariate(0, 3) for _ in range(2000)]
    got = H.otsu_threshold(spark.createDataFrame([(1, v) for v in values], "g int, v double"), ["g"], "v").collect()
    assert [r.threshold for r in got] == [by_walk(values)]


@pytest.mark.parametrize("group", [["image"], []])
def test_strength_keeps_only_the_histogram(spark, monkeypatch, group):
    written = []
    from gridspark import session

    keep = session.cut_lineage
    for module in (H, __import__("gridspark.operators.scan", fromlist=["scan"])):
        monkeypatch.setattr(module, "cut_lineage", lambda df, label="step": (written.append(df.columns), keep(df, label))[1])
    rows = [(1, x, y, 255 if x // 4 == y // 4 else (x * 7) % 40, 30, y * 3) for x in range(16) for y in range(16)]
    pixels = with_oklab(spark.createDataFrame(rows, "image int, x int, y int, r int, g int, b int"))
    out = N.adaptive_strength(pixels, group, F.lit(True))
    contrast = [r.contrast for r in N.local_contrast(pixels, group, F.lit(True)).collect()]
    t = by_walk(contrast)
    want = sorted(1 - min(1, max(0, (c - t * 0.5) / t)) for c in contrast)
    assert [round(r.strength, 9) for r in out.orderBy("strength").collect()] == [round(w, 9) for w in want]
    assert all("x" not in columns for columns in written)
