"""Matching in place: the plan, whole tables behind filters, hot tiles, several metrics, reduction between passes."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions.palette import map_palette, with_oklab
from gridspark.operators import match as M
from gridspark.operators import reduce as R
from gridspark.operators.tiles import filter_requantize



@pytest.fixture(scope="module")
def palette(spark):
    return map_palette(spark)


@pytest.fixture(scope="module")
def pixels(spark):
    rng = random.Random(8)
    rows = [(i, i % 40, i // 40, *(rng.choice((0, 17, 90, 160, 255)) for _ in range(3)), 255) for i in range(4000)]
    return spark.createDataFrame([*rows, (4000, 0, 100, None, 1, 2, 255)], "id int, x int, y int, r int, g int, b int, alpha int").repartition(5)


def by_numpy(spark, rows, palette, shift=None):
    """Nearest entry by the expressions of the library, row by row."""
    entries = sorted((p.id, p.L, p.a, p.lab_b) for p in with_oklab(palette).collect())
    lab = np.array([e[1:] for e in entries])
    for r in with_oklab(rows).collect():
        if r.L is None:
            yield r.id, None
            continue
        d = ((lab - (np.array([r.L, r.a, r.lab_b]) + (shift(r) if shift else 0))) ** 2).sum(axis=1)
        yield r.id, entries[int(d.argmin())][0]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_matching_moves_and_writes_nothing(spark, palette, pixels, monkeypatch):
    jobs = []
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", lambda *a, **k: jobs.append(a))
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.collect", lambda *a, **k: jobs.append(a))
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toPandas", lambda *a, **k: jobs.append(a))
    for out in (M.nearest_match(pixels, palette), M.ordered_dither(pixels, palette, 8), M.dither_sizes(pixels, palette, (2, 4))):
        text = out._jdf.queryExecution().executedPlan().toString()
        main = text.split("Subquery")[0]
        assert "Join" not in main and "Aggregate" not in main and "ArrowEvalPython" in main
        assert len(re.findall(r"Exchange", main)) <= 1  # the repartition of the input itself
    assert not jobs


def test_nearest_match(spark, palette, pixels):
    got = {(r.id, r.match_id) for r in M.nearest_match(pixels, palette).collect()}
    assert got == set(by_numpy(spark, pixels, palette))


def test_filters_do_not_cut_off_the_palette(palette, pixels):
    """The first row of a partition brings the palette; a filter above must not remove it from below."""
    whole = {r.id: r.match_id for r in M.nearest_match(pixels, palette).collect()}
    for keep in (F.col("id") % 7 == 3, F.col("r") == 17, F.col("match_id") > 100):
        some = M.nearest_match(pixels, palette).where(keep)
        assert all(whole[r.id] == r.match_id for r in some.collect())
    assert M.nearest_match(pixels, palette).where("id = 1234").select("match_id").collect()[0][0] == whole[1234]
    assert M.nearest_match(pixels, palette).limit(3).count() == 3
    counted = M.nearest_match(pixels, palette).groupBy("match_id").count().agg(F.sum("count")).collect()[0][0]
    assert counted == len(whole)


def test_empty_palette_and_empty_table(palette, pixels):
    none = M.nearest_match(pixels, palette.where("false")).where("r is not null").select("match_id", "dist").distinct().collect()
    assert [tuple(r) for r in none] == [(0, None)]
    assert M.nearest_match(pixels.where("false"), palette).count() == 0


def test_metrics_in_one_pass(palette, pixels):
    each = {(r.metric, r.id): r.match_id for r in M.match_by_metric(pixels, palette).collect()}
    assert len(each) == 5 * 4001
    for metric in M.METRICS:
        alone = {(metric, r.id): r.match_id for r in M.nearest_match(pixels, palette, metric).collect()}
        assert all(each[k] == v for k, v in alone.items())


def test_dither_sizes_equal_single_dithers(palette, pixels):
    every = {(r["size"], r.id): r.match_id for r in M.dither_sizes(pixels, palette, (2, 8), 0.2).collect()}
    for n in (2, 8):
        assert {(n, r.id): r.match_id for r in M.ordered_dither(pixels, palette, n, 0.2).collect()}.items() <= every.items()


@pytest.mark.parametrize("tile_rows", [M.TILE_ROWS, 100])
def test_tile_palettes(spark, palette, pixels, tile_rows):
    """Tile 0 holds most pixels, tile 3 shows nothing, a null tile shows two colours."""
    tiled = pixels.withColumn("tile", F.when(F.col("id") % 10 < 7, 0).when(F.col("id") % 10 < 9, 3))
    present = spark.createDataFrame([(0, 29), (0, 33), (0, 118), (0, 0), (None, 61), (None, 4)], "tile int, id int")
    got = {(r.id, r.match_id) for r in M.tile_palette_match(tiled, present, palette, ["tile"], tile_rows=tile_rows).collect()}
    want = set()
    for tile, ids in ((0, (29, 33, 118)), (3, None), (None, (61, 4))):
        local = palette if ids is None else palette.where(F.col("id").isin(*ids))
        rows = tiled.where(F.col("tile").eqNullSafe(F.lit(tile)))
        want |= set(by_numpy(spark, rows, local))
    assert got == want


def test_reduction_between_the_passes(palette, pixels):
    seen = pixels.where("r is not null")
    for strategy in R.STRATEGIES:
        out = R.two_pass_match(seen, palette, colours=9, strategy=strategy)
        used = {r.match_id for r in out.select("match_id").distinct().collect()}
        first = {r.match_id for r in M.nearest_match(seen, palette).select("match_id").distinct().collect()}
        assert len(used) <= 9 < len(first) and used <= first
    dithered = R.two_pass_match(seen, palette, dither_size=4, colours=9)
    assert dithered.select("match_id").distinct().count() <= 9


def test_requantize_blurs_once(palette, pixels):
    grid = pixels.where("r is not null").select(F.lit(1).alias("image"), "x", "y", F.lit(33).alias("c"))
    plan = filter_requantize(grid, palette, ["image"], 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 2 and "parquet" not in plan
