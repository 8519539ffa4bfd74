"""Rows that must not get lost: null keys and order values, whole files and tables, bad palettes, placed segments."""

import random

import pytest

from gridspark.functions.palette import palette_dim, with_oklab
from gridspark.functions.payload import MODES
from gridspark.operators import chunks as K
from gridspark.operators import neighbours as N
from gridspark.operators import plan as B
from gridspark.operators import reduce as R
from gridspark.operators.masks import remap
from gridspark.operators.match import nearest_match, tile_palette_match
from gridspark.operators.scan import row_number, rows_between, scan
from gridspark.sources import batches as J
from gridspark.streaming import assemble as A
from gridspark.streaming.replay import drain, stream_table
from pyspark.sql import functions as F


def test_written_batches_are_read_back(spark, tmp_path):
    rows = spark.range(50).select(
        F.concat(F.lit("f"), F.col("id")).alias("sourceFilename"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("codecMode"),
        F.array(F.struct(F.col("id").cast("int").alias("nonce"))).alias("tiles"),
    )
    path = str(tmp_path / "out")
    J.write_batches(rows.coalesce(3), path, ["codecMode"])
    want = {(f"f{i}", "AB"[i % 2], i) for i in range(50)}
    for lines in (False, True):
        back = J.read_batches(spark, path, lines)
        assert {(r.sourceFilename, r.codecMode, r.tiles[0].nonce) for r in back.collect()} == want


def test_directory_tables_are_streamed(spark, tmp_path):
    spark.range(87).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    spark.range(9).coalesce(1).write.parquet(str(tmp_path / "part"))
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one.parquet")
    assert drain(stream_table(spark, str(tmp_path), "t"), "t-directory").count() == 87
    assert drain(stream_table(spark, str(tmp_path), "one"), "t-file").count() == 9


def test_null_keys_and_orders_stay(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (None, 0, 0, "a"), (None, 1, 0, "b")], "site int, x int, z int, item string")
    assert B.serpentine_order(cells, ["site"], 2).count() == 3
    assert B.capped_load(cells, ["site"], 4, 2).count() == 3
    needs = spark.createDataFrame([(1, "a", 100), (None, "a", 100), (None, "b", 300)], "g int, item string, need long")
    slots = {(r.g, r["item"]): r.slots for r in B.proportional_slots(needs, ["g"], 4).collect()}
    assert slots == {(1, "a"): 2, (None, "a"): 1, (None, "b"): 3}
    rows = spark.createDataFrame([("u", 5), ("u", None), (None, 3)], "k string, o long")
    assert sorted((r.o or 0, r.n) for r in scan(rows, ["k"], "o", {"n": row_number()}).collect()) == [(0, 1), (3, 1), (5, 2)]
    assert rows_between(rows, ["k"], "o", F.lit(1), F.lit(9)).count() == 3


def test_a_reading_keeps_all_its_items(spark):
    seen = [("p", "a", 1, 1), ("p", "a", 2, 2), ("p", "b", 3, 2), ("q", "a", 5, 1), ("q", "a", 0, 2), (None, "c", 4, 1)]
    got = B.latest_stock(spark.createDataFrame(seen, "loc string, item string, n int, seq int"))
    assert {tuple(r) for r in got.collect()} == {("p", "a", 2), ("p", "b", 3), (None, "c", 4)}
    unnumbered = spark.createDataFrame([("q", "a", 5, None), ("q", "b", 6, None), ("r", "a", 1, None), ("r", "b", 2, 1)], "loc string, item string, n int, seq int")
    assert {tuple(r) for r in B.latest_stock(unnumbered).collect()} == {("q", "a", 5), ("q", "b", 6), ("r", "b", 2)}


def test_bad_palettes_are_errors(spark):
    schema = "id int, r int, g int, b int"
    assert palette_dim(spark.createDataFrame([(4, 1, 2, 3), (4, 1, 2, 3)], schema)).count() == 1
    for rows in ([(256, 1, 2, 3)], [(0, 1, 2, 3)], [(None, 1, 2, 3)], [(4, 1, 2, 3), (4, 1, 2, 4)]):
        with pytest.raises(Exception, match="palette id"):
            palette_dim(spark.createDataFrame(rows, schema)).collect()
    wide = spark.range(999).select(F.col("id").cast("int"), *(F.lit(1).alias(c) for c in "rgb"), F.lit(True).alias("legal"))
    with pytest.raises(Exception, match="at most"):
        nearest_match(wide, wide).collect()
    pixels = spark.createDataFrame([(1,), (2,)], "c int")
    for rows in ([(300, 1)], [(1, 2), (1, 3)]):
        with pytest.raises(Exception, match="mapped"):
            remap(pixels, spark.createDataFrame(rows, "id int, to int")).collect()


def test_no_colour_has_no_match(spark):
    pal = palette_dim(spark.createDataFrame([(4, 0, 0, 0), (8, 255, 255, 255)], "id int, r int, g int, b int"))
    rows = spark.createDataFrame([(250, 250, 250), (None, 1, 1), (None, None, None)], "r int, g int, b int")
    got = nearest_match(rows, pal).collect()
    assert {(r.r, r.match_id) for r in got} == {(250, 8), (None, None)} and {r.dist is None for r in got if r.r is None} == {True}


SEGMENTS = {
    "overlap": [(0, "abcd"), (2, "cdef")],
    "inside": [(0, "abcdef"), (2, "XY")],
    "gap": [(0, "abc"), (4, "efgh")],
    "short": [(0, "abc")],
}


def test_segments_are_placed(spark, tmp_path):
    rows = [(k, at, body, 6) for k, parts in SEGMENTS.items() for at, body in parts]
    batch = K.segment_assemble(spark.createDataFrame(rows, "key string, offset long, body string, total long"), ["key"])
    assert {(r.key, r.payload, r.received, r.complete) for r in batch.collect()} == {
        ("overlap", "abcdef", 6, True), ("inside", "abXYef", 6, True), ("gap", "abc", 3, False), ("short", "abc", 3, False)
    }
    spark.createDataFrame(rows, "key string, at long, body string, total long").write.parquet(str(tmp_path / "s.parquet"))
    out = drain(A.stream_segment_assemble(stream_table(spark, str(tmp_path), "s"), ["key"]), "t-placed")
    assert {(r.key, r.payload) for r in out.collect()} == {("overlap", "abcdef"), ("inside", "abXYef")}


def test_one_bad_line_loses_no_batch(spark, tmp_path):
    good = [f'{{"sourceFilename": "f{i}", "tiles": [{{"nonce": {i}}}]}}' for i in range(5)]
    twice = '{"sourceFilename": "f5", "columns": 1, "columns": 2}'
    sound = tmp_path / "sound"
    sound.mkdir()
    (sound / "a.json").write_text("\n".join([*good, twice]) + "\n")
    for name, lines in {"cut": [*good, '{"sourceFilename": "f5", "ti'], "two": [*good, "{}{}"], "first": ['"x": 1', *good]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(lines))
        bad = next(x for x in lines if x not in good)
        for by_line in (False, True):
            with pytest.raises(Exception, match="not one batch document"):
                J.read_batches(spark, str(tmp_path / name), by_line).collect()
            rows = J.read_batches(spark, str(tmp_path / name), by_line, bad="bad").collect()
            assert sorted((r.sourceFilename or "", r.bad) for r in rows) == [("", bad), *((f"f{i}", None) for i in range(5))]
    for by_line in (False, True):
        assert sorted(r.sourceFilename for r in J.read_batches(spark, str(sound), by_line).collect()) == [f"f{i}" for i in range(6)]
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "a.json").write_text('{\n"sourceFilename": "w",\n"tiles": [\n{"nonce": 1},\n{}\n]\n}\n')
    assert [(r.sourceFilename, len(r.tiles)) for r in J.read_batches(spark, str(whole)).collect()] == [("w", 2)]


def test_a_null_group_is_a_group(spark):
    pal = palette_dim(spark.createDataFrame([(4, 0, 0, 0), (8, 255, 255, 255), (9, 250, 250, 250)], "id int, r int, g int, b int"))
    cells = [(y, x, (x * 60 + y * 40) % 256, (4, 8, 8, 9)[x]) for y in range(4) for x in range(4)]
    rows = [(k, y, x, v, v, v, c) for k in ("a", None) for y, x, v, c in cells] + [(None, 9, 9, None, None, None, 4)]
    pixels = spark.createDataFrame(rows, "image string, y int, x int, r int, g int, b int, c int")
    shown = pixels.where("y < 4")

    def same(df, n, *columns):
        found = df.collect()
        sides = [sorted(tuple(r[c] for c in columns) for r in found if r.image == k) for k in ("a", None)]
        assert sides[0] == sides[1] and len(sides[0]) == n
        return sides[0]

    same(N.adaptive_strength(with_oklab(shown), ["image"], F.lit(True)), 16, "y", "x", "strength")
    mask = shown.where("x > 0").select("image", "y", "x")
    for strategy in R.STRATEGIES:
        step = R.reduce_once(shown, pal, ["image"], strategy)
        assert same(step, 1, "victim", "survivor", "before", "after", "touched")[0][0] is not None
        assert same(R.reduce_once(shown, pal, ["image"], strategy, "c", mask, ["image", "y", "x"]), 1, "before", "touched")[0][0] == 2
        assert len({c for _, _, c in same(R.apply_step(shown, step, ["image"]), 16, "y", "x", "c")}) == 2
    present = spark.createDataFrame([("a", 4), ("a", 9), (None, 4), (None, 9)], "image string, id int")
    assert {m for _, _, m in same(tile_palette_match(shown, present, pal, ["image"]), 16, "y", "x", "match_id")} == {4, 9}
    assert [r.match_id for r in tile_palette_match(pixels, present, pal, ["image"]).where("y = 9").collect()] == [None]
