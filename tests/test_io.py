"""Files, streams and executors."""

import json
import os
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridspark.sources import batches as J
from gridspark.sources.images import read_images, visible, write_bitmaps
from gridspark.streaming import assemble as A
from gridspark.streaming.replay import drain

REPO = Path(__file__).resolve().parent.parent


def png(path, width, height, pixel):
    raw = b"".join(b"\0" + bytes(v for x in range(width) for v in pixel(x, y)) for y in range(height))

    def part(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "a.png", 5, 3, lambda x, y: (x * 50, y * 100, 7, 255 if x else 0))
    rows = read_images(spark, str(tmp_path)).collect()
    assert len(rows) == 15
    assert {(r.x, r.y): (r.r, r.g, r.b, r.alpha) for r in rows if r.x} == {
        (x, y): (x * 50, y * 100, 7, 255) for x in range(1, 5) for y in range(3)
    }
    assert visible(read_images(spark, str(tmp_path))).count() == 12


def test_bitmaps_and_bad_files(spark, tmp_path):
    cells = [(i, x, y, (x * 40 + i) % 128, y, 7) for i, (w, h) in enumerate([(3, 2), (1, 1), (4, 5)]) for x in range(w) for y in range(h)]
    pixels = spark.createDataFrame(cells, "image int, x int, y int, r int, g int, b int")
    write_bitmaps(pixels, ["image"], str(tmp_path / "out"))
    (tmp_path / "out" / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nand no more")
    back = read_images(spark, str(tmp_path / "out")).collect()
    assert sorted(r.image.rsplit("/", 1)[1] for r in back if r.bad) == ["broken.png"]
    assert all(r.x is None and r.r is None and r.alpha is None for r in back if r.bad)
    assert sorted((r.x, r.y, r.r, r.g, r.b) for r in back if not r.bad) == sorted(c[1:] for c in cells)
    for wrong in ([(0, 0, 0, 128, 0, 0)], [(0, 1, 0, 1, 1, 1)]):
        with pytest.raises(Exception, match="channel|missing"):
            write_bitmaps(spark.createDataFrame(wrong, pixels.schema), ["image"], str(tmp_path / f"bad{wrong[0][3]}"))


def test_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "old.json").write_text(
        json.dumps({"sourceFilename": "a.png", "columns": 2, "tiles": [{"chunks": ["00a"], "nonce": 5}, {}]}, indent=2)
    )
    batch = J.read_batches(spark, str(source))
    row = batch.first()
    assert (row.columns, row.rows, row.codecMode, row.whitelist, row.title) == (2, 1, "CARPET_SHADE", [], None)
    tiles = {r.tile: r for r in J.batch_tiles(batch).collect()}
    assert (tiles[0].nonce, tiles[0].chunks, tiles[1].nonce, tiles[1].frameCount, tiles[1].muxed) == (5, ["00a"], 0, 1, False)
    assert tiles[1].frameDelays is None and tiles[1].chunks == []
    J.write_batches(batch, str(tmp_path / "out"), ["codecMode"])
    again = spark.read.schema(J.BATCH).json(str(tmp_path / "out")).first()
    assert again.sourceFilename == "a.png" and again.tiles[0].chunks == ["00a"]


def feed(spark, tmp_path, name, batches, schema):
    folder = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in sorted(folder.glob("*.parquet"), key=lambda p: p.stat().st_mtime)[-1:]:
            stamp = 1_700_000_000 + i * 10
            os.utime(f, (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


PIECES = "key string, at long, body string, total long"


def test_groups_arrive_in_any_order(spark, tmp_path):
    batches = [
        [("a", 2, "c", 3), ("b", 0, "x", 2)],
        [("a", 0, "a", 3), ("a", 2, "C", 3)],  # a repeat replaces and is not counted
        [("a", 1, "b", 3), ("a", 1, "b", 3)],
        [("a", 0, "late", 3), ("c", 0, "solo", 1)],  # a finished group stays finished
    ]
    out = drain(A.stream_group_assemble(feed(spark, tmp_path, "g", batches, PIECES), ["key"]), "t-groups")
    assert sorted((r.key, r.payload, r.pieces) for r in out.collect()) == [("a", "abC", 3), ("c", "solo", 1)]


def test_segments_wait_for_their_receiver(spark, tmp_path):
    batches = [
        [("r", 4, "wxyz", None), ("q", 3, "tail", None)],
        [("r", 4, "wxyz", None)],  # repeats do not add up
        [("r", 0, "abcd", 10)],
        [("r", 8, "89", None), ("s", 0, "whole", 5)],
    ]
    out = drain(A.stream_segment_assemble(feed(spark, tmp_path, "s", batches, PIECES), ["key"]), "t-segments")
    assert sorted((r.key, r.payload) for r in out.collect()) == [("r", "abcdwxyz89"), ("s", "whole")]


def test_first_seen(spark, tmp_path):
    batches = [[("a", 0, "1", 1), ("a", 1, "2", 1)], [("b", 0, "3", 1), ("a", 2, "4", 1)]]
    rows = feed(spark, tmp_path, "f", batches, PIECES).withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000_000))
    out = drain(A.stream_first_seen(rows, ["key"], "ts", "1 hour").select("key"), "t-first")
    assert sorted(r.key for r in out.collect()) == ["a", "b"]


def test_executors_need_no_copy_of_the_package(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {str(REPO)!r})\n"
        "import __spark_entry__ as e\n"
        "from gridspark.session import local_session\n"
        "spark = local_session(2, **{'spark.driver.memory': '1g'})\n"
        "q = e.queries()\n"
        "for n in ('match_quality', 'components_equal', 'nearest_match', 'reduce_palette'):\n"
        "    print(n, q[n](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "match_quality 1" in run.stdout
