"""Payloads from their pieces: one shuffle, repeats, nulls, keys across batches, overlaps against a plain fold."""

import random
import re

from pyspark.sql import functions as F

from gridspark.operators import chunks as K


def by_fold(pieces):
    """Overlay one piece after the other on the text so far; a piece behind the end is left out."""
    text = ""
    for at, body in pieces:
        if at <= len(text):
            text = text[:at] + body + text[at + len(body) :]
    return text


def test_overlay_against_the_fold():
    rng = random.Random(10)
    for _ in range(3000):
        offsets = sorted(rng.sample(range(20), rng.randint(0, 8)))
        pieces = [(o, "".join(rng.choice("abcdefgh😀") for _ in range(rng.randint(0, 9)))) for o in offsets]
        assert K.overlay(iter(pieces)) == by_fold(pieces)


def test_overlay_is_linear():
    """Half a million pieces under one long one."""
    n = 500_000
    assert K.overlay(iter([(0, "x" * 2 * n), *((i, "y") for i in range(1, n))])) == "x" + "y" * (n - 1) + "x" * n


def test_chunks_across_batches(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for k in [None, *range(40)]:
        bodies = ["".join(rng.choice("abc漢") for _ in range(rng.randint(0, 5))) for _ in range(rng.choice((1, 3, 400)))]
        gone = set(rng.sample(range(len(bodies)), 1)) if k is not None and k % 4 == 0 and len(bodies) > 1 else set()
        kept = [(i, b) for i, b in enumerate(bodies) if i not in gone]
        rows += [(k, "same", i, b, "extra") for i, b in kept for _ in range(rng.choice((1, 1, 3)))]
        want[k] = "".join(b for _, b in kept), len(kept), kept[0][0] == 0 and kept[-1][0] == len(kept) - 1
    rows += [(7, "same", 0, None, "a null body of a known index")]
    rows += [(99, "same", None, "z", ""), (99, "same", 0, "a", ""), (98, "same", 0, None, ""), (97, "same", 0, "a", ""), (97, "same", 0, "b", "")]
    want |= {99: ("za", 2, False), 98: ("", 1, True), 97: ("b", 1, True)}
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "k int, kind string, idx int, body string, n_chunks string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = K.chunk_assemble(chunks, ["k", "kind"])
        assert {r.k: (r.payload, r.n_chunks, r.complete) for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert out.columns == ["k", "kind", "payload", "n_chunks", "complete"]
    assert K.chunk_assemble(chunks.where("false"), ["k"]).count() == 0


def test_one_exchange(spark):
    chunks = spark.createDataFrame([(1, 0, "a")], "k int, idx int, body string")
    segments = spark.createDataFrame([(1, 0, "a", 1)], "k int, offset int, body string, total int")
    for out in (K.chunk_assemble(chunks, ["k"]), K.segment_assemble(segments, ["k"])):
        assert len(re.findall(r"Exchange ", out._jdf.queryExecution().executedPlan().toString())) == 1


def test_segments_with_nulls_and_repeats(spark):
    rows = [("a", 0, "abcd", 6), ("a", 2, "cdef", None), ("a", 2, "CDEF", 9), ("a", None, "zz", 9), ("b", 0, None, 3), ("c", 1, "late", 2), (None, 0, "q", 1)]
    out = K.segment_assemble(spark.createDataFrame(rows, "k string, offset long, body string, total int"), ["k"])
    assert {(r.k, r.payload, r.received, r.total, r.complete) for r in out.collect()} == {
        ("a", "abcdef", 6, 9, False), ("b", "", 0, 3, False), ("c", "", 0, 2, False), (None, "q", 1, 1, True)
    }
