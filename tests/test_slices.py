"""Running values and pages where one group holds nearly all rows, whatever its order values look like."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators.history import page
from gridspark.operators.scan import SLICE, carries, cut, row_number, rows_between, running_sum, scan

WIDTH = 100


def spreads():
    rng = random.Random(9)
    return {
        "a billion apart": [i * 1_000_000_000 for i in range(5000)],
        "an outlier on either side": [-(1 << 63), *range(5000), (1 << 63) - 1],
        "powers": sorted({s * 2**k + rng.randrange(1000) for k in range(50) for s in (1, -1) for _ in range(50)}),
    }


@pytest.mark.parametrize("name", list(spreads()))
def test_slices_are_bounded(spark, name):
    values = sorted(set(spreads()[name]))
    rows = spark.createDataFrame([("hot", v, 1) for v in values] + [(None, 5, 1), ("small", 7, 1)], "k string, o long, w int").repartition(6)
    sliced, key, several = cut(rows, ["k"], "o", WIDTH)
    sizes = [r["count"] for r in sliced.groupBy(*key, SLICE).count().collect()]
    assert several and max(sizes) <= WIDTH and len(sizes) <= 8 * len(values) / WIDTH + 60
    got = {(r.k, r.o): (r.n, r.s) for r in scan(rows, ["k"], "o", {"n": row_number(), "s": running_sum(F.col("w") * 2)}, WIDTH).collect()}
    want = {("hot", v): (i + 1, 2 * i + 2) for i, v in enumerate(values)}
    assert got == want | {(None, 5): (1, 2), ("small", 7): (1, 2)}
    middle = rows_between(rows, ["k"], "o", F.lit(2001), F.lit(2010), WIDTH).collect()
    assert {(r.o, r.row_no, r.total) for r in middle} == {(values[i], i + 1, len(values)) for i in range(2000, 2010)}


def test_rows_without_an_order_are_split(spark):
    rows = spark.range(3000).select(F.lit("hot").alias("k"), F.when(F.col("id") >= 2500, F.col("id")).alias("o"), F.col("id").alias("v"))
    sliced, key, _ = cut(rows, ["k"], "o", WIDTH)
    # a hash deals them, so slices come near the width instead of under it
    assert max(r["count"] for r in sliced.groupBy(*key, SLICE).count().collect()) <= 2 * WIDTH
    got = scan(rows, ["k"], "o", {"n": row_number()}, WIDTH).collect()
    assert sorted(r.n for r in got) == list(range(1, 3001))
    assert {r.n - 1 for r in got if r.o is None} == set(range(2500)) and all(r.n == r.o + 1 for r in got if r.o is not None)


def test_tied_rows_follow_their_ties(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("o"), F.col("id").alias("t"))
    got = {(r.o, r.t): r.n for r in scan(rows, [], "o", {"n": row_number()}, WIDTH, ties=("t",)).collect()}
    assert got == {(o, t): o * 500 + t // 2 + 1 for t in range(1000) for o in [t % 2]}


def test_small_groups_carry_nothing(spark):
    rows = spark.range(500).select((F.col("id") % 20).alias("k"), F.col("id").alias("o"))
    out = scan(rows, ["k"], "o", {"n": row_number()}, WIDTH)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.k, r.o): r.n for r in out.collect()} == {(i % 20, i): i // 20 + 1 for i in range(500)}


def test_pages_of_a_hot_group(spark):
    rows = spark.range(4000).select(F.lit(None).cast("string").alias("k"), (F.col("id") * 1_000_000_007).alias("o"))
    last = page(rows, ["k"], "o", 10**6).collect()
    assert [(r.row_no, r.pages) for r in sorted(last, key=lambda r: r.row_no)] == [(n, 400) for n in range(3991, 4001)]


def test_carries_name_every_slice(spark):
    rows = spark.range(1000).select(F.col("id").alias("o"))
    sliced, key, _ = cut(rows, [], "o", WIDTH)
    found = carries(sliced, key, {"n": row_number()}).orderBy(SLICE).collect()
    assert sum(r["__f_n"] for r in found) == 1000
    assert [r["__c_n"] or 0 for r in found] == [sum(x["__f_n"] for x in found[:i]) for i in range(len(found))]
