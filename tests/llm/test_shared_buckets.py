"""A pair of nodes that shares many buckets is met once."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridspark.llm import jaccard_join as J

TRAITS = "node long, n long, parity array<long>, wide array<long>"


def opened(spark, members, done):
    """The open rows of buckets ``token -> nodes``; every node is a group of its own."""
    shared = spark.createDataFrame([(t, node) for t, nodes in members.items() for node in nodes], "token long, node long")
    groups = spark.createDataFrame([], "node long, root long")
    nodes = sorted({node for held in members.values() for node in held})
    traits = spark.createDataFrame([(node, 100, [0] * (J.PARITY_BITS // 64), None) for node in nodes], TRAITS)
    return J._open(shared, groups, traits, done)


def met(rows, low, high):
    return Counter((r["a"], r["b"]) for r in J._meetings(rows, low, high, J.Rule()).collect())


def test_copies_meet_once(spark):
    rows = opened(spark, {(-1) ** t * t * 1000: range(12) for t in range(1, 41)}, 1)
    got = met(rows, 1, 64)
    assert got == Counter({(a, b): 1 for a in range(1, 12) for b in range(a + 1, 12)})


@pytest.mark.parametrize("first", [1, 2, 8])
def test_no_pair_is_lost(spark, monkeypatch, first):
    monkeypatch.setattr(J, "FIRST", first)
    rng = random.Random(first)
    members = {rng.randrange(-(1 << 62), 1 << 62): sorted(rng.sample(range(40), rng.randrange(2, 15))) for _ in range(60)}
    for low, high in ((1, 3), (3, 9), (9, 64)):
        rows = opened(spark, members, low)
        want = Counter()
        for nodes in members.values():
            for i, a in enumerate(nodes[low:high], low):
                want.update((a, b) for b in nodes[i + 1 :])
        got = met(rows, low, high)
        assert set(got) == set(want) and all(got[pair] <= want[pair] for pair in got)
        assert sum(got.values()) <= sum(want.values())
        assert rows.agg(F.max(F.size("lowest"))).first()[0] <= first
