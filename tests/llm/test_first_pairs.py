"""Pairs of a bucket's smallest node that cannot link do not get as far as leading tokens."""

import random
from collections import Counter

import numpy as np

from gridspark.llm import jaccard_join as J
from tests.llm.test_corpus import plain_groups


def test_strangers_of_a_passage_end_before_leading_tokens(spark, monkeypatch):
    rng = random.Random(21)
    passages = [[f"p{k}_{i}" for i in range(60)] for k in range(5)]  # each in too few texts to be frequent
    rows = []
    for i in range(40):
        text = passages[i % 5] + [f"w{rng.randrange(100000)}" for _ in range(rng.choice((150, 160, 1500, 1600)))]
        rows.append((2 * i, " ".join(text)))
        if i % 8 == 0:
            rows.append((2 * i + 1, " ".join(text[:-3] + ["changed"])))
    seen = []
    possible = J._possible
    monkeypatch.setattr(J, "_possible", lambda pairs, *rest: (seen.append(pairs.count()), possible(pairs, *rest))[1])
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == plain_groups(rows, 4, 85)
    assert seen and sum(seen) <= 10  # five link; about 40 share a bucket with its smallest node


def test_no_linking_pair_is_refuted(spark):
    rng = np.random.default_rng(22)
    rule = J.Rule()
    sets = []
    for n in (1, 2, 7, 40, 400, 800, 3000, 9000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for loss in (0.0, 0.04, 0.08, 0.3):
            extra = rng.integers(0, 1 << 63, int(n * loss)).astype(np.uint64)
            sets.append(np.unique(np.concatenate([a[: len(a) - int(n * loss)], extra])))
    wide = [J.wide_parity(x, rule) for x in sets]
    traits = [(i, len(x), J.parity(x).tolist(), None if w is None else w.tolist()) for i, (x, w) in enumerate(zip(sets, wide))]
    traits = spark.createDataFrame(traits, "node long, n long, parity array<long>, wide array<long>")
    every = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    got = {tuple(r) for r in J._fitting(spark.createDataFrame(every, "a long, b long"), traits, rule).collect()}

    def linked(a, b):
        shared = len(np.intersect1d(sets[a], sets[b]))
        return 100 * shared >= rule.percent * (len(sets[a]) + len(sets[b]) - shared)

    want = {pair for pair in every if linked(*pair)}
    assert len(want) > 10 and want <= got
    assert len(got) < len(every) / 4
