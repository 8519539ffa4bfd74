"""Training takes a few bytes of the driver per character of its sample."""

import tracemalloc

import numpy as np

from gridspark.llm import pii_tagger as P
from gridspark.llm.nets import cut_windows, window_starts


def sample(n, length):
    rng = np.random.default_rng(4)
    words = ["plain", "words", "mail a.b@example.com", "call +44 20 7946 0958", "at 10.0.0.1", "naïve", "card 4111 1111 1111 1111"]
    texts = [" ".join(rng.choice(words, length // 8, p=[0.4, 0.4, 0.04, 0.04, 0.04, 0.04, 0.04]))[:length] for _ in range(n)]
    return [*texts, "", "x", "10.0.0.1"]


def test_training_memory():
    texts = sample(600, 4000)
    characters = sum(map(len, texts))
    P.train(texts[-3:], steps=1)
    tracemalloc.start()
    P.train(texts, steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * characters + 8_000_000, peak / characters


def test_windows_that_hold_a_tag():
    texts = sample(20, 500)
    lengths = np.array([len(t) for t in texts], np.int64)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    tags = np.random.default_rng(1).choice(5, lengths.sum(), p=[0.97, 0.01, 0.01, 0.01, 0]).astype(np.int8)
    text, start = window_starts(lengths, 96, 48)
    laid_out, _ = cut_windows(tags, edges, text, start, 96, 0)
    low = edges[text] + start
    high = low + np.minimum(96, lengths[text] - start)
    for tag in range(1, 5):
        assert (P.windows_with(tags, tag, low, high) == np.flatnonzero((laid_out == tag).any(axis=0))).all()
