"""A worker keeps for the next operator only what its own tasks need; tagging works in small blocks."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gridspark.llm import pii_tagger as P
from gridspark.llm import text as T


@pytest.fixture
def kept():
    found = T._kept()
    before = {k: v for k, v in found.items() if not k.startswith("__")}
    yield found
    for key in [k for k in found if not k.startswith("__")]:
        del found[key]
    found.update(before)


def test_other_objects_go_before_and_after_a_task(kept):
    T.worker_object("codec-a", object)
    mine = T.worker_object("mine-a", object)

    def run(batches):
        assert "codec-a" not in kept and kept["mine-a"] is mine
        T.worker_object("other-b", object)
        yield from batches

    assert list(T.tidy(run, "mine-")(iter([1, 2]))) == [1, 2]
    assert kept["mine-a"] is mine and "other-b" not in kept
    assert kept["__name__"]
    T.free_memory()
    assert "mine-a" not in kept


def tagger():
    rng = np.random.default_rng(3)
    words = ["plain", "words", "mail a.b@example.com", "call +44 20 7946 0958", "at 10.0.0.1", "card 4111 1111 1111 1111"]
    texts = [" ".join(rng.choice(words, 250)) for _ in range(500)]
    return P.train(texts[:20], steps=3), texts


def test_tagging_takes_little_beside_the_texts():
    model, texts = tagger()
    P.tag_texts(model, texts[:2])
    tracemalloc.start()
    P.tag_texts(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * sum(map(len, texts)) + 30_000_000, peak


def test_blocks_change_no_span(monkeypatch):
    model, texts = tagger()
    texts = [*texts[:40], "", "x", "10.0.0.1"]
    small = P.find_spans(model, texts)
    monkeypatch.setattr(P, "BLOCK", 2048)
    monkeypatch.setattr(P, "DOUBTFUL", 4096)
    assert P.find_spans(model, texts) == small


def test_batches_by_size_of_a_numbered_column():
    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(["a" * 30, None, "b" * 30, "c"])], names=["text", "text"])
    sizes = [b.num_rows for b in T.small_batches([batch], 1, rows=3, size=40)]
    assert sum(sizes) == 4 and len(sizes) > 1
    nulls = pa.record_batch([pa.nulls(3)], names=["text"])
    assert [b.num_rows for b in T.small_batches([nulls], "text", rows=2)] == [2, 1]
