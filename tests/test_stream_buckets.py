"""Groups taken by the bucket: like each group for itself, with few calls of the state."""

import json
import random

import pytest
from pyspark.sql import Row

from gridspark.streaming import assemble as A

COLUMNS = Row("key", "at", "body", "total", "__id")


class Values:
    def __init__(self, calls):
        self.value, self.calls = None, calls

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


class Map(dict):
    def __init__(self, calls):
        super().__init__()
        self.calls = calls

    def getValue(self, key):
        self.calls.append("get")
        return self.get(key)

    def updateValue(self, key, value):
        self.calls.append("update")
        self[key] = value

    def removeKey(self, key):
        self.calls.append("remove")
        del self[key]


def bucket(kind):
    made, calls = A._Buckets(kind(["key"], None)), []
    made.groups, made.waiting, made.pieces = Values(calls), Map(calls), Map(calls)
    return made, calls


def feed(made, batch):
    rows = [COLUMNS(*row, json.dumps(row[0])) for row in batch]
    return [tuple(row) for row in made.handleInputRows((0,), iter(rows), None)]


def alone(kind, batches):
    """What the processor gives when every group has a state of its own."""
    from test_stream_state import feed as feed_one
    from test_stream_state import processor

    states, out = {}, []
    for i, batch in enumerate(batches):
        for group in dict.fromkeys(row[0] for row in batch):
            made = states.setdefault(group, processor(kind))
            out += [(i, group, *found) for found in feed_one(made, [row[1:] for row in batch if row[0] == group])]
    return out


@pytest.mark.parametrize("kind", [A._ByIndex, A._ByOffset])
def test_like_each_group_for_itself(kind, monkeypatch):
    monkeypatch.setattr(A, "ROOM", 3)
    rng, step = random.Random(8), 3 if kind is A._ByOffset else 1
    done = 0
    for _ in range(60):
        rows = []
        for group in (None, *range(6)):
            n = rng.randrange(0, 9)
            rows += [(group, step * i, rng.choice(["abc", "xyz"]), None) for i in range(n) if rng.random() < 0.98]
            rows += rng.choices([(group, 0, "xy", None), (group, 3, "", None), (group, 2, "pqrs", None), (group, None, "z", None)], k=rng.randrange(4))
            rows += [(group, None, None, step * n)] * rng.choice([1, 1, 1, 2])
        rng.shuffle(rows)
        batches = [rows[i : i + 5] for i in range(0, len(rows), 5)]
        made, _ = bucket(kind)
        got = [(i, *found) for i, batch in enumerate(batches) for found in feed(made, batch)]
        assert got == alone(kind, batches)
        waiting = set(json.loads(made.groups.value[1]))
        assert {k[0] for k in made.waiting} == waiting and {k[0] for k in made.pieces} <= waiting
        done += len(got)
    assert done > 100


def test_groups_done_in_a_batch_share_two_calls():
    made, calls = bucket(A._ByIndex)
    out = feed(made, [(g, i, f"{g}.{i}", 2) for g in range(500) for i in (1, 0)])
    assert out == [(g, f"{g}.0{g}.1", 2) for g in range(500)]
    assert calls == ["get", "update"] and not made.pieces and not made.waiting
    assert feed(made, [(g, 0, "again", 2) for g in range(500)]) == [] and calls == ["get", "update", "get"]


def test_replaced_pieces_do_not_pile_up():
    made, calls = bucket(A._ByIndex)
    for i in range(1000):
        assert feed(made, [("g", i % 2, f"v{i}", 3)]) == []
        assert len(made.pieces) <= A.ROOM
    assert len(calls) < 10_000
    assert feed(made, [("g", 2, "end", None)]) == [("g", "v998v999end", 3)]
    assert not made.pieces and not made.waiting


def test_pieces_are_read_once():
    made, calls = bucket(A._ByOffset)
    order = list(range(40))
    random.Random(1).shuffle(order)
    out = [r for i in order for r in feed(made, [("g", 2 * i, "ab", 80)])]
    assert out == [("g", "ab" * 40, 40)] and not made.pieces
    # per batch the bucket, what waits and the piece; in the end the 39 held pieces are read
    assert calls.count("get") == 40 + 39 + 39
