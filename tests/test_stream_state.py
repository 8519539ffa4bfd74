"""The assembling processors on a state of their own that counts its reads."""

import random

import pandas as pd
import pytest

from gridspark.streaming.assemble import _ByIndex, _ByOffset, merged


class Values:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Map(dict):
    reads = 0

    def iterator(self):
        self.reads += 1
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self[key] = value


def processor(kind):
    made = kind(["k"], None)
    made.pieces, made.seen = Map(), Values()
    return made


def feed(made, batch):
    rows = pd.DataFrame(batch, columns=["at", "body", "total"])
    out = [r for part in made.handleInputRows(("g",), iter([rows]), None) for r in part.itertuples(index=False)]
    return [(r.payload, r.pieces) for r in out]


def plain(batches, by_offset):
    """The first batch after which everything seen so far makes up a payload, and that payload."""
    seen, total = {}, None
    for i, batch in enumerate(batches):
        for at, body, expected in batch:
            total = expected if expected is not None else total
            if at is not None and body is not None:
                seen[at] = body
        if total is None:
            continue
        if not by_offset:
            if len(seen) >= total:
                return i, "".join(seen[at] for at in sorted(seen)), len(seen)
            continue
        cells = {}
        for at in sorted(seen):
            cells.update({at + j: c for j, c in enumerate(seen[at])})
        end = max((at + len(body) for at, body in seen.items()), default=0)
        if len(cells) == end >= total and all(at <= end for at in seen):
            return i, "".join(cells[j] for j in range(end)), len(seen)
    return None


@pytest.mark.parametrize("by_offset", [False, True])
def test_any_order_of_pieces(by_offset):
    rng = random.Random(5)
    done = 0
    for _ in range(400):
        n = rng.randrange(0, 9)
        text = "".join(rng.choice("abcdefgh") for _ in range(3 * n))
        pieces = [(3 * i if by_offset else i, text[3 * i : 3 * i + 3], None) for i in range(n)]
        pieces = [p for p in pieces if rng.random() < 0.97] + rng.choices([(0, "xy", None), (3, "", None), (2, "pqrs", None), (None, "z", None)], k=rng.randrange(3))
        pieces.append((None, None, 3 * n if by_offset else n))
        rng.shuffle(pieces)
        batches = [pieces[i : i + 2] for i in range(0, len(pieces), 2)]
        made, got = processor(_ByOffset if by_offset else _ByIndex), None
        for i, batch in enumerate(batches):
            for payload, count in feed(made, batch):
                assert got is None
                got = (i, payload, count)
        assert got == plain(batches, by_offset), batches
        done += got is not None
    assert done > 100


def test_pieces_are_read_once():
    for made, step in ((processor(_ByIndex), 1), (processor(_ByOffset), 2)):
        order = list(range(200))
        random.Random(1).shuffle(order)
        out = [r for i in order for r in feed(made, [(i * step, "ab", 200 * step)])]
        assert out == [("ab" * 200, 200)] and made.pieces.reads == 1 and not made.pieces


def test_ranges_merge():
    assert merged([[5, 6], [0, 2], [2, 3], [9, 9], [6, 6]]) == [[0, 3], [5, 6], [9, 9]]
