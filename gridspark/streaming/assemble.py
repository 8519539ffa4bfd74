"""Assembly of payloads whose pieces arrive in any order.

State is kept per group and bounded: a group holds one entry per index (or
offset) it expects.  Entries stay until their group is done, unless the caller
lets them expire after ``ttl_ms``.

Beside the pieces a group keeps the ranges of positions that have come in, merged
as they come.  A batch reads these few numbers, adds its own pieces and leaves the
others where they are; the pieces are read when the ranges say that nothing is
missing.  The ranges may say too much (a piece that was replaced by a shorter one,
or that expired), never too little, so the pieces have the last word.

Calls and state reads cost a millisecond or so each, so groups that do not expire
are taken by the bucket: a bucket's groups in a batch are one call, and one value
tells which of them are done and which wait.  Only waiting groups have state of
their own.  With ``ttl_ms`` every group is a call, as each expires for itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PIECE_KEY = StructType([StructField("at", LongType())])
PIECE_VALUE = StructType([StructField("body", StringType())])
SEEN = StructType([StructField("total", LongType()), StructField("done", IntegerType()), StructField("covered", StringType())])

BUCKETS = 1 << 13
#: Pieces that a waiting group holds before those that were replaced are dropped.
ROOM = 64
GROUPS = StructType([StructField("done", StringType()), StructField("waiting", StringType())])
WAITING_KEY = StructType([StructField("id", StringType())])
WAITING = StructType([StructField("total", LongType()), StructField("held", LongType()), StructField("room", LongType()), StructField("covered", StringType())])
SLOT_KEY = StructType([StructField("id", StringType()), StructField("slot", LongType())])
SLOT = StructType([StructField("at", LongType()), StructField("body", StringType())])

Ranges = list[list[int]]


def merged(ranges: Ranges) -> Ranges:
    """Sorted ranges [from, to) without those that touch or overlap; an empty one stays where nothing touches it."""
    out: Ranges = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


class _Pieces(StatefulProcessor):
    """Collects ``at -> body`` pieces and emits their concatenation once, when all are in."""

    def __init__(self, keys: list[str], ttl_ms: int | None):
        self.keys, self.ttl_ms = keys, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getMapState("pieces", PIECE_KEY, PIECE_VALUE, self.ttl_ms)
        self.seen = handle.getValueState("seen", SEEN, self.ttl_ms)

    def span(self, at: int, body: str) -> list[int]:
        """The range of positions that a piece covers."""
        raise NotImplementedError

    def complete(self, covered: Ranges, total: int) -> bool:
        """Whether pieces over these ranges can make up a payload."""
        raise NotImplementedError

    def whole(self, pieces: dict[int, str], total: int) -> str | None:
        """The payload, if the pieces make up all of it."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        total, done, ranges = self.seen.get() if known else (None, 0, "[]")
        if done:
            return
        fresh: dict[int, str] = {}
        for pdf in rows:
            for at, body, expected in zip(pdf["at"], pdf["body"], pdf["total"]):
                if pd.notna(expected):
                    total = int(expected)
                if pd.notna(at) and body is not None:
                    fresh[int(at)] = body
        covered = merged([*json.loads(ranges), *(self.span(at, body) for at, body in fresh.items())])
        if total is not None and self.complete(covered, total):
            # state is read only for groups that outlive a batch, and only when they may be done
            held = {k[0]: v[0] for k, v in self.pieces.iterator()} if known else {}
            pieces = {**held, **fresh}
            payload = self.whole(pieces, total)
            if payload is not None:
                if held:
                    self.pieces.clear()
                self.seen.update((total, 1, "[]"))
                yield pd.DataFrame([(*key, payload, len(pieces))], columns=[*self.keys, "payload", "pieces"])
                return
            covered = merged([self.span(at, body) for at, body in pieces.items()])
        for at, body in fresh.items():
            self.pieces.updateValue((at,), (body,))
        self.seen.update((total, 0, json.dumps(covered)))

    def close(self) -> None:
        pass


class _ByIndex(_Pieces):
    def span(self, at: int, body: str) -> list[int]:
        return [at, at + 1]

    def complete(self, covered: Ranges, total: int) -> bool:
        return sum(hi - lo for lo, hi in covered) >= total

    def whole(self, pieces: dict[int, str], total: int) -> str | None:
        return "".join(pieces[at] for at in sorted(pieces)) if len(pieces) >= total else None


class _ByOffset(_Pieces):
    def span(self, at: int, body: str) -> list[int]:
        return [at, at + len(body)]

    def complete(self, covered: Ranges, total: int) -> bool:
        # without any piece only an empty payload is complete
        return total <= 0 if not covered else len(covered) == 1 and covered[0][0] <= 0 and covered[0][1] - covered[0][0] >= total

    def whole(self, pieces: dict[int, str], total: int) -> str | None:
        if sum(map(len, pieces.values())) < total:
            return None
        done, tail = [], ""  # `tail` is what may still be overwritten
        start = 0
        for at in sorted(pieces):
            if at > start + len(tail):
                return None
            body = pieces[at]
            done.append(tail[: at - start])
            start, tail = at, body + tail[at - start + len(body) :]
        done.append(tail)
        payload = "".join(done)
        return payload if len(payload) >= total else None


class _Buckets(StatefulProcessor):
    """Does for all groups of a bucket what ``of`` does for one.

    A waiting group's pieces are numbered as they come.  Replaced ones stay until
    their number passes the group's room, twice the pieces that counted last time.
    """

    def __init__(self, of: _Pieces):
        self.of = of

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.groups = handle.getValueState("groups", GROUPS)
        self.waiting = handle.getMapState("waiting", WAITING_KEY, WAITING)
        self.pieces = handle.getMapState("pieces", SLOT_KEY, SLOT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done, waiting = (set(json.loads(ids)) for ids in self.groups.get() or ("[]", "[]"))
        arrived: dict[str, tuple[tuple, list, dict[int, str]]] = {}
        for row in rows:
            if row["__id"] in done:
                continue
            _, total, fresh = arrived.setdefault(row["__id"], (tuple(row[k] for k in self.of.keys), [None], {}))
            if row["total"] is not None:
                total[0] = row["total"]
            if row["at"] is not None and row["body"] is not None:
                fresh[row["at"]] = row["body"]
        made = Row(*self.of.keys, "payload", "pieces")
        out, before = [], (len(done), len(waiting))
        for group, (names, total, fresh) in arrived.items():
            found = self.taken(group, total[0], fresh, group in waiting)
            if found is None:
                waiting.add(group)
            else:
                waiting.discard(group)
                done.add(group)
                out.append(made(*names, *found))
        if (len(done), len(waiting)) != before:
            self.groups.update((json.dumps(list(done)), json.dumps(list(waiting))))
        yield from out

    def taken(self, group: str, total: int | None, fresh: dict[int, str], known: bool) -> tuple[str, int] | None:
        """Takes the pieces of a group in; its payload and number of pieces, if they complete it."""
        held, room, covered = 0, ROOM, []
        if known:
            before, held, room, ranges = self.waiting.getValue((group,))
            total, covered = before if total is None else total, json.loads(ranges)
        covered = merged([*covered, *(self.of.span(at, body) for at, body in fresh.items())])
        ready, crowded = total is not None and self.of.complete(covered, total), held + len(fresh) > room
        if ready or crowded:
            pieces = dict(self.pieces.getValue((group, i)) for i in range(held)) | fresh
            payload = self.of.whole(pieces, total) if ready else None
            if payload is not None:
                self._drop(group, 0, held)
                if known:
                    self.waiting.removeKey((group,))
                return payload, len(pieces)
            covered = merged([self.of.span(at, body) for at, body in pieces.items()])
            if crowded:
                self._drop(group, len(pieces), held)
                held, room, fresh = 0, max(ROOM, 2 * len(pieces)), pieces
        for i, (at, body) in enumerate(fresh.items(), held):
            self.pieces.updateValue((group, i), (at, body))
        self.waiting.updateValue((group,), (total, held + len(fresh), room, json.dumps(covered)))
        return None

    def _drop(self, group: str, start: int, end: int) -> None:
        for i in range(start, end):
            self.pieces.removeKey((group, i))

    def close(self) -> None:
        pass


def _run(rows: DataFrame, keys: list[str], processor: _Pieces) -> DataFrame:
    schema = StructType(
        [
            *(f for f in rows.schema.fields if f.name in keys),
            StructField("payload", StringType()),
            StructField("pieces", LongType()),
        ]
    )
    rows = rows.select(*keys, "at", "body", "total")
    if processor.ttl_ms is not None:
        return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "processingTime")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("__bucket")
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("__id")
    return rows.select(bucket, group, "*").groupBy("__bucket").transformWithState(_Buckets(processor), schema, "Append", "none")


def stream_group_assemble(parts: DataFrame, keys: list[str], ttl_ms: int | None = None) -> DataFrame:
    """Buffer ``(keys, at, body, total)`` parts; emit a group once, when ``total`` indexes are in.

    A repeated index replaces the earlier body and is not counted twice.
    """
    return _run(parts, keys, _ByIndex(keys, ttl_ms))


def stream_segment_assemble(segments: DataFrame, keys: list[str], ttl_ms: int | None = None) -> DataFrame:
    """Place byte segments of a receiver; emit it once, when ``total`` characters are in without a gap.

    Donor segments carry no total.  They wait in the state until the
    receiver's own segment, which knows it, appears.  A repeated offset
    replaces; where segments overlap, the one that starts later counts.
    """
    return _run(segments, keys, _ByOffset(keys, ttl_ms))


def stream_first_seen(rows: DataFrame, keys: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Let each id through once.  With an event time, ids are remembered for ``delay``."""
    if event_time is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
