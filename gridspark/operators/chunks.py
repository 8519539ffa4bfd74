"""Payload text to indexed chunks and back, and segments that travel with donors.

Putting a payload together is a secondary sort: one shuffle brings a key's
pieces to one task, sorted by key and position, and a single pass over the
sorted rows joins them.  Rows of a key that is larger than memory are spilled by
the sort; the pass holds one payload, which has to be one value in the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspark.functions.payload import BODY_CHARS

OPENS = "__opens"


def hex_index(idx: Column) -> Column:
    """At least two lower-case hex digits."""
    digits = F.lower(F.hex(idx))
    return F.when(idx < 16, F.concat(F.lit("0"), digits)).otherwise(digits)


def chunk_explode(payloads: DataFrame, key: str, text: str, body_chars: int = BODY_CHARS) -> DataFrame:
    """``(key, idx, body, name)``; an empty payload has no chunk.

    The text is cut in one pass before it is exploded, so no row carries it along.
    """
    bodies = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{body_chars}}}"), F.lit(0))
    cut = payloads.select(key, F.posexplode(bodies).alias("idx", "body"))
    return cut.withColumn("name", F.concat(hex_index(F.col("idx")), "body"))


def _in_order(pieces: DataFrame, key: list[str], at: str, body: str) -> DataFrame:
    """Pieces by key and position; a repeated position keeps its greatest body, ``__opens`` marks a key's first row."""
    walk = Window.partitionBy(*key).orderBy(at, F.desc(body))
    marked = pieces.withColumns({OPENS: F.row_number().over(walk) == 1, "__before": F.lag(at).over(walk)})
    return marked.where(F.col(OPENS) | ~F.col("__before").eqNullSafe(F.col(at))).drop("__before")


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[list[pa.Array], list[dict]]]:
    """Per batch the keys that end in it and, for each, its rows so far as lists by column.

    The last key of a batch may go on in the next one, so it is handed out later.
    """
    held_key, held = None, None
    for batch in batches:
        opens = [i for i, first in enumerate(batch.column(OPENS).to_pylist()) if first]
        lists = {n: batch.column(n).to_pylist() for n in batch.schema.names if n not in (*key, OPENS)}
        if held is not None:
            upto = opens[0] if opens else batch.num_rows
            for n, values in lists.items():
                held[n] += values[:upto]
        if not opens:
            continue
        if held is not None:
            yield held_key, [held]
        ends = [*opens[1:], batch.num_rows]
        done = [{n: v[a:b] for n, v in lists.items()} for a, b in zip(opens, ends)]
        if len(done) > 1:
            yield [batch.column(k).take(pa.array(opens[:-1])) for k in key], done[:-1]
        held_key, held = [batch.column(k).slice(opens[-1], 1) for k in key], done[-1]
    if held is not None:
        yield held_key, [held]


def _joined(ordered: DataFrame, key: list[str], columns: list[str], out: str, join: Callable[[dict], tuple]) -> DataFrame:
    """``key`` and the fields of ``out``, which ``join`` makes of one key's rows."""
    schema = StructType([*(ordered.schema[k] for k in key), *StructType.fromDDL(out).fields])
    names = [f.name for f in schema.fields]

    def run(batches):
        for keys, groups in _groups(batches, key):
            made = zip(*(join(g) for g in groups))
            types = [_ARROW[f.dataType.typeName()] for f in schema.fields[len(key) :]]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(v, t) for v, t in zip(made, types))], names)

    return ordered.select(*key, OPENS, *columns).mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def chunk_assemble(chunks: DataFrame, key: list[str], idx: str = "idx", body: str = "body") -> DataFrame:
    """Bodies joined in index order, with ``complete`` false on a gap.

    A repeated index counts once (its greatest body stays).  A chunk without an
    index comes first and leaves the payload incomplete; without a body it adds nothing.
    """

    def join(rows: dict) -> tuple:
        known = [i for i in rows[idx] if i is not None]
        n = len(rows[idx])
        complete = known[0] == 0 and known[-1] == n - 1 if known else None
        return "".join(b for b in rows[body] if b is not None), n, complete

    ordered = _in_order(chunks.select(*key, idx, body), key, idx, body)
    return _joined(ordered, key, [idx, body], "payload string, n_chunks long, complete boolean", join)


def missing_chunks(expected: DataFrame, registered: DataFrame, key: list[str], count: str = "expected") -> DataFrame:
    """Indexes below the expected count that no chunk carries yet."""
    todo = expected.select(*key, count).distinct()
    todo = todo.where(F.col(count) > 0).select(
        *key, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)).alias("idx")
    )
    return todo.join(registered.select(*key, "idx"), [*key, "idx"], "left_anti")


def first_incomplete(progress: DataFrame, key: list[str], idx: str = "idx") -> DataFrame:
    """Lowest index with ``done < total``, -1 when all are done."""
    open_idx = F.when(F.col("done") < F.col("total"), F.col(idx))
    return progress.groupBy(*key).agg(F.coalesce(F.min(open_idx), F.lit(-1)).alias("next_idx"))


def group_complete(members: DataFrame, key: list[str], idx: str = "idx", expected: str = "expected") -> DataFrame:
    """Progress of each group: distinct member indexes seen against the number expected."""
    seen = members.groupBy(*key, idx).agg(F.max(expected).alias("__e"))
    return seen.groupBy(*key).agg(
        F.count(F.lit(1)).alias("seen"), F.max("__e").alias("total")
    ).withColumn("complete", F.col("seen") == F.col("total"))


def group_consistent(tiles: DataFrame, key: list[str], frame_count: str, full_colour: bool = False) -> DataFrame:
    """Groups of two or more tiles that all have the same frame count (at least 2, or 1 in full colour)."""
    least = 1 if full_colour else 2
    g = tiles.groupBy(*key).agg(
        F.count(F.lit(1)).alias("tiles"), F.min(frame_count).alias("frames"), F.max(frame_count).alias("__hi")
    )
    ok = (F.col("tiles") >= 2) & (F.col("frames") == F.col("__hi")) & (F.col("frames") >= least)
    return g.where(ok).drop("__hi")


def even_split(totals: DataFrame, key: list[str], n_bytes: str, n_parts: Column) -> DataFrame:
    """``n_bytes`` in ordered parts as even as can be; the first ones take one byte more."""
    t = F.col("__t")
    base = F.floor(F.col(n_bytes) / t)
    rem = F.col(n_bytes) % t
    parts = totals.withColumn("__t", n_parts.cast("long"))
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), t - 1)))
    p = F.col("part")
    return parts.select(
        *key,
        "part",
        (p * base + F.least(p, rem)).alias("offset"),
        (base + F.when(p < rem, 1).otherwise(0)).alias("len"),
    )


def route_segments(segments: DataFrame, receivers: DataFrame, key: list[str]) -> DataFrame:
    """Donor segments joined to the receiver they belong to."""
    return segments.join(receivers, key)


def overlay(pieces: Iterator[tuple[int, str]]) -> str:
    """Pieces in order of their starts, laid over one another up to the first gap; the later start counts."""
    out: list[str] = []
    open_pieces: list[tuple[int, int, str]] = []  # those that reach farther than all after them: start, end, text
    at = reach = 0

    def upto(end: int) -> None:
        nonlocal at
        while at < end:
            start, stop, text = open_pieces[-1]
            if stop <= at:
                open_pieces.pop()
                continue
            out.append(text[at - start : min(end, stop) - start])
            at = min(end, stop)

    for start, text in pieces:
        if start > reach:
            break
        upto(start)
        open_pieces.append((start, start + len(text), text))
        reach = max(reach, start + len(text))
    upto(reach)
    return "".join(out)


def segment_assemble(segments: DataFrame, key: list[str], total: str = "total") -> DataFrame:
    """Receiver payload from ``(key, offset, body, total)`` pieces placed at their offsets.

    A repeated offset counts once (its greatest body stays); where pieces
    overlap, the one that starts later counts.  ``received`` counts the
    characters up to the first gap, where the payload ends too; it is complete
    when they reach the total.  A piece without an offset or a body is none.
    """

    def join(rows: dict) -> tuple:
        payload = overlay((o, b) for o, b in zip(rows["offset"], rows["body"]) if o is not None and b is not None)
        return payload, len(payload), rows["__total"][0]

    whole = segments.withColumn("__total", F.max(total).over(Window.partitionBy(*key)).cast("long"))
    ordered = _in_order(whole.select(*key, "offset", "body", "__total"), key, "offset", "body")
    placed = _joined(ordered, key, ["offset", "body", "__total"], "payload string, received long, total long", join)
    return placed.withColumn("complete", F.col("received") >= F.col("total"))
