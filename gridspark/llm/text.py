"""Helpers of the corpus operators: words and their hashes in numpy, Arrow columns, objects kept by a worker.

Words are runs of bytes other than space and 0x09-0x0D.  A word's hash is a
polynomial over its bytes (mod 2^64, random byte table), so a whole text is
hashed by one cumulative sum; the result is scrambled by the splitmix finaliser.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 1 << 18
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def numbered(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = numbered(256, 11)
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_COMBINE = numbered(64, 23) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _kept() -> dict[str, object]:
    return sys.modules.setdefault("gridspark_worker_objects", types.ModuleType("gridspark_worker_objects")).__dict__


def worker_object(key: str, make: Callable[[], object]) -> object:
    """An object that a Python process makes once and keeps for later tasks."""
    kept = _kept()
    if key not in kept:
        kept[key] = make()
    return kept[key]


def free_memory(*keep: str) -> None:
    """Drops the worker's objects whose keys start otherwise than ``keep``, and gives free pages of Arrow and of the C library back."""
    kept = _kept()
    others = [k for k in kept if not k.startswith(("__", "powers-", *keep))]
    for key in others:
        del kept[key]
    if others:
        gc.collect()  # a codec and its pieces refer to each other
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator], *keep: str) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, in a worker that starts and ends the task without what others left there: Spark goes on using
    its workers, and what they hold counts beside the next operator's memory."""

    def tidied(batches: Iterator) -> Iterator:
        free_memory(*keep)
        yield from run(batches)
        free_memory(*keep)

    return tidied


def share(spark: SparkSession, thing: object) -> Callable[[], object]:
    """A broadcast that takes its classes along, so that executors need no copy of this package; call it once a task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(sent.value)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int, size: int) -> np.ndarray:
        out = np.ones(size, dtype=_U)
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            out[filled : filled + step] = out[:step] * _U(pow(base, filled, 1 << 64))
            filled += step
        return out

    size = SEGMENT
    while size < n:
        size *= 2
    return worker_object(f"powers-{size}", lambda: (table(_BASE, size), table(_INVERSE, size)))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """One 64-bit number per word; with ``fold_case`` A-Z count as a-z."""
    table = _FOLDED if fold_case else _BYTE
    out = np.empty(len(starts), dtype=_U)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(starts):
            low = starts[done]
            upto = max(done + 1, int(np.searchsorted(ends, low + SEGMENT, side="right")))
            part = buf[low : ends[upto - 1]]
            power, inverse = _powers(len(part) + 1)
            total = np.zeros(len(part) + 1, dtype=_U)
            np.cumsum(table[part] * power[: len(part)], out=total[1:])
            s, e = starts[done:upto] - low, ends[done:upto] - low
            out[done:upto] = (total[e] - total[s]) * inverse[s] + (e - s).astype(_U)
            done = upto
    return mix(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One number per window of ``size`` words; none for fewer words."""
    if len(words) < size:
        return np.empty(0, dtype=_U)
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        total = words[:n] * _COMBINE[0]
        for i in range(1, size):
            total += words[i : i + n] * _COMBINE[i]
    return mix(total)


def repeated_words(words: np.ndarray, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words which occurs twice or more."""
    windows = window_hashes(words, size)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twin = np.zeros(len(windows), bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twin)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def utf8_views(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of every value of a string column, without copying; empty for nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    edges = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield body[edges[i] : edges[i + 1]] if valid[i] else body[:0]


def small_batches(batches: Iterator[pa.RecordBatch], column: str | int, rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``rows`` rows and about ``size`` bytes of one column, so that what is made of a batch stays small."""
    for batch in batches:
        values = batch.column(column)
        values = values.cast(pa.string()) if pa.types.is_null(values.type) else values
        lengths = pa.compute.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
        number = np.maximum(np.cumsum(lengths, dtype=np.int64) // size, np.arange(len(lengths)) // rows)
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(lengths)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield batch.slice(a, b - a)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_arrow_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs started inside send Python at most ``rows`` rows at once, so that whole texts cost little memory on either side.

    Results do not depend on the size, so another job of the session may run meanwhile.
    """
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(before))) if int(before) > 0 else str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


BITMAPS, BITMAP = 128, 1 << 15


def may_hold(rows: DataFrame, keys: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` and whether their key (binary) may be among ``keys``: false only where it is not.

    One bit for each of 2^22 slots, as at most 128 bitmaps of 4 KB that are broadcast whatever the number of keys.
    """
    slot = F.crc32(F.col(key)) % (BITMAPS * BITMAP)
    maps = keys.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / BITMAP).alias("__map"))
    maps = maps.agg(F.bitmap_construct_agg((F.col("slot") % BITMAP)).alias("__bits"))
    place = slot % BITMAP
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (place % 8).cast("int")) == 1
    joined = rows.join(F.broadcast(maps), F.floor(slot / BITMAP) == F.col("__map"), "left")
    return joined.select(*rows.columns, F.coalesce(held, F.lit(False)).alias(out))


def row_numbers() -> Iterator[int]:
    """Numbers that no other task gives; stable once the rows are written."""
    base = TaskContext.get().partitionId() << 36
    n = 0
    while True:
        yield base + n
        n += 1


def fold(column: str, parts: int) -> Column:
    """crc32 of a column written as text, modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def unit_interval(column: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on the value alone (52 bits of an md5)."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(column.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def read(spark, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
