"""Running values over groups too large for one task.

A plain window function sorts each group inside a single task.  Here the rows
of large groups are counted first and cut into slices of at most ``width``
rows along their integer order column; a slice is summarised (a normal partial
aggregation), the summaries of earlier slices are added up per group, and only
then is each slice scanned on its own.  A group that holds a third of the table
is thus spread over many tasks.  Groups of up to ``width`` rows are one slice,
and a table without larger ones is scanned without any carry.

Slices follow the rows, not the values.  A group is cut into equal ranges of
its order values; ranges that still hold too many rows are cut again by their
own bounds, until none does.  Each cut narrows a range to its share, so values
of any spread take few rounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import cut_lineage

SLICE = "__slice"
KEY = "__key"
NODE = "__node"
WIDTH = 1 << 16


@dataclass(frozen=True)
class Running:
    """One running value: how to fold a slice, how to scan it, how to join both."""

    fold: Column
    scan: Column
    carry: object
    combine: object


def row_number() -> Running:
    """1, 2, 3 ... in order."""
    return Running(F.count(F.lit(1)), F.count(F.lit(1)), F.sum, lambda carry, local: F.coalesce(carry, F.lit(0)) + local)


def running_sum(value: Column) -> Running:
    return Running(F.sum(value), F.sum(value), F.sum, lambda carry, local: F.coalesce(carry, F.lit(0)) + local)


def running_xor(value: Column) -> Running:
    return Running(
        F.bit_xor(value),
        F.bit_xor(value),
        F.bit_xor,
        lambda carry, local: F.coalesce(carry, F.lit(0)).bitwiseXOR(local),
    )


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, so rows without a key are kept."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(and_, (left[k].eqNullSafe(named[f"__r_{k}"]) for k in keys), F.lit(True))
    return left.join(named, same, how).drop(*(f"__r_{k}" for k in keys))


LOWEST, WIDE = -(1 << 63), 1 << 62


def cut(df: DataFrame, keys: list[str], order: str, width: int, tied: bool = False) -> tuple[DataFrame, list[str], bool]:
    """Append the slice of each row and its keys as one struct; tell whether any group has several slices.

    A slice is a struct that sorts as its rows do.  Structs with null fields
    compare as equal, so a null key is a group like any other.  Rows without an
    order value come first.  Rows with equal order values (or none) are dealt
    over slices by a hash of the row, unless ``tied`` says that further columns
    order them.  Counting starts a job, and one more for each round of cuts of
    groups whose values are sparse.
    """
    value = F.col(order).cast("long")
    rows = df.withColumns(
        {KEY: F.struct(*(keys or [F.lit(0)])), "__at": F.when(value.isNotNull(), F.lit(LOWEST)), "__part": F.lit(0)}
    )
    waiting, several = rows, False
    while True:
        held = waiting.groupBy(F.struct(KEY, "__at").alias(NODE)).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
        )
        one = F.col("lo").isNull() | (F.col("lo") == F.col("hi"))
        large = _at_hand(held.where((F.col("n") > width) & ~one if tied else F.col("n") > width))
        if large is None:
            break
        several = True
        # the bounds may be 2^64 apart: decimals in the plan's few rows, and cells of 2^61 where longs would overflow
        span = (F.col("hi").cast("decimal(20,0)") - F.col("lo") + 1).cast("decimal(20,0)")
        wide = span > WIDE
        # where values are dense, ranges of ``width`` values cannot hold more rows, so nothing is left to count
        dense = span <= F.col("n").cast("decimal(20,0)") * 4
        cells = F.when(dense, F.ceil(span / width)).otherwise(F.ceil(F.col("n") * 2 / width))
        step = F.greatest(F.ceil(span / cells), F.lit(1)).cast("long")
        plan = large.select(
            F.col(NODE).alias("__cut"),
            F.when(~one & ~wide, F.col("lo")).when(~one, F.lit(0)).cast("long").alias("__lo"),
            F.when(~one & ~wide, step).when(~one, F.lit(WIDE // 2)).alias("__step"),
            F.when(one, F.ceil(F.col("n") / width).cast("int")).alias("__parts"),
            (~one & ~dense).alias("__sparse"),
        )
        joined = rows.join(plan, F.struct(KEY, "__at") == F.col("__cut"), "left")
        cell = value - F.pmod(value - F.col("__lo"), F.col("__step"))
        at = F.when(F.col("__step").isNotNull(), cell).otherwise(F.col("__at"))
        own = F.pmod(F.xxhash64(*df.columns), F.col("__parts")).cast("int")
        part = F.when(F.col("__parts").isNotNull(), own).otherwise(F.col("__part"))
        moved = joined.select(*df.columns, KEY, at.alias("__at"), part.alias("__part"), "__sparse")
        waiting, rows = moved.where("__sparse"), moved.drop("__sparse")
        if plan.where("__sparse").isEmpty():
            break
    sliced = rows.withColumn(SLICE, F.struct("__at", "__part")).drop("__at", "__part")
    return sliced, [KEY], several


FEW = 1000


def _at_hand(found: DataFrame) -> DataFrame | None:
    """A few rows as a local table, more of them written; None for none."""
    some = found.limit(FEW + 1).collect()
    if not some:
        return None
    if len(some) <= FEW:
        return found.sparkSession.createDataFrame(some, found.schema)
    return cut_lineage(found, "slices")


def scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    outputs: dict[str, Running],
    width: int = WIDTH,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Append inclusive running values over ``keys`` in ``order`` (an integer column).

    ``(order, *ties)`` must be unique inside a group, or the result is as
    arbitrary as a row number over ties always is.
    """
    sliced, key, several = cut(df, keys, order, width, bool(ties))
    if several:
        sliced = sliced.join(carries(sliced, key, outputs), [*key, SLICE])
    # a group of one slice starts at its first row, whether its order value is there or not
    place = [*key, SLICE] if several else key
    local = Window.partitionBy(*place).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = (lambda name: F.col(f"__c_{name}")) if several else (lambda name: F.lit(None))
    scanned = {name: run.combine(carry(name), run.scan.over(local)) for name, run in outputs.items()}
    return sliced.select(*df.columns, *(c.alias(name) for name, c in scanned.items()))


def carries(sliced: DataFrame, keys: list[str], outputs: dict[str, Running]) -> DataFrame:
    """Per slice, the folded value of all earlier slices of its group (null for the first)."""
    folded = sliced.groupBy(*keys, SLICE).agg(*(run.fold.alias(f"__f_{n}") for n, run in outputs.items()))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return folded.select(
        *keys,
        SLICE,
        *(run.carry(F.col(f"__f_{n}")).over(earlier).alias(f"__c_{n}") for n, run in outputs.items()),
        *(F.col(f"__f_{n}") for n in outputs),
    )


def rows_between(
    df: DataFrame, keys: list[str], order: str, first: Column, last: Column, width: int = WIDTH
) -> DataFrame:
    """Rows whose 1-based position in ``order`` lies in ``first``..``last``, as ``row_no``.

    Only the slices that reach into the range are ranked.  The bounds may use
    ``total``, the row count of the group.
    """
    sliced, key, several = cut(df, keys, order, width)
    if several:
        counts = carries(sliced, key, {"n": row_number()})
        total = F.sum("__f_n").over(Window.partitionBy(*key))
        before = F.coalesce(F.col("__c_n"), F.lit(0))
        hit = (
            counts.select(*key, SLICE, before.alias("before"), F.col("__f_n").alias("n"), total.alias("total"))
            .withColumns({"first": first, "last": last})
            .where((F.col("before") < F.col("last")) & (F.col("before") + F.col("n") >= F.col("first")))
        )
        local = Window.partitionBy(*key, SLICE).orderBy(order)
        ranked = sliced.join(hit, [*key, SLICE])
    else:
        local = Window.partitionBy(*key).orderBy(order)
        total = F.count(F.lit(1)).over(Window.partitionBy(*key))
        ranked = sliced.withColumns({"total": total, "before": F.lit(0).cast("long")}).withColumns({"first": first, "last": last})
    numbered = ranked.withColumn("row_no", F.col("before") + F.row_number().over(local))
    return numbered.where(F.col("row_no").between(F.col("first"), F.col("last"))).select(*df.columns, "row_no", "total")
