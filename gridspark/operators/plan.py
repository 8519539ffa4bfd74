"""Plans against reality: verification, demand, stock and work order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridspark.functions.payload import STACK
from gridspark.operators.scan import join_on, row_number, rows_between, scan

OK, ERRANT, OBSTRUCTION, MISSING = "OK", "ERRANT", "OBSTRUCTION", "MISSING"


def top_of(actual: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """The highest real entry per column of the build."""
    top = F.max(F.struct(y, "item", "is_ours"))
    return actual.groupBy(*keys).agg(top.alias("t")).select(
        *keys, F.col(f"t.{y}").alias("real_top"), F.col("t.item").alias("real_item"), F.col("t.is_ours").alias("is_ours")
    )


def classify(wanted: Column, wanted_top: Column, item: Column, top: Column, ours: Column, floor: Column) -> Column:
    """Finding for one column; a null ``wanted`` or ``top`` means nothing there."""
    stray = F.coalesce(ours & (top >= floor), F.lit(False))
    return (
        F.when(wanted.isNull(), F.when(stray, F.lit(ERRANT)).otherwise(F.lit(OK)))
        .when(top.isNull(), F.lit(MISSING))
        .when(top > wanted_top, F.when(ours, F.lit(ERRANT)).otherwise(F.lit(OBSTRUCTION)))
        .when((top == wanted_top) & item.eqNullSafe(wanted), F.lit(OK))
        .otherwise(F.lit(MISSING))
    )


def plan_vs_actual(planned: DataFrame, actual: DataFrame, keys: list[str], floor: int) -> DataFrame:
    """One finding per key of the plan (``top``, ``item``) or of the real world (``y``, ``item``, ``is_ours``)."""
    real = top_of(actual.where(F.col("y") >= floor), keys)
    want = planned.groupBy(*keys).agg(F.max(F.struct("top", "item")).alias("w"))
    both = want.join(real, keys, "full_outer")
    finding = classify(
        F.col("w.item"), F.col("w.top"), F.col("real_item"), F.col("real_top"), F.col("is_ours"), F.lit(floor)
    )
    return both.select(*keys, "real_top", F.col("w.top").alias("wanted_top"), finding.alias("finding"))


def _heads(cls: str, n: int):
    """From rows sorted by class: the first ``n`` of each class, and how many it had on the first of them (0 on the others)."""

    def close(rows: list[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
        for i, part in enumerate(rows):
            held = np.zeros(part.num_rows, np.int64)
            held[0] = count if i == 0 else 0
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held)], [*part.schema.names, "__n"])

    def run(batches):
        rows, count, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(cls).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                here = batch.column(cls).slice(lo, 1)
                if last is None or not here.equals(last):
                    yield from close(rows, count)
                    rows, count, last = [], 0, here
                if count < n:
                    rows.append(batch.slice(lo, min(hi - lo, n - count)))
                count += hi - lo
        yield from close(rows, count)

    return run


def samples_per_class(findings: DataFrame, cls: str, order: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` rows per class (``n`` of at least 1) as ``sample_no`` 1, 2, ..., with the ``class_count``.

    Each task sorts its rows and sends ``n`` rows per class, the first of them with the number of rows it stands for; so
    rows and counts come from one pass and one small shuffle.  Rows without a class are a class of their own.
    """
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in findings.schema.fields), StructField("__n", LongType())])
    heads = findings.sortWithinPartitions(cls, *order).mapInArrow(_heads(cls, n), schema)
    whole = Window.partitionBy(cls)
    ranked = heads.withColumns(
        {"sample_no": F.row_number().over(whole.orderBy(*order)), "class_count": F.sum("__n").over(whole)}
    )
    return ranked.where(F.col("sample_no") <= n).drop("__n")


def unbuilt(planned: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Planned cells whose real item is absent or another one."""
    real = top_of(actual, keys).select(*keys, "real_item")
    joined = planned.where(F.col("item").isNotNull()).join(real, keys, "left")
    return joined.where(~F.col("item").eqNullSafe(F.col("real_item"))).drop("real_item")


def demand(rows: DataFrame, item: str, n: Column, ours: Column | None = None) -> DataFrame:
    """Total needed per item; rows without a positive count, and foreign items, do not add."""
    kept = rows.select(F.col(item).alias("item"), n.alias("n"), (ours if ours is not None else F.lit(True)).alias("o"))
    return kept.where(F.col("o") & (F.col("n") > 0)).groupBy("item").agg(F.sum("n").alias("need"))


def stack_demand(needs: DataFrame, need: str = "need") -> DataFrame:
    """Whole stacks that carry all of the demand."""
    return needs.agg(F.coalesce(F.sum(F.ceil(F.col(need) / STACK)), F.lit(0)).cast("long").alias("stacks"))


def bounds(cells: DataFrame, group: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Bounding rectangle of the cells, null without any."""
    return cells.groupBy(*group).agg(
        F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y")
    )


def latest_stock(readings: DataFrame, loc: str = "loc", seq: str = "seq") -> DataFrame:
    """What was last seen at each place; an empty reading forgets the place.

    The rows of one ``seq`` are one reading, and all its items are kept.  Rows
    without a ``seq`` are the reading of a place that has no other.  The rank
    filter lets every task send only the newest reading it has of a place.
    """
    newest = F.rank().over(Window.partitionBy(loc).orderBy(F.col(seq).desc_nulls_last()))
    return readings.withColumn("__age", newest).where((F.col("__age") == 1) & (F.col("n") > 0)).select(loc, "item", "n")


def stock_has_all(needs: DataFrame, stock: DataFrame, group: list[str]) -> DataFrame:
    """True where every demanded item is in stock somewhere, whatever the amount."""
    known = stock.where(F.col("n") > 0).select("item").distinct().withColumn("__known", F.lit(True))
    items = needs.select(*group, "item").distinct().join(known, "item", "left")
    return items.groupBy(*group).agg(F.bool_and(F.coalesce("__known", F.lit(False))).alias("covered"))


def stock_covers_qty(needs: DataFrame, stock: DataFrame, group: list[str]) -> DataFrame:
    """True where the amount on hand reaches the demand for every item; no demand is covered."""
    have = stock.groupBy("item").agg(F.sum("n").alias("__have"))
    joined = needs.join(have, "item", "left")
    ok = F.coalesce("__have", F.lit(0)) >= F.col("need")
    return joined.groupBy(*group).agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("covered"))


BLOCK_ROWS = 4096


def with_bands(cells: DataFrame, site: list[str], band_width: int, east: bool, south_first: bool) -> DataFrame:
    """Band, direction-signed row and place within the row for the serpentine walk.

    Bands of ``band_width`` columns count from the working edge (east or west);
    the row direction alternates from band to band.
    """
    box = bounds(cells, site, "x", "z")
    if site:
        boxed = join_on(cells, box, site)
    else:  # one row for the whole table: a value, not a join
        one = cells.withColumn("__box", box.select(F.struct("*")).scalar())
        boxed = one.select(*cells.columns, "__box.*")
    step_in = (F.col("max_x") - F.col("x")) if east else (F.col("x") - F.col("min_x"))
    band = F.floor(step_in / band_width).cast("int")
    south = (band % 2 == 0) if south_first else (band % 2 != 0)
    row = F.when(south, F.col("z") - F.col("min_y")).otherwise(F.col("max_y") - F.col("z"))
    height = F.col("max_y") - F.col("min_y") + 1
    placed = boxed.withColumns(
        {
            "band": band,
            "k": (step_in % band_width).cast("int"),
            "walk": (band.cast("long") * height + row) * band_width + (step_in % band_width),
        }
    )
    return placed.drop("min_x", "max_x", "min_y", "max_y")


def serpentine_order(
    cells: DataFrame, site: list[str], band_width: int, east: bool = True, south_first: bool = True
) -> DataFrame:
    """Work order of ``(x, z)`` cells: bands from the working edge, rows, then columns.

    ``walk`` is the cell's position on the full walk of the rectangle, so the
    order is one integer and a site of any size is numbered slice by slice.
    """
    banded = with_bands(cells, site, band_width, east, south_first)
    return scan(banded, site, "walk", {"seq": row_number()}, BLOCK_ROWS * band_width)


def capped_load(
    cells: DataFrame, site: list[str], cap: int, band_width: int, east: bool = True, south_first: bool = True
) -> DataFrame:
    """The prefix of the work order that fits in ``cap`` stacks of 64.

    A cell opens a stack when its item's running count is a multiple of 64, so
    ``cap`` stacks never hold more than ``64 * cap`` cells.  Only the slices of
    the walk that reach into that many first cells are ranked, which leaves a
    handful of rows per site for the exact running counts.
    """
    banded = with_bands(cells, site, band_width, east, south_first)
    head = rows_between(banded, site, "walk", F.lit(1), F.lit(STACK * cap), BLOCK_ROWS * band_width)
    walk = Window.partitionBy(*site).orderBy("walk")
    nth = F.row_number().over(Window.partitionBy(*site, "item").orderBy("walk"))
    opens = head.withColumn("opens", F.when((nth - 1) % STACK == 0, 1).otherwise(0))
    upto = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = opens.withColumn("stacks", F.sum("opens").over(upto))
    return stacked.where(F.col("stacks") <= cap).select(*cells.columns, "band", F.col("row_no").alias("seq"), "stacks")


def band_coverage(cells: DataFrame, taken: DataFrame, site: list[str], band_width: int, east: bool = True) -> DataFrame:
    """Rectangles of the loaded cells: complete bands merged into one, a cut-off band on its own.

    ``taken`` has ``band``; ``full`` tells the two kinds apart.
    """
    totals = with_bands(cells, site, band_width, east, True).groupBy(*site, "band").agg(F.count(F.lit(1)).alias("total"))
    per_band = taken.groupBy(*site, "band").agg(
        F.count(F.lit(1)).alias("taken"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.min("z").alias("min_z"),
        F.max("z").alias("max_z"),
    )
    judged = per_band.join(totals, [*site, "band"]).withColumn("full", F.col("taken") >= F.col("total"))
    return judged.groupBy(*site, "full").agg(
        F.count(F.lit(1)).alias("bands"),
        F.sum("taken").alias("cells"),
        F.min("min_x").alias("min_x"),
        F.max("max_x").alias("max_x"),
        F.min("min_z").alias("min_z"),
        F.max("max_z").alias("max_z"),
    )


def _bisect(lo: str, hi: str, fits: str) -> str:
    """The lowest whole ``mid`` in (lo, hi] for which ``fits`` holds (it holds at ``hi`` and above any that it holds at)."""
    mid = "((b.lo + b.hi) div 2)"
    step = f"""if(b.hi - b.lo <= 1, b, if({fits.format(mid=mid)},
      named_struct('lo', b.lo, 'hi', {mid}), named_struct('lo', {mid}, 'hi', b.hi)))"""
    return f"aggregate(sequence(0, 63), named_struct('lo', {lo}, 'hi', {hi}), (b, s) -> {step}).hi"


def _fill(tops: DataFrame) -> DataFrame:
    """``slots`` of the entries of ``top``, an array in rank order that holds all items wherever no item stays without.

    The slots won are those above a level: the lowest whole level that leaves no more than ``target`` slots above it
    gives all but the last few, and of the next slot of each item the best ones give these.  Items left with nothing
    then take slots from the largest holders, found by the same search over how many slots a holder may keep.
    """
    above = "least(greatest(cast(ceil(x.ideal - {mid}) AS BIGINT), 0L), x.cap)"
    held = "aggregate(at, 0L, (a, x) -> a + " + above + ")"
    over = "aggregate(got, 0L, (a, x) -> a + greatest(x - {mid}, 0L))"
    ideal = "cast(target AS DOUBLE) * x.need / total"
    return (
        tops.withColumn("at", F.expr(f"transform(top, x -> struct({ideal} AS ideal, least(x.cap, n_slots) AS cap))"))
        .withColumn("level", F.expr(_bisect("-n_slots - 2L", "n_slots + 1L", f"{held} <= target")))
        .withColumn("base", F.expr(f"transform(at, x -> {above.format(mid='level')})"))
        .withColumn(
            "next",
            F.expr("filter(transform(at, (x, i) -> struct(base[i] - x.ideal AS miss, i AS i, base[i] < x.cap AS room)), x -> x.room)"),
        )
        .withColumn("last", F.expr("slice(sort_array(next), 1, cast(target - aggregate(base, 0L, (a, x) -> a + x) AS INT)).i"))
        .withColumn("got", F.expr("transform(base, (x, i) -> x + if(array_contains(last, i), 1L, 0L))"))
        .withColumn("empty", F.expr("cast(size(filter(got, x -> x = 0)) AS BIGINT)"))
        .withColumn("most", F.expr(_bisect("0L", "n_slots + 1L", f"{over} <= empty")))
        .withColumn("more", F.expr("cast(empty - " + over.format(mid="most") + " AS INT)"))
        .withColumn("one_less", F.expr("slice(filter(transform(got, (x, i) -> if(x >= most AND most > 1, i, -1)), x -> x >= 0), 1, more)"))
        .withColumn("filled", F.expr("transform(got, (x, i) -> if(x = 0, 1L, least(x, most) - if(array_contains(one_less, i), 1L, 0L)))"))
        .withColumn("slots", F.expr("if(target < items, transform(top, (x, i) -> if(i < target, 1L, 0L)), filled)"))
    )


def proportional_slots(needs: DataFrame, group: list[str], n_slots: int | list[int]) -> DataFrame:
    """Share ``n_slots`` over items by demand: ``(group, item, need, slots)``; a list of counts adds ``n_slots`` as a column.

    ``needs`` has one row per item of a group.  An item never gets more slots
    than it has stacks; each slot goes to the item furthest below its ideal,
    ties to the larger demand, then the first name; items left with nothing
    take the highest slots of the largest holders.  Without a demand there are
    no slots.

    Only the ``n_slots`` largest items of a group can get any, and a group where
    every item gets one has no more than that.  So each task sends at most
    ``n_slots`` rows of a group, and the shares are found on one bounded array.
    """
    counts = [n_slots] if isinstance(n_slots, int) else sorted(set(n_slots))
    part = group or ["__g"]
    base = needs if group else needs.withColumn("__g", F.lit(0))
    stacks = F.ceil(F.col("need") / STACK).cast("long")
    rank = F.struct((-F.col("need")).alias("down"), F.col("item").alias("item"))
    pos = base.where(F.col("need") > 0)
    info = pos.groupBy(*part).agg(F.count(F.lit(1)).alias("items"), F.sum("need").alias("total"), F.sum(stacks).alias("sum_cap"))
    nth = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("need"), "item"))
    first = pos.withColumn("__n", nth).where(F.col("__n") <= counts[-1]).groupBy(*part)
    tops = join_on(first.agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "need", stacks.alias("cap")))).alias("top")), info, part)
    asked = tops.withColumn("n_slots", F.explode(F.array(*(F.lit(n).cast("long") for n in counts))))
    shares = _fill(asked.withColumn("target", F.least("n_slots", "sum_cap")))
    given = shares.select(*part, "n_slots", F.inline(F.arrays_zip("top", "slots"))).select(
        *part, F.col("top.rank.item").alias("item"), F.col("top.need").alias("need"), "slots", "n_slots"
    )
    # whoever ranks behind the array gets nothing; most groups have no such items
    end = tops.where(F.col("items") > counts[-1]).select(*part, F.element_at("top", -1)["rank"].alias("__end"))
    behind = join_on(base, end, part, "left").where(~F.coalesce(F.col("need") > 0, F.lit(False)) | (rank > F.col("__end")))
    zero = behind.withColumn("n_slots", F.explode(F.array(*(F.lit(n).cast("long") for n in counts))))
    out = given.union(zero.select(*part, "item", "need", F.lit(0).cast("long").alias("slots"), "n_slots"))
    out = out.withColumn("n_slots", F.col("n_slots").cast("int")) if not isinstance(n_slots, int) else out.drop("n_slots")
    return out if group else out.drop("__g")
