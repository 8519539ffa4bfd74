"""Frame sequences: deltas, thinning, delays and the frame shown at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.payload import DEFAULT_DELAY_MS
from gridspark.operators.scan import SLICE, WIDTH, carries, cut, join_on, running_sum


def _history(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("frame")


def xor_delta(cells: DataFrame, keys: list[str], c: str = "c") -> DataFrame:
    """Frame 0 raw, every later frame as the XOR with its predecessor."""
    before = F.coalesce(F.lag(c).over(_history(keys)), F.lit(0))
    return cells.withColumn("d", F.col(c).bitwiseXOR(before))


def xor_undelta(deltas: DataFrame, keys: list[str], d: str = "d") -> DataFrame:
    """Absolute values back from XOR deltas: a running XOR per cell."""
    upto = _history(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.withColumn("c", F.bit_xor(d).over(upto))


def sparse_delta(cells: DataFrame, keys: list[str], c: str = "c") -> DataFrame:
    """Frame 0 and, after it, only the cells that changed."""
    before = F.lag(c).over(_history(keys))
    marked = cells.withColumn("__p", before)
    return marked.where(F.col("__p").isNull() | (F.col("__p") != F.col(c))).drop("__p")


def sparse_apply(patches: DataFrame, keys: list[str], frame_counts: DataFrame, anim: str, c: str = "c") -> DataFrame:
    """Dense frames from patches: each patch fills the frames up to the next one.

    ``frame_counts`` has ``(anim, n_frames)``.
    """
    upto = F.coalesce(F.lead("frame").over(_history(keys)), F.col("n_frames"))
    spans = join_on(patches, frame_counts, [anim]).withColumn("__to", upto - 1)
    return spans.select(*keys, F.explode(F.sequence("frame", "__to")).alias("frame"), c)


def pick_smaller(candidates: DataFrame, group: list[str]) -> DataFrame:
    """From ``(group, rank, name, size)`` the smallest; a later rank must be strictly smaller."""
    return (
        candidates.groupBy(*group)
        .agg(F.min(F.struct("size", "rank", "name")).alias("m"))
        .select(*group, F.col("m.name").alias("encoding"), F.col("m.size").alias("size"))
    )


def encoding_sizes(cells: DataFrame, keys: list[str], anim: str, c: str = "c") -> DataFrame:
    """Stored rows per animation: raw and delta hold every cell, sparse only frame 0 and changes."""
    before = F.lag(c).over(_history(keys))
    changed = F.when(F.col("__p").isNull() | (F.col("__p") != F.col(c)), 1).otherwise(0)
    sums = (
        cells.withColumn("__p", before)
        .groupBy(anim)
        .agg(F.count(F.lit(1)).alias("all"), F.sum(changed).alias("changed"))
    )
    options = F.array(
        *(
            F.struct(F.lit(i).alias("rank"), F.lit(n).alias("name"), F.col(s).alias("size"))
            for i, (n, s) in enumerate((("raw", "all"), ("delta", "all"), ("sparse", "changed")))
        )
    )
    return sums.select(anim, F.explode(options).alias("o")).select(anim, "o.rank", "o.name", "o.size")


def stride_thin(frames: DataFrame, anim: str, n: int) -> DataFrame:
    """Keep frames 0, n, 2n ...; a kept frame's delay is the sum of its n."""
    block = F.floor(F.col("frame") / n).cast("int")
    return frames.groupBy(anim, block.alias("new_frame")).agg(
        F.min("frame").alias("frame"), F.sum("delay_ms").alias("delay_ms")
    )


def frame_counts(frames: DataFrame, anim: str) -> DataFrame:
    return frames.groupBy(anim).agg(F.count(F.lit(1)).cast("int").alias("n_frames"))


def skip_thin(frames: DataFrame, anim: str, n: int) -> DataFrame:
    """Drop every n-th frame; its delay goes to the next kept one, at the end to the last kept.

    With n >= 2 two dropped frames never touch, so the frame that takes the
    delay over is known by arithmetic and the rest is one aggregation.
    """
    if n < 2:
        raise ValueError("n must be at least 2")
    f = F.col("frame")
    dropped = (f + 1) % n == 0
    heir = F.when(~dropped, f).when(f + 1 < F.col("n_frames"), f + 1).otherwise(f - 1)
    owned = join_on(frames, frame_counts(frames, anim), [anim]).withColumn("frame", heir)
    merged = owned.groupBy(anim, "frame").agg(F.sum("delay_ms").alias("delay_ms"))
    return merged.select(anim, skipped_index(f, n).alias("new_frame"), "frame", "delay_ms")


def skipped_index(frame, n: int):
    """Index of a kept frame after dropping every n-th."""
    return (frame - F.floor((frame + 1) / n)).cast("int")


def frame_provenance(frames: DataFrame, anim: str, n: int, rule: str) -> DataFrame:
    """``new_frame`` to ``frame`` (the original index) after thinning by ``stride`` or ``skip``."""
    f = F.col("frame")
    if rule == "stride":
        return frames.where(f % n == 0).select(anim, F.floor(f / n).cast("int").alias("new_frame"), "frame")
    return frames.where((f + 1) % n != 0).select(anim, skipped_index(f, n).alias("new_frame"), "frame")


def normalize_delays(frames: DataFrame, anim: str, wanted: int) -> DataFrame:
    """Exactly ``wanted`` delays per animation: the first ones, or the first repeated.

    A static animation has the single default delay.  One row per delay, so a
    long animation is never gathered into one value.
    """
    f = F.col("frame")
    if wanted <= 1:
        only = frames.select(anim).distinct()
        return only.select(anim, F.lit(0).alias("frame"), F.lit(DEFAULT_DELAY_MS).alias("delay_ms"))
    enough = join_on(frames, frame_counts(frames, anim), [anim]).where(f < wanted)
    kept = enough.where(F.col("n_frames") >= wanted).select(anim, "frame", "delay_ms")
    first = F.coalesce("delay_ms", F.lit(DEFAULT_DELAY_MS)).alias("delay_ms")
    filled = enough.where((F.col("n_frames") < wanted) & (f == 0)).select(
        anim, F.explode(F.sequence(F.lit(0), F.lit(wanted - 1))).alias("frame"), first
    )
    return kept.union(filled)


def frame_clock(
    frames: DataFrame, anim: str, at_ms: int, loop_count: int = 0, width: int = WIDTH
) -> DataFrame:
    """The frame each animation shows ``at_ms`` after it started.

    A frame gives way once its delay has passed and the sequence wraps; after
    ``loop_count`` rounds (0 = for ever) it rests on frame 0.  Only the slice
    of frames that holds the moment is scanned.
    """
    spent = running_sum(F.col("delay_ms"))
    rows = frames.select(anim, "frame", F.col("delay_ms").cast("long").alias("delay_ms"))
    sliced, key, _ = cut(rows, [anim], "frame", width)
    c = carries(sliced, key, {"s": spent}).withColumn("total", F.sum("__f_s").over(Window.partitionBy(*key)))
    at = F.lit(at_ms).cast("long")
    done = (F.lit(loop_count) > 0) & (at >= F.col("total") * loop_count)
    moment = F.when(done, F.lit(0)).otherwise(at % F.col("total"))
    start = F.coalesce(F.col("__c_s"), F.lit(0))
    hit = c.select(*key, SLICE, moment.alias("moment"), start.alias("start"), F.col("__f_s").alias("len"), done.alias("done"))
    hit = hit.where((F.col("start") <= F.col("moment")) & (F.col("moment") < F.col("start") + F.col("len")))
    local = Window.partitionBy(*key, SLICE).orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sliced.join(hit, [*key, SLICE]).withColumn("until", F.col("start") + F.sum("delay_ms").over(local))
    return rows.where(
        (F.col("moment") < F.col("until")) & (F.col("moment") >= F.col("until") - F.col("delay_ms"))
    ).select(anim, "frame", F.col("done").alias("finished"))


def sync_groups(members: DataFrame, key: list[str]) -> DataFrame:
    """Whether each group sharing ``key`` advances: any in-range member that is due.

    ``members`` has ``in_range``, ``finished``, ``elapsed_ms`` and ``delay_ms``.
    """
    due = F.col("in_range") & ~F.col("finished") & (F.col("elapsed_ms") >= F.col("delay_ms"))
    return members.groupBy(*key).agg(
        F.count(F.lit(1)).alias("members"),
        F.bool_or(due).alias("advances"),
        F.count_if(~F.col("finished")).alias("running"),
    )
