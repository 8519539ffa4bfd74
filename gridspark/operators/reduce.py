"""Palette reduction on colour counts.

A merge only moves one count to another colour, so the loop needs the image's
histogram (at most 255 rows) and never its pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gridspark.functions.palette import with_oklab
from gridspark.operators.match import closest_pair, nearest_match, ordered_dither
from gridspark.operators.scan import join_on

RAREST, CLOSEST, WEIGHTED = "RAREST", "CLOSEST", "WEIGHTED"
STRATEGIES = (RAREST, CLOSEST, WEIGHTED)


def _merge_down(ids: np.ndarray, n: np.ndarray, lab: np.ndarray, target: int, strategy: str):
    """Merge until ``target`` colours are left; returns final id per row, merges, touched count."""
    n = n.astype(np.int64).copy()
    to = np.arange(len(ids))
    dist = ((lab[:, None, :] - lab[None, :, :]) ** 2).sum(axis=2)
    merges = touched = 0
    while (n > 0).sum() > max(target, 0):
        alive = np.flatnonzero(n > 0)
        if len(alive) < 2:
            break
        if strategy == RAREST:
            victim = alive[np.argmin(n[alive])]
            rest = alive[alive != victim]
            survivor = rest[np.argmin(dist[victim, rest])]
        else:
            score = dist[np.ix_(alive, alive)].copy()
            if strategy == WEIGHTED:
                score /= n[alive][:, None] + n[alive][None, :]
            score[np.tril_indices(len(alive))] = np.inf
            a, b = (alive[k] for k in np.unravel_index(np.argmin(score), score.shape))
            victim, survivor = (a, b) if n[a] <= n[b] else (b, a)
        merges, touched = merges + 1, touched + int(n[victim])
        n[survivor] += n[victim]
        n[victim] = 0
        to[to == victim] = survivor
    return ids[to], merges, touched


def reduction_map(
    pixels: DataFrame, palette: DataFrame, group: list[str], target: int, strategy: str = RAREST, c: str = "c"
) -> DataFrame:
    """``(group, c, to, removed, touched)`` per colour in use."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    counts = pixels.where(F.col(c) > 0).groupBy(*group, c).agg(F.count(F.lit(1)).alias("n"))
    known = with_oklab(palette.withColumnRenamed("id", c))
    rows = counts.join(known, c).select(*group, F.col(c).cast("int").alias(c), "n", "L", "a", "lab_b")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(c)
        lab = pdf[["L", "a", "lab_b"]].to_numpy()
        to, merges, touched = _merge_down(pdf[c].to_numpy(), pdf["n"].to_numpy(), lab, target, strategy)
        return pdf[[*group, c]].assign(to=to, removed=merges, touched=touched)

    keys = [f for f in rows.schema.fields if f.name in group]
    schema = StructType(
        [
            *keys,
            StructField(c, IntegerType()),
            StructField("to", IntegerType()),
            StructField("removed", IntegerType()),
            StructField("touched", LongType()),
        ]
    )
    return rows.groupBy(*group).applyInPandas(merge, schema)


def reduce_palette(
    pixels: DataFrame, palette: DataFrame, group: list[str], target: int, strategy: str = RAREST, c: str = "c"
) -> DataFrame:
    """Pixels with at most ``target`` colours per group; all merges applied as one mapping."""
    mapping = reduction_map(pixels, palette, group, target, strategy, c).select(*group, c, "to")
    out = join_on(pixels, mapping, [*group, c], "left").withColumn("__c", F.coalesce("to", c))
    return out.select(*(F.col("__c").alias(c) if n == c else F.col(n) for n in pixels.columns))


def reduce_once(
    pixels: DataFrame,
    palette: DataFrame,
    group: list[str],
    strategy: str = RAREST,
    c: str = "c",
    mask: DataFrame | None = None,
    cell: list[str] | None = None,
) -> DataFrame:
    """One merge per group: ``victim``, ``survivor``, colours before and after, cells touched.

    With a mask only selected cells count.  Groups with a single colour merge nothing.
    """
    seen = pixels if mask is None else join_on(pixels, mask, cell, "left_semi")
    counts = seen.where(F.col(c) > 0).groupBy(*group, F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("before"))
    if strategy == RAREST:
        step = rarest_pair(counts, palette, group)
    else:
        step = closest_pair(counts, palette, group, strategy == WEIGHTED)
    return join_on(before, step, group, "left").select(
        *group,
        "victim",
        "survivor",
        "before",
        (F.col("before") - F.when(F.col("victim").isNull(), 0).otherwise(1)).alias("after"),
        F.coalesce("touched", F.lit(0)).alias("touched"),
    )


def rarest_pair(counts: DataFrame, palette: DataFrame, group: list[str]) -> DataFrame:
    """Per group the rarest entry (lowest id on a tie) and its nearest present neighbour."""
    entry = F.struct(F.col("n"), F.col("id"), F.col("L"), F.col("a"), F.col("lab_b").alias("b"))
    rows = with_oklab(counts.join(palette, "id"))
    arrays = rows.groupBy(*group).agg(F.collect_list(entry).alias("es"), F.min(entry).alias("v"))

    def gap(e):
        dl, da, db = F.col("v.L") - e["L"], F.col("v.a") - e["a"], F.col("v.b") - e["b"]
        return F.struct((dl * dl + da * da + db * db).alias("d"), e["id"].alias("id"))

    others = F.filter("es", lambda e: e["id"] != F.col("v.id"))
    m = F.array_min(F.transform(others, gap))
    return arrays.withColumn("m", m).where(F.col("m").isNotNull()).select(
        *group, F.col("v.id").alias("victim"), F.col("m.id").alias("survivor"), F.col("v.n").alias("touched")
    )


def apply_step(pixels: DataFrame, step: DataFrame, group: list[str], c: str = "c") -> DataFrame:
    """Recolour each group's victim as its survivor."""
    out = join_on(pixels, step.select(*group, "victim", "survivor"), group, "left")
    new = F.when(F.col(c) == F.col("victim"), F.col("survivor")).otherwise(F.col(c))
    return out.select(*(new.alias(c) if n == c else F.col(n) for n in pixels.columns))


def two_pass_match(
    df: DataFrame,
    palette: DataFrame,
    metric: str = "OKLAB",
    dither_size: int | None = None,
    dither_scale: float = 0.1,
    colours: int | None = None,
    strategy: str = RAREST,
    group: list[str] | None = None,
) -> DataFrame:
    """Match to the whole palette, keep the entries used, optionally reduce and dither, and match to those.

    With ``colours`` at most that many of the used entries are left for the
    second match, merged by ``strategy`` over the counts of the first one.
    The reduction is over the whole table; call it per image for palettes per
    image, or name ``group`` columns to keep what is left in any group.
    """
    first = nearest_match(df, palette, metric).withColumn("c", F.col("match_id"))
    if colours is None:
        left = first.select(F.col("c").alias("id"))
    else:
        keys = group or ["__all"]
        counted = first if group else first.withColumn("__all", F.lit(0))
        left = reduction_map(counted, palette, keys, colours, strategy).select(F.col("to").alias("id"))
    used = palette.join(left.where("id > 0").distinct(), "id", "left_semi")
    if dither_size is None:
        return nearest_match(df, used, metric)
    return ordered_dither(df, used, dither_size, dither_scale, metric)
