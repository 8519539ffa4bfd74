"""Colour counts and values derived from them.

Counting is a partial aggregation, so everything after it works on at most
256 rows per image, however large the image is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.scan import join_on, running_sum, scan
from gridspark.session import cut_lineage


def color_histogram(pixels: DataFrame, group: list[str], c: str = "c") -> DataFrame:
    """Count and percentage per colour.

    The percentage base holds transparent pixels too; the rows shown do not.
    """
    counts = pixels.groupBy(*group, c).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*group)) if group else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("pct", F.col("n") / total * 100).where(F.col(c) != 0)


def distinct_colors(pixels: DataFrame, group: list[str], c: str = "c") -> DataFrame:
    """Number of different colours, transparent excluded (0 if nothing else is there)."""
    seen = pixels.select(*group, F.nullif(F.col(c), F.lit(0)).alias("__c")).distinct()
    return seen.groupBy(*group).agg(F.count("__c").alias("n_colors"))


def palette_of(pixels: DataFrame, group: list[str], c: str = "c") -> DataFrame:
    """The colours in use over all rows of each group, 0 excluded."""
    return pixels.where(F.col(c) != 0).select(*group, c).distinct()


def heat_scale(pixels: DataFrame, group: list[str], c: str = "c") -> DataFrame:
    """Each colour's count placed between the group's rarest (0) and commonest (1)."""
    counts = pixels.where(F.col(c) != 0).groupBy(*group, c).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    lo, hi = F.min("n").over(w), F.max("n").over(w)
    ranged = counts.withColumns({"lo": lo, "hi": hi})
    t = F.when(F.col("hi") == F.col("lo"), F.lit(0.5)).otherwise(
        (F.col("n") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    )
    return ranged.select(*group, c, "n", t.alias("heat"))


def rarest(pixels: DataFrame, group: list[str], c: str = "c") -> DataFrame:
    """The least frequent colour above 0; the lowest id wins a tie."""
    counts = pixels.where(F.col(c) > 0).groupBy(*group, c).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.groupBy(*group)
        .agg(F.min(F.struct("n", c)).alias("m"))
        .select(*group, F.col(f"m.{c}").alias(c), F.col("m.n").alias("n"))
    )


#: Steps a factor of two is cut into, and an exponent below the smallest double's: where a value lies, to 2e-14 of itself.
LOG_STEPS, LOG_LEAST = 1 << 45, 1100


def _place(v: Column) -> Column:
    """An integer that grows with ``v`` over the whole range of doubles; neighbours may share one."""
    size = F.floor((F.log2(F.abs(v)) + LOG_LEAST) * LOG_STEPS).cast("long")
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * size).cast("long")


def value_histogram(values: DataFrame, group: list[str], v: str) -> DataFrame:
    """``(group, v, n)``: how often each value occurs; nulls and NaN are no values.

    Counted per task before the shuffle and written, as the sums over it read it several times.
    """
    known = values.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
    counted = known.groupBy(*group, F.col(v).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(counted, "histogram")


def otsu_threshold(values: DataFrame, group: list[str], v: str) -> DataFrame:
    """The value that splits each group's distribution at maximum between-class variance.

    Values are counted as they are.  Inside a run of equal values the variance
    is convex, so only the borders between distinct values can be the maximum;
    the first maximum wins, and a constant group returns its value.  The sums
    below each value run over slices of the group, so a group whose values all
    differ is spread as any other.
    """
    if not group:
        return otsu_threshold(values.withColumn("__all", F.lit(0)), ["__all"], v).drop("__all")
    hist = value_histogram(values, group, v).withColumn("__o", _place(F.col("v")))
    part = F.col("n") * F.col("v")
    sums = scan(hist, group, "__o", {"upto": running_sum(F.col("n")), "low": running_sum(part)}, ties=("v",))
    whole = hist.groupBy(*group).agg(F.sum("n").alias("cnt"), F.sum(part).alias("tot"))
    h = join_on(sums, whole, group).withColumns(
        {"k": F.col("upto") - F.col("n"), "below": F.col("low") - part}
    )
    w0 = F.col("k") / F.col("cnt")
    gap = F.col("below") / F.nullif(F.col("k"), F.lit(0)) - (F.col("tot") - F.col("below")) / (F.col("cnt") - F.col("k"))
    between = F.when(F.col("k") == 0, F.lit(-1.0)).otherwise(w0 * (1 - w0) * gap * gap)
    best = h.groupBy(*group).agg(F.max(F.struct(between.alias("bv"), (-F.col("v")).alias("nv"))).alias("m"))
    return best.select(*group, (F.lit(0.0) - F.col("m.nv")).alias("threshold"))
