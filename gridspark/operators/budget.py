"""Byte budgets of tiles and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.payload import BYTES_PER_CHUNK, CAPACITY, capacity, chunk_count


def tile_stats(sizes: DataFrame, mode: str = "BANNER") -> DataFrame:
    """Chunks, share of capacity and overflow per tile of ``(comp, tile, n)``."""
    n, cap = F.col("n"), CAPACITY[mode]
    return sizes.select(
        "comp",
        "tile",
        n.alias("bytes"),
        chunk_count(n).alias("chunks"),
        (n / cap * 100).alias("pct"),
        (n > cap).alias("overflow"),
    )


def comp_totals(sizes: DataFrame, mode: str = "BANNER") -> DataFrame:
    return tile_stats(sizes, mode).groupBy("comp").agg(
        F.sum("bytes").alias("total_bytes"), F.max("chunks").alias("max_chunks")
    )


def over_budget(sizes: DataFrame, mode: Column) -> DataFrame:
    """Rows larger than the capacity of the mode each row names."""
    return sizes.withColumn("capacity", capacity(mode)).where(F.col("n") > F.col("capacity"))


def donors_needed(sizes: DataFrame, mode: str = "BANNER") -> DataFrame:
    """Blank donors whose spare room would hold all overflow of a composition."""
    cap = CAPACITY[mode]
    spare = max(1, cap - BYTES_PER_CHUNK)
    over = F.sum(F.greatest(F.col("n") - cap, F.lit(0)))
    return sizes.groupBy("comp").agg(over.alias("overflow"), F.ceil(over / spare).cast("long").alias("donors"))


def append_blank(sizes: DataFrame, mode: str = "BANNER") -> DataFrame:
    """Tiles plus one empty donor row per donor the estimate asks for."""
    ends = sizes.groupBy("comp").agg(F.max("tile").alias("last"))
    wanted = donors_needed(sizes, mode).where(F.col("donors") > 0).join(ends, "comp")
    numbered = wanted.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("donors"))))
    blank = numbered.select(
        "comp",
        (F.col("last") + F.col("i")).cast("int").alias("tile"),
        F.lit(0).cast("long").alias("n"),
        F.lit(True).alias("donor_only"),
    )
    return sizes.select("comp", "tile", "n", F.lit(False).alias("donor_only")).union(blank)


def batch_status(tiles: DataFrame) -> DataFrame:
    """Per composition and in total: user tiles, progress, over-budget tiles, donors.

    ``tiles`` has ``(comp, done, total, cap, direct, donor_only)``; ``direct``
    tiles carry their payload without chunks to place.  The total row has a
    null ``comp``.  Donor-only rows count as donors and nowhere else.
    """
    user, donor = ~F.col("donor_only"), F.col("donor_only")
    placed = user & ~F.col("direct")
    return tiles.rollup("comp").agg(
        F.count_if(user).alias("tiles"),
        F.count_if(user & F.col("direct")).alias("direct_tiles"),
        F.count_if(placed).alias("chunk_tiles"),
        F.coalesce(F.sum(F.when(placed, F.col("done"))), F.lit(0)).alias("done"),
        F.coalesce(F.sum(F.when(placed, F.col("total"))), F.lit(0)).alias("total"),
        F.count_if(user & (F.col("total") > F.col("cap"))).alias("over_budget"),
        F.count_if(donor).alias("donors"),
        F.coalesce(F.sum(F.when(donor, F.col("total"))), F.lit(0)).alias("donor_chunks"),
        F.when(F.count_if(user & F.col("direct")) == 0, "chunks")
        .when(F.count_if(placed) == 0, "direct")
        .otherwise("mixed")
        .alias("kind"),
    )


def best_grid(shapes: DataFrame, w: str, h: str, max_dim: int = 8) -> DataFrame:
    """Columns and rows (1..max_dim) closest to the aspect ratio, small grids preferred."""
    ratio = F.col(w) / F.col(h)
    options = F.array(
        *(F.struct(F.lit(c).alias("c"), F.lit(r).alias("r")) for c in range(1, max_dim + 1) for r in range(1, max_dim + 1))
    )

    def score(o):
        grid = o["c"] / o["r"]
        diff = F.abs(ratio - grid) / F.greatest(ratio, grid)
        return F.struct((diff * 100 + o["c"] * o["r"] * F.lit(0.1)).alias("s"), o["c"].alias("c"), o["r"].alias("r"))

    best = F.array_min(F.transform(options, score))
    return shapes.withColumn("__o", best).select(*shapes.columns, F.col("__o.c").alias("cols"), F.col("__o.r").alias("rows"))
