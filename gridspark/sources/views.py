"""The example tables as grids, palettes, frames, sizes, chunks, plans and stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.scan import row_number, scan
from gridspark.sources.grids import grid_from_arrays


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cells_of_embeddings(spark, folder) -> DataFrame:
    return grid_from_arrays(table(spark, folder, "embeddings"), ["vec_id"], "embedding")


def px(spark, folder) -> DataFrame:
    """Pixels: image, y, x, raw value and an 8-bit colour (0 = transparent)."""
    v = F.col("v")
    c = F.greatest(F.lit(1), F.least(F.lit(255), F.floor(v * 64).cast("int") + 128))
    return cells_of_embeddings(spark, folder).select(
        ((F.col("vec_id") - F.col("vec_id") % 50) / 50).cast("int").alias("image"),
        (F.col("vec_id") % 50).cast("int").alias("y"),
        "x",
        "v",
        F.when((F.col("vec_id") + F.col("x")) % 17 == 0, F.lit(0)).otherwise(c).alias("c"),
    )


def fr(spark, folder) -> DataFrame:
    """Frame cells: the pixel table read as animations of one-row frames."""
    return px(spark, folder).select(F.col("image").alias("anim"), F.col("y").alias("frame"), F.col("x").alias("pos"), "c")


def rgb(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("event_id") % 256).cast("int").alias("r"),
        ((F.col("event_id") * 7) % 256).cast("int").alias("g"),
        ((F.col("user_id") * 13) % 256).cast("int").alias("b"),
        F.when(F.col("event_id") % 11 == 0, F.lit(0)).otherwise(F.lit(255)).alias("alpha"),
    )


def opaque_rgb(spark, folder) -> DataFrame:
    return rgb(spark, folder).where(F.col("alpha") >= 128)


def pal(spark, folder) -> DataFrame:
    size = F.col("p_size")
    return (
        table(spark, folder, "part")
        .select("p_size")
        .distinct()
        .select(
            size.alias("id"),
            ((size * 5) % 256).alias("r"),
            ((size * 11) % 256).alias("g"),
            ((size * 23) % 256).alias("b"),
            (size % 4 != 3).alias("legal"),
        )
    )


def cell(spark, folder) -> DataFrame:
    e, eid = table(spark, folder, "events"), F.col("event_id")
    return e.select(
        (eid % 100).cast("int").alias("x"),
        ((eid - eid % 100) / 100).cast("int").alias("z"),
        F.col("event_type").alias("item"),
    )


def fdelay(spark, folder) -> DataFrame:
    """Frame delays: each user's events in id order, numbered from 0."""
    e = table(spark, folder, "events").select("user_id", "event_id", "value")
    numbered = scan(e, ["user_id"], "event_id", {"n": row_number()})
    return numbered.select(
        F.col("user_id").alias("anim"),
        (F.col("n") - 1).cast("int").alias("frame"),
        F.greatest(F.lit(10), F.floor("value").cast("int")).alias("delay_ms"),
    )


def sizes(spark, folder, *extra: str) -> DataFrame:
    """Payload sizes: each source's documents in id order, numbered from 0."""
    d = table(spark, folder, "documents").select("source", "doc_id", "n_chars", *extra)
    numbered = scan(d, ["source"], "doc_id", {"n": row_number()})
    return numbered.select(
        F.col("source").alias("comp"),
        (F.col("n") - 1).cast("int").alias("tile"),
        F.col("n_chars").alias("n"),
        *extra,
    )


def parts(spark, folder) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("grp"),
        F.col("turn").alias("idx"),
        (1 + F.col("conv_id") % 8).alias("expected"),
        F.col("text").alias("body"),
    )


def planned(spark, folder) -> DataFrame:
    k = F.col("o_orderkey")
    item = (
        F.when(k % 7 == 0, F.lit(None).cast("string"))
        .when(k % 3 == 0, F.lit("A"))
        .when(k % 3 == 1, F.lit("N"))
        .otherwise(F.lit("R"))
    )
    return table(spark, folder, "orders").select(k.alias("k"), (1 + k % 4).cast("int").alias("top"), item.alias("item"))


def actual(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("y"),
        F.col("l_returnflag").alias("item"),
        (F.col("l_linestatus") == "O").alias("is_ours"),
    )


def stock(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("loc"),
        F.col("event_type").alias("item"),
        F.floor("value").cast("int").alias("n"),
        F.col("event_id").alias("seq"),
    )


def sess(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("owner"), F.col("event_id").alias("saved_seq")
    )
