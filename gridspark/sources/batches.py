"""Batch snapshots as JSON: explicit schema, defaults for fields old files lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = T.StructType(
    [
        T.StructField("chunks", T.ArrayType(T.StringType())),
        T.StructField("currentIndex", T.IntegerType()),
        T.StructField("nonce", T.IntegerType()),
        T.StructField("frameCount", T.IntegerType()),
        T.StructField("frameDelays", T.ArrayType(T.IntegerType())),
        T.StructField("frameSourceIndices", T.ArrayType(T.IntegerType())),
        T.StructField("carpetEncoded", T.BooleanType()),
        T.StructField("loomEncoded", T.BooleanType()),
        T.StructField("carpetCompressedB64", T.StringType()),
        T.StructField("muxed", T.BooleanType()),
        T.StructField("muxReceiver", T.BooleanType()),
        T.StructField("isDonorOnly", T.BooleanType()),
        T.StructField("muxCargoB64", T.StringType()),
    ]
)
BATCH = T.StructType(
    [
        T.StructField("sourceFilename", T.StringType()),
        T.StructField("columns", T.IntegerType()),
        T.StructField("rows", T.IntegerType()),
        T.StructField("activeTileIndex", T.IntegerType()),
        T.StructField("allShades", T.BooleanType()),
        T.StructField("dither", T.BooleanType()),
        T.StructField("title", T.StringType()),
        T.StructField("codecMode", T.StringType()),
        T.StructField("authorOverride", T.StringType()),
        T.StructField("whitelist", T.ArrayType(T.StringType())),
        T.StructField("tiles", T.ArrayType(TILE)),
    ]
)
# What a missing field means.
BATCH_DEFAULTS = {
    "columns": 1, "rows": 1, "activeTileIndex": 0, "allShades": False, "dither": False, "codecMode": "CARPET_SHADE",
}
TILE_DEFAULTS = {
    "currentIndex": 0, "nonce": 0, "frameCount": 1, "carpetEncoded": False, "loomEncoded": False,
    "muxed": False, "muxReceiver": False, "isDonorOnly": False,
}


def with_defaults(schema: T.StructType, defaults: dict, field) -> list[Column]:
    """Each schema field, with its default where it has one; ``field(name)`` gives the raw column."""
    out = []
    for f in schema.fields:
        raw = field(f.name)
        if isinstance(f.dataType, T.ArrayType) and f.name in ("chunks", "whitelist"):
            raw = F.coalesce(raw, F.array().cast(f.dataType))
        elif f.name in defaults:
            raw = F.coalesce(raw, F.lit(defaults[f.name]))
        out.append(raw.alias(f.name))
    return out


def _is_document(text: Column) -> Column:
    """The text is exactly one JSON object: in an array with a 0 behind it, it is one of two elements."""
    elements = F.json_array_length(F.concat(F.lit("["), text, F.lit("\n,0]")))
    return F.coalesce((elements == 2) & text.rlike(r"^\s*\{"), F.lit(False))


def read_batches(spark: SparkSession, path: str, lines: bool = False, bad: str | None = None) -> DataFrame:
    """One row per batch, missing fields filled in.

    A file is one document over any number of lines, or one document per line
    as :func:`write_batches` writes them.  ``lines`` promises the latter for
    all files, which can then be split; otherwise a file is read as a whole.
    A line that is no document is an error, or a row with that line in the
    column ``bad`` (null for all others).
    Fields that are partition folders are taken from the folder's name.
    """
    files = spark.read.text(path, wholetext=not lines)
    folders = [f.name for f in BATCH.fields if f.name in files.columns]
    text = F.regexp_replace("value", "^\ufeff", "")
    if lines:
        documents = files.select(*folders, text.alias("__json")).where(F.col("__json").rlike(r"\S"))
    else:
        rows = F.filter(F.split(text, "\r?\n"), lambda line: line.rlike(r"\S"))
        documents = files.select(*folders, F.explode(F.when(_is_document(text), F.array(text)).otherwise(rows)).alias("__json"))
    checked = documents.withColumn("__ok", _is_document(F.col("__json")))
    if bad is None:
        error = F.concat(F.lit("not one batch document: "), F.substring("__json", 1, 100))
        checked = checked.where(F.when(F.col("__ok"), True).otherwise(F.raise_error(error).cast("boolean")))
    parsed = checked.select(
        *folders,
        F.when(F.col("__ok"), F.from_json("__json", BATCH)).alias("__b"),
        F.when(~F.col("__ok"), F.col("__json")).alias("__bad"),
    )

    def field(name: str) -> Column:
        inner = F.col(f"__b.{name}")
        return F.coalesce(inner, F.col(name).cast(BATCH[name].dataType)) if name in folders else inner

    kept = [] if bad is None else [F.col("__bad").alias(bad)]
    return parsed.select(*with_defaults(BATCH, BATCH_DEFAULTS, field), *kept)


def parse_batches(rows: DataFrame, json: str, *keep: str) -> DataFrame:
    """The same from a JSON column."""
    parsed = rows.select(*keep, F.from_json(json, BATCH).alias("__b"))
    return parsed.select(*keep, *with_defaults(BATCH, BATCH_DEFAULTS, lambda n: F.col(f"__b.{n}")))


def batch_tiles(batches: DataFrame, *keep: str) -> DataFrame:
    """One row per tile with its index, missing fields filled in."""
    tiles = batches.select(*keep, F.posexplode("tiles").alias("tile", "t"))
    return tiles.select(*keep, "tile", *with_defaults(TILE, TILE_DEFAULTS, lambda n: F.col(f"t.{n}")))


def batch_json(batches: DataFrame, *keep: str) -> DataFrame:
    """``(keep, json)``: each batch row as one JSON document."""
    fields = [c for c in batches.columns if c not in keep]
    return batches.select(*keep, F.to_json(F.struct(*fields)).alias("json"))


def write_batches(batches: DataFrame, path: str, partition_by: list[str] = (), mode: str = "errorifexists") -> None:
    """Persist batches as JSON lines, one folder per partition value."""
    batches.write.partitionBy(*partition_by).mode(mode).json(path)
