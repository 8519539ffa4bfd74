"""Image files as pixel rows, and pixel rows as uncompressed image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(image, x, y, r, g, b, alpha, bad)`` of every image under ``path``.

    Decoding is Spark's image source, which gives channels as B, G, R (, A)
    bytes.  A file that cannot be decoded is one row with ``bad`` set and no
    pixel; the image source skips files without a byte.  Images spread over
    tasks by file, and by scan line once exploded.
    """
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    n, w = F.col("nChannels"), F.col("width")
    bad = F.coalesce((F.col("height") <= 0) | (w <= 0) | (n <= 0), F.lit(True))
    # scan lines are sliced before they are exploded, so no row carries the whole image
    scan = F.transform(
        F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.substring("data", y * w * n + 1, w * n)
    )
    lines = raw.select(F.col("origin").alias("image"), "width", "nChannels", bad.alias("bad"), F.posexplode_outer(F.when(~bad, scan)).alias("y", "line"))
    pixel = F.transform(F.sequence(F.lit(0), w - 1), lambda x: F.hex(F.substring("line", x * n + 1, n)))
    cells = lines.select("image", "y", "nChannels", "bad", F.posexplode_outer(F.when(~F.col("bad"), pixel)).alias("x", "hex"))

    def byte(k):
        return F.conv(F.substring("hex", 2 * k + 1, 2), 16, 10).cast("int")

    grey = n == 1
    return cells.select(
        "image",
        "x",
        "y",
        F.when(grey, byte(0)).otherwise(byte(2)).alias("r"),
        F.when(grey, byte(0)).otherwise(byte(1)).alias("g"),
        byte(0).alias("b"),
        F.when(n == 4, byte(3)).when(~F.col("bad"), F.lit(255)).alias("alpha"),
        "bad",
    )


def visible(pixels: DataFrame) -> DataFrame:
    return pixels.where(F.col("alpha") >= 128)


HEADER = 54
#: Instead of a file's size, which readers only take as a limit: a number above any, of bytes below 128.
SIZE_LIMIT = 0x7F7F7F7F


def _hex_le(value, size: int):
    """``size`` bytes of a number, lowest first, in hex."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(value, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)))


def write_bitmaps(pixels: DataFrame, image: list[str], path: str) -> None:
    """One uncompressed 24-bit bitmap per image of ``(image, x, y, r, g, b)``, by the text writer.

    The writer takes text, so channels and the sides' bytes must stay below
    128; other values are an error.  An image is one value, as its file is.
    """
    channel = F.struct("y", "x", F.concat(*(F.lpad(F.hex(F.col(c)), 2, "0") for c in "bgr")).alias("hex"))
    small = F.greatest("r", "g", "b") < 128
    checked = F.when(small & (F.least("r", "g", "b") >= 0), channel).otherwise(F.raise_error("a channel lies in 0..127"))
    grid = pixels.groupBy(*image).agg(
        F.sort_array(F.collect_list(checked)).alias("cells"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")
    )
    line = F.transform(F.sequence(F.col("h") - 1, F.lit(0)), lambda y: F.concat(
        F.array_join(F.transform(F.slice("cells", y * F.col("w") + 1, F.col("w")), lambda p: p["hex"]), ""),
        F.repeat(F.lit("00"), ((4 - F.col("w") * 3 % 4) % 4).cast("int")),
    ))
    zero, one = F.lit(0), F.lit(1)
    fields = [(F.lit(SIZE_LIMIT), 4), (zero, 4), (F.lit(HEADER), 4), (F.lit(40), 4), (F.col("w"), 4), (F.col("h"), 4), (one, 2), (F.lit(24), 2)]
    head = F.concat(F.lit("424D"), *(_hex_le(v, n) for v, n in fields), F.repeat(F.lit("00"), 24))
    whole = F.unhex(F.concat(head, F.array_join(line, "")))
    square = F.when(F.size("cells") == F.col("w") * F.col("h"), whole).otherwise(F.raise_error("a pixel of a bitmap is missing"))
    grid.select(F.decode(square, "UTF-8").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
