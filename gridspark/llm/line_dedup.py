"""Lines that several documents share stay in the first document only.

Every line becomes two 64-bit hashes with its document and position; the text stays where it is.  The hashes are
range-partitioned and sorted by document and position inside a partition, and one pass over each run of equal hashes
finds the document that holds it first.  What other documents hold goes into a keep bitmap per document: 64 lines a
word, words that keep everything left out.  Only the bitmaps travel back to the texts.

A frequent line must not become one run.  Hashes fall into 2^16 bands whose sizes are counted first; the lines of a band
above SLICE_ROWS are dealt over several slices, their first holders come from a partial aggregation, and the join with
them is by hash and slice.

Cases: a null text is one empty line, as an empty one is.  Rows with equal doc_id are one document, each row with lines
of its own (told apart by a hash of the text; equal rows drop the same lines).  A null doc_id is a document after all
others.  An empty table gives no rows.  Only the id and the text column are read, so other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import cut_lineage

BLANKS = " \t\n\x0b\f\r"
MIN_CHARS = 10
BANDS = 1 << 16
SLICE_ROWS = 1 << 17
WORD = 64
ALL_KEPT = -1


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    folded = F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(folded)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` without nulls in the text, and ``row``, which tells rows with equal ids apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("text"))


def _lines(texts: DataFrame, min_chars: int) -> DataFrame:
    """``h1, h2, doc_id, row, pos`` of every line whose key is long enough."""
    at = texts.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = at.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "row", "pos")


def _sliced(lines: DataFrame, slice_rows: int) -> DataFrame:
    """Append ``slices``, the number of slices of the line's band, and ``slice``: -1 in bands of ordinary size."""
    band = F.shiftrightunsigned("h1", 48).cast("int")
    banded = lines.withColumn("band", band)
    sizes = banded.groupBy("band").count()
    large = sizes.where(F.col("count") > slice_rows).select("band", F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
    joined = banded.join(F.broadcast(large), "band", "left")  # at most 2^16 rows
    own = F.pmod(F.xxhash64("doc_id", "row"), F.col("slices")).cast("int")
    return joined.withColumn("slice", F.coalesce(own, F.lit(-1))).drop("band")


def _later(first: Column) -> Column:
    """True where a line is not in the document that holds it first; a null document comes last."""
    return first.isNotNull() & ~first.eqNullSafe(F.col("doc_id"))


def _repeats(lines: DataFrame) -> DataFrame:
    """``doc_id, row, pos`` of the lines that an earlier document holds too."""
    ordinary = lines.where("slice < 0").repartitionByRange("h1", "h2")
    stream = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("doc_id"), "pos")
    streamed = ordinary.withColumn("first", F.first("doc_id").over(stream))

    frequent = lines.where("slice >= 0")
    holders = frequent.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("slices").alias("slices"))
    holders = holders.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    joined = frequent.drop("slices").join(holders, ["h1", "h2", "slice"])
    place = ["doc_id", "row", "pos"]
    return streamed.where(_later(F.col("first"))).select(place).union(joined.where(_later(F.col("first"))).select(place))


def _filled(words: Column) -> Column:
    """The words of a bitmap one behind the other, from its sparse form ``array<struct<word, bits>>`` in order."""

    def with_gap(entry: Column, i: Column) -> Column:
        after = F.when(i == 0, F.lit(0)).otherwise(F.get(words, i - 1)["word"] + 1)
        return F.concat(F.array_repeat(F.lit(ALL_KEPT).cast("long"), entry["word"] - after), F.array(entry["bits"]))

    return F.flatten(F.transform(words, with_gap))


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``doc_id, row, words`` of each document that loses a line, written to the shared folder.

    ``words`` is the sparse bitmap: bit ``pos % 64`` of word ``pos / 64`` is set where the line stays, and words that
    keep all their lines are left out.  ``row`` is the xxhash64 of the text.
    """
    lines = cut_lineage(_lines(_texts(docs, id_col, text_col), min_chars), "line-hashes")
    gone = _repeats(_sliced(lines, slice_rows))
    bit = F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")
    words = gone.groupBy("doc_id", "row", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    maps = words.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return cut_lineage(maps, "keep-bitmaps")


def _counted(words: Column) -> Column:
    """Lines that a sparse bitmap drops."""
    lost = F.aggregate(words, F.lit(0).cast("long"), lambda n, e: n + WORD - F.bit_count(e["bits"]))
    return F.coalesce(lost, F.lit(0))


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: every row of ``docs`` with the lines its bitmap keeps.

    The join carries each text once; the planner sends the bitmaps round instead while they are small.
    """
    texts = _texts(docs, id_col, text_col)
    marks = bitmaps.select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), "words", _filled(F.col("words")).alias("bits"))
    on = reduce(Column.__and__, [F.col("doc_id").eqNullSafe(F.col("__doc")), F.col("row") == F.col("__row")])
    joined = texts.join(marks, on, "left")
    lines = F.split("text", "\n", -1)

    def stays(line: Column, pos: Column) -> Column:
        word = F.coalesce(F.get("bits", F.floor(pos / WORD).cast("int")), F.lit(ALL_KEPT))
        return F.getbit(word, (pos % WORD).cast("int")) == 1

    kept = F.when(F.col("bits").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), _counted(F.col("words")).alias("n_dropped"), kept.alias("text"))
