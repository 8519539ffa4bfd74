"""Quality rules by cross-document line frequency.

Every line is normalised (A-Z to lower case, digit runs to 0, white space to
single spaces) and hashed together with its host.  A line counts once per
document; lines found in more than ``max_docs`` documents of a host are
removed, and a document is rejected when it fails the base rules or when less
than ``min_share`` of its words is left.

The lines are counted by a hash of 16 bytes per distinct line, never by text.
Counts are pre-aggregated, so a line of a third of all documents is one row per
task in the shuffle; only lines above the limit go back to the documents, through
a join that Spark can split at a hot line.  Which lines a document loses depends on
its host and text alone, so the lines found wait under a digest of both and no text
is stored: the documents are read a second time, those whose digest cannot be among
the found ones (a bitmap of fixed size tells) stay where they are, and only the
others meet their lines in a shuffle.  Digests of more than 1/256 of all documents
(fewer than 256, by that) are salted there.

Cases: a null or empty text has no words and fails the base rule.  A null host
is a host of its own.  Every row is a document, repeated ids and rows too.
Only id, host and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.text import SPACE, may_hold, repeated_words, utf8_views, word_hashes, word_spans
from gridspark.session import cut_lineage

MAX_DOCS = 100
MIN_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_DIGITS = re.compile(rb"[0-9]+")

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LINES = "key binary, lines array<binary>"
_CUT = "doc_id long, host string, text string, " + ", ".join(f"{n} long" for n in _COUNTS) + ", removed_words long"
HOT, SALTS = 256, 64


def normalise(line: bytes) -> bytes:
    return b" ".join(_DIGITS.sub(b"0", line.translate(_LOWER)).split())


def base_counts(buf: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    starts, ends = word_spans(buf)
    chars = int(np.count_nonzero((buf & 0xC0) != 0x80) - np.count_nonzero(SPACE[buf]))
    seen, again = set(), 0
    for line in buf.tobytes().split(b"\n"):
        if line in seen:
            again += 1
        elif line.split(None, 1):
            seen.add(line)
    words = word_hashes(buf, starts, ends)
    return len(starts), chars, int(np.count_nonzero(_IS_SYMBOL[buf])), again, repeated_words(words)


def hashed_lines(buf: np.ndarray, host: str | None):
    """Every line of a text, its words and the hash of host and normalised line (none for a line without words)."""
    start = xxhash.xxh3_128(b"\x00" if host is None else b"\x01" + host.encode() + b"\n")
    for line in buf.tobytes().split(b"\n"):
        clean = normalise(line)
        if clean:
            h = start.copy()
            h.update(clean)
            yield line, clean.count(b" ") + 1, h.digest()
        else:
            yield line, 0, None


def cut_lines(buf: np.ndarray, host: str | None, frequent: set[bytes]) -> tuple[str, int]:
    """The text without its frequent lines, and the words they had."""
    left, removed = [], 0
    for line, words, key in hashed_lines(buf, host):
        if key in frequent:
            removed += words
        else:
            left.append(line)
    return b"\n".join(left).decode(), removed


def _lines(batches):
    for batch in batches:
        views = utf8_views(batch.column("text"))
        lines = [list({key for _, _, key in hashed_lines(buf, host)} - {None}) for host, buf in zip(batch.column("host").to_pylist(), views)]
        yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.binary()), pa.array(lines, pa.list_(pa.binary()))], ["key", "lines"])


def _cut(batches):
    for batch in batches:
        texts, hosts = batch.column("text").to_pylist(), batch.column("host").to_pylist()
        hits, removed, counts = batch.column("frequent").to_pylist(), [0] * batch.num_rows, []
        for i, buf in enumerate(utf8_views(batch.column("text"))):
            counts.append(base_counts(buf))
            if hits[i]:
                texts[i], removed[i] = cut_lines(buf, hosts[i], set(hits[i]))
        columns = zip(*counts) if counts else [()] * len(_COUNTS)
        made = [pa.array(list(c), pa.int64()) for c in (*columns, removed)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(hosts, pa.string()), pa.array(texts, pa.string()), *made],
            ["doc_id", "host", "text", *_COUNTS, "removed_words"],
        )


def _with_hits(texts: DataFrame, hits: DataFrame, n_docs: int) -> DataFrame:
    """Every document with its frequent lines (null for none); only documents that may have some are shuffled."""
    marked = may_hold(texts, hits.select("key"), "key", "__may")
    # fewer than HOT digests can each belong to more than 1/HOT of the documents
    hot = hits.where(F.col("copies") * HOT > n_docs).select(F.col("key").alias("__hot"))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    spread = hits.join(F.broadcast(hot), F.col("key") == F.col("__hot"), "left").select(
        "key", "frequent", F.explode(F.when(F.col("__hot").isNotNull(), salts).otherwise(F.array(F.lit(0)))).alias("__salt")
    )
    some = marked.where("__may").join(F.broadcast(hot), F.col("key") == F.col("__hot"), "left")
    salt = F.when(F.col("__hot").isNotNull(), F.spark_partition_id() % SALTS).otherwise(0)
    met = some.withColumn("__salt", salt).join(spread, ["key", "__salt"], "left").select("doc_id", "host", "text", "frequent")
    rest = marked.where(~F.col("__may")).select("doc_id", "host", "text", F.lit(None).cast("array<binary>").alias("frequent"))
    return met.union(rest)


def cut_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Every document as ``doc_id, host, text`` without its frequent lines, and its counts and verdict: n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words (all of the whole text), base_failed, removed_words, kept.

    Null texts stay null; rejected documents are rows too, ``kept`` tells them.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    named = F.coalesce(F.concat(F.length("host").cast("string"), F.lit(":"), "host"), F.lit("-"))
    texts = texts.withColumn("key", F.unhex(F.md5(F.encode(F.concat(named, "text"), "UTF-8"))))
    lines = cut_lineage(texts.where(F.col("text").isNotNull()).select("key", "host", "text").mapInArrow(_lines, _LINES), "line-hashes")
    each = lines.select("key", F.explode("lines").alias("h"))
    frequent = each.groupBy("h").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select("h")
    found = each.join(frequent, "h").groupBy("key").agg(F.collect_set("h").alias("frequent"), F.count("*").alias("n"))
    # written, so that the planner sees whether the hits are small and all texts can stay where they are
    hits = cut_lineage(found.select("key", "frequent", (F.col("n") / F.size("frequent")).cast("long").alias("copies")), "line-hits")
    found = _with_hits(texts, hits, lines.count()).mapInArrow(_cut, _CUT)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return found.withColumn("base_failed", failed).select(
        "doc_id",
        "host",
        "text",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "removed_words",
        (~F.col("base_failed") & (left >= F.col("n_words") * F.lit(min_share))).alias("kept"),
    )


def line_frequency(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Counts and verdict per document, from the documents that :func:`cut_frequent_lines` gives."""
    return cut_frequent_lines(docs, id_col, text_col, host_col, max_docs, min_share).drop("host", "text")
