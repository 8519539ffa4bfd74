"""WARC archives: written as text files, read back by boundary-chain verification.

A reader that looks for the magic ``WARC/1.`` also finds it inside payloads.
So every task only emits candidates: where a magic stands, and where the record
would end if one began there (header, Content-Length, two line ends).  From the
start of each file, pointer jumping follows those successors; only candidates
that are reached are records.  Candidates that follow each other without a gap
form a run and jump together, so the jumps, which double each round, are taken
over runs: one per intact file, some more around a magic inside a payload.

Files are read in splits, cut at the magic by the text source, so an archive of
any size is spread over tasks.  Offsets come from prefix sums over splits and
within a split.  A record whose payload holds no magic is digested where it is
read and its bytes never move; the others are put together from their parts.

Cases: a null html is an empty payload; equal payloads of ``min_bytes`` or more
make one response (largest page id) and revisits; rows that repeat that page
and payload are responses too.  A null page id is written as an empty id and
comes back as null; it is a response only if no row with an id has its payload.
A null url is empty; in one, line ends are written as %0D and %0A and the magic as
``%57ARC/1.``, so that headers hold no candidate.  An empty table gives no records.
Reading back fewer records than were written is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.session import cut_lineage, fresh_path

MAGIC = "WARC/1."
END = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MAX_RECORDS_PER_FILE = 50_000


def base32_of_hex(hexed: Column) -> Column:
    """Base32 of 40 hex digits: five digits are 20 bits, which are four letters."""
    letters = []
    for part in range(8):
        bits = F.conv(F.substring(hexed, 5 * part + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def _in_header(value: Column) -> Column:
    """A value that neither ends its line nor looks like the start of a record."""
    for mark, written in (("\r", "%0D"), ("\n", "%0A"), (MAGIC, f"%{ord(MAGIC[0]):02X}{MAGIC[1:]}")):
        value = F.replace(value, F.lit(mark), F.lit(written))
    return value


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``; ``refers_to`` is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        _in_header(F.coalesce("url", F.lit(""))).alias("url"),
        payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("sha1"),
        F.octet_length(payload).alias("bytes"),
    )
    # only the ids and digests are shuffled; the revisits are written, so that their size decides how they are joined
    keys = rows.where(F.col("bytes") >= min_bytes).select("page_id", "sha1")
    groups = keys.groupBy("sha1").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("top").isNotNull())
    revisits = keys.join(groups, "sha1").where(~F.col("page_id").eqNullSafe(F.col("top"))).select("page_id", "sha1", "top").distinct()
    revisits = cut_lineage(revisits.withColumnsRenamed({"page_id": "r_page", "sha1": "r_sha1"}), "warc-revisits")
    on = F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("sha1") == F.col("r_sha1"))
    found = rows.join(revisits, on, "left")
    return found.select("page_id", "url", "payload", base32_of_hex(F.col("sha1")).alias("digest"), F.col("top").alias("refers_to"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> int:
    """Writes one record per page and tells how many; the last line end of a record is the separator of the text files."""

    def urn(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))

    rows = with_record_types(pages, min_bytes)
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.col("payload"))
    lines = [
        F.lit(f"{MAGIC}1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(END, *lines), F.lit(END * 2), block, F.lit(END))
    written = Observation()
    values = rows.select(record.alias("value")).observe(written, F.count(F.lit(1)).alias("n"))
    values.write.option("lineSep", END).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).text(path)
    return written.get["n"]


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics: ``file, at`` (byte of the magic before it), its length and its text."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
    )
    return raw.withColumn("bytes", F.octet_length("value").cast("long"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per magic: ``file, at, bytes``, the header and, where the part holds all of it, the payload's digest."""
    head = F.substring_index("value", END * 2, 1)
    length = F.regexp_extract(head, r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", 1)
    length = F.when(length != "", length.cast("long"))
    start = F.octet_length(head).cast("long") + 4
    payload = F.expr("substring(cast(value as binary), cast(body + 1 as int), cast(length as int))")
    rows = _parts(spark, path).withColumn("head", head).withColumn("length", length).withColumn("body", start)
    whole = F.col("body") + F.col("length") <= F.col("bytes")
    rows = rows.withColumn("sha1", F.when(whole, F.sha1(payload)))
    # the texts end here: what is written and moved are headers and numbers
    rows = cut_lineage(rows.drop("value"), "warc-candidates")
    span = F.col("bytes") + len(MAGIC)
    blocks = rows.groupBy("file", "block").agg(F.sum(span).alias("span"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("span").over(before), F.lit(0)).alias("from"))
    within = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum(span).over(within), F.lit(0))).join(blocks, ["file", "block"])
    # the first part of a file has no magic before it
    at = F.col("from") + F.col("within") - len(MAGIC)
    return rows.withColumn("at", at).where("at >= 0").drop("from", "within", "block", "n")


def reachable(links: DataFrame) -> DataFrame:
    """The candidates ``file, at`` that a chain of successors ``next`` reaches from byte 0 of their file."""
    along = Window.partitionBy("file").orderBy("at")
    follows = F.coalesce(F.lag("next").over(along) == F.col("at"), F.lit(False))
    run = F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    runs = cut_lineage(links.withColumn("follows", follows).withColumn("run", run).drop("follows"), "warc-runs")
    ends = runs.groupBy("file", "run").agg(F.max_by("next", "at").alias("to"))
    entries = runs.select("file", F.col("at").alias("to"), F.col("run").alias("to_run"))
    jump = cut_lineage(ends.join(entries, ["file", "to"]).select("file", "run", "to_run", "to"), "warc-jump")
    reached = runs.where(F.col("at") == 0).select("file", "run", F.col("at").alias("entry"))
    while not jump.isEmpty():
        landed = reached.join(jump, ["file", "run"]).select("file", F.col("to_run").alias("run"), F.col("to").alias("entry"))
        reached = cut_lineage(reached.union(landed), "warc-reached")
        onward = jump.select("file", F.col("run").alias("to_run"), F.col("to_run").alias("far_run"), F.col("to").alias("far"))
        jump = jump.drop("to").join(onward, ["file", "to_run"])
        jump = cut_lineage(jump.select("file", "run", F.col("far_run").alias("to_run"), F.col("far").alias("to")), "warc-jump")
    return runs.join(reached, ["file", "run"]).where(F.col("at") >= F.col("entry")).select("file", "at")


def read_warc(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Every record of the archives: ``file, at, record_type, page_id, refers_to, url, digest`` (as written),
    ``payload_bytes`` and ``sha1`` of the block that was read.

    With ``expected`` a chain that breaks off, so that records are missing, is an error.
    """
    rows = cut_lineage(candidates(spark, path), "warc-links")
    total = len(MAGIC) + F.col("body") + F.col("length") + 4
    links = rows.select("file", "at", (F.col("at") + total).alias("next"))
    reached = reachable(links)
    if expected is not None:
        whole_chain = reached.join(links.where(F.col("next").isNotNull()), ["file", "at"], "left_semi")
        if (n := whole_chain.count()) != expected:
            raise RuntimeError(f"{expected} records were written, {n} were read back")
    found = rows.join(reached, ["file", "at"])

    whole = found.where(F.col("sha1").isNotNull()).select("file", "at", "head", "length", "sha1")
    split = found.where(F.col("sha1").isNull() & F.col("length").isNotNull()).select("file", "at", "head", "length", "body")
    split = cut_lineage(split, "warc-split")
    if not split.isEmpty():
        whole = whole.unionByName(_joined(spark, path, split))
    head = F.concat(F.lit(END), F.col("head"), F.lit(END))

    def field(name: str) -> Column:
        value = F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)\r\n", 1)
        return F.when(value != "", value)

    def page(name: str) -> Column:
        value = F.regexp_extract(field(name), r"<urn:page:(-?[0-9]+)>", 1)
        return F.when(value != "", value.cast("long"))

    return whole.select(
        "file",
        "at",
        field("WARC-Type").alias("record_type"),
        page("WARC-Record-ID").alias("page_id"),
        page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        F.col("length").alias("payload_bytes"),
        "sha1",
    )


def _joined(spark: SparkSession, path: str, split: DataFrame) -> DataFrame:
    """Records whose payload holds the magic, put together from the parts between their start and their end.

    Only files with such records are read again; a record is gathered in one task, as one value must be.
    """
    parts = _parts(spark, path).join(split.select("file").distinct(), "file", "left_semi")
    before = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(before), F.lit(0)) - len(MAGIC)
    parts = parts.select("file", at.alias("at"), F.col("value").cast("binary").alias("value"))
    stop = F.col("at") + len(MAGIC) + F.col("body") + F.col("length")
    starts = split.select("file", "at", F.struct(F.col("at").alias("start"), stop.alias("stop")).alias("record"))
    along = Window.partitionBy("file").orderBy("at", F.col("value").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    marked = parts.unionByName(starts, True).withColumn("record", F.last("record", True).over(along))
    inside = marked.where(F.col("value").isNotNull() & (F.col("at") < F.col("record.stop")))
    gathered = inside.groupBy("file", F.col("record.start").alias("start")).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    block = F.aggregate(
        F.slice("parts", 2, F.size("parts")),
        F.element_at("parts", 1)["value"],
        lambda got, part: F.concat(got, F.lit(MAGIC).cast("binary"), part["value"]),
    )
    found = gathered.select("file", F.col("start").alias("at"), block.alias("block")).join(split, ["file", "at"])
    payload = F.expr("substring(block, cast(body + 1 as int), cast(length as int))")
    return found.select("file", "at", "head", "length", F.sha1(payload).alias("sha1"))


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages to an archive in the shared folder, reads it back and resolves the revisits."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    records = read_warc(spark, path, write_warc(pages, path, min_bytes)).withColumn("payload_digest", base32_of_hex(F.col("sha1")))
    responses = records.where(F.col("record_type") == "response")
    # a revisit has the payload of the response that it names
    named = responses.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.where(F.col("record_type") == "revisit").select("page_id", "record_type", "refers_to", "digest").join(named, ["refers_to", "digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(revisits.withColumnRenamed("digest", "payload_digest").select(*columns))

