"""Tables replayed as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.plans.registry import query
from gridspark.streaming import assemble as A
from gridspark.streaming.replay import drain, stream_table


@query(
    "stream_group_assemble",
    """SELECT grp, md5(string_agg(body, '' ORDER BY idx)) AS digest, count(*) AS pieces FROM parts
       WHERE idx < expected GROUP BY grp, expected HAVING count(*) = expected""",
)
def _(spark, d):
    c = stream_table(spark, d, "conversations")
    expected = 1 + F.col("conv_id") % 8
    parts = c.where(F.col("turn") < expected).select(
        F.col("conv_id").alias("grp"), F.col("turn").alias("at"), F.col("text").alias("body"), expected.alias("total")
    )
    done = drain(A.stream_group_assemble(parts, ["grp"]), "groups")
    return done.select("grp", F.md5(F.encode("payload", "UTF-8")).alias("digest"), "pieces")


@query(
    "stream_segment_assemble",
    "SELECT doc_id, md5(text) AS digest, CAST(CASE WHEN length(text) > 2000 THEN 2 ELSE 1 END AS BIGINT) AS pieces FROM documents WHERE doc_id % 4 <> 0 OR length(text) <= 2000",
)
def _(spark, d):
    docs = stream_table(spark, d, "documents")
    n = F.length("text")
    # the donor slice comes first and knows no total; every fourth long text never gets its own segment
    donor = F.struct(
        F.lit(2000).cast("long").alias("at"),
        F.expr("substring(text, 2001)").alias("body"),
        F.lit(None).cast("long").alias("total"),
    )
    own = F.struct(F.lit(0).cast("long").alias("at"), F.substring("text", 1, 2000).alias("body"), n.cast("long").alias("total"))
    pieces = F.when(n <= 2000, F.array(own)).when(F.col("doc_id") % 4 == 0, F.array(donor)).otherwise(F.array(donor, own))
    segments = docs.select("doc_id", F.inline(pieces))
    done = drain(A.stream_segment_assemble(segments, ["doc_id"]), "segments")
    return done.select("doc_id", F.md5(F.encode("payload", "UTF-8")).alias("digest"), "pieces")


@query("stream_first_seen", "SELECT DISTINCT user_id FROM events")
def _(spark, d):
    e = stream_table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return drain(A.stream_first_seen(e, ["user_id"], "ts", "3650 days").select("user_id"), "first-seen")
