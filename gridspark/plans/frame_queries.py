"""Frame sequences, delays and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions.payload import clamp_delay, flag_columns
from gridspark.operators import frames as A
from gridspark.plans.registry import query
from gridspark.sources import views as V

CELL = ["anim", "pos"]


@query(
    "xor_delta",
    """SELECT anim, frame, pos, xor(c, coalesce(lag(c) OVER (PARTITION BY anim, pos ORDER BY frame), 0)) AS d FROM fr""",
)
def _(spark, d):
    return A.xor_delta(V.fr(spark, d), CELL).select("anim", "frame", "pos", "d")


@query("xor_undelta", "SELECT anim, frame, pos, c FROM fr")
def _(spark, d):
    deltas = A.xor_delta(V.fr(spark, d), CELL).select("anim", "frame", "pos", "d")
    return A.xor_undelta(deltas, CELL).select("anim", "frame", "pos", "c")


_SPARSE = """SELECT anim, frame, pos, c FROM (SELECT *, lag(c) OVER (PARTITION BY anim, pos ORDER BY frame) AS p FROM fr)
  WHERE p IS NULL OR p <> c"""


@query("sparse_delta", _SPARSE)
def _(spark, d):
    return A.sparse_delta(V.fr(spark, d), CELL).select("anim", "frame", "pos", "c")


@query("sparse_apply", "SELECT anim, frame, pos, c FROM fr")
def _(spark, d):
    cells = V.fr(spark, d)
    patches = A.sparse_delta(cells, CELL)
    counts = cells.groupBy("anim").agg((F.max("frame") + 1).alias("n_frames"))
    return A.sparse_apply(patches, CELL, counts, "anim").select("anim", "frame", "pos", "c")


@query(
    "pick_smaller_encoding",
    f"""SELECT anim, m.name AS encoding, m.size AS size FROM (SELECT anim, min(struct_pack(size := size, rank := rank, name := name)) AS m FROM (
      SELECT anim, 0 AS rank, 'raw' AS name, count(*) AS size FROM fr GROUP BY anim UNION ALL
      SELECT anim, 1, 'delta', count(*) FROM fr GROUP BY anim UNION ALL
      SELECT anim, 2, 'sparse', count(*) FROM ({_SPARSE}) GROUP BY anim) GROUP BY anim)""",
)
def _(spark, d):
    return A.pick_smaller(A.encoding_sizes(V.fr(spark, d), CELL, "anim"), ["anim"])


@query(
    "stride_thin",
    """SELECT anim, CAST(floor(frame/3) AS INT) AS new_frame, min(frame) AS frame, CAST(sum(delay_ms) AS BIGINT) AS delay_ms
       FROM fdelay GROUP BY 1, 2""",
)
def _(spark, d):
    return A.stride_thin(V.fdelay(spark, d), "anim", 3)


_SKIP = """WITH RECURSIVE marked AS (SELECT *, (frame + 1) % 3 = 0 AS gone, max(frame) OVER (PARTITION BY anim) AS last FROM fdelay),
  heir AS (SELECT anim, frame, delay_ms, coalesce(
      min(CASE WHEN NOT gone THEN frame END) OVER (PARTITION BY anim ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      max(CASE WHEN NOT gone THEN frame END) OVER (PARTITION BY anim)) AS keeper FROM marked),
  thin AS (SELECT anim, keeper AS frame, CAST(sum(delay_ms) AS BIGINT) AS delay_ms FROM heir GROUP BY 1, 2)
  SELECT anim, CAST(row_number() OVER (PARTITION BY anim ORDER BY frame) - 1 AS INT) AS new_frame, frame, delay_ms FROM thin"""


@query("skip_thin", _SKIP)
def _(spark, d):
    return A.skip_thin(V.fdelay(spark, d), "anim", 3)


@query(
    "frame_provenance",
    """SELECT 'stride' AS rule, anim, CAST(row_number() OVER (PARTITION BY anim ORDER BY frame) - 1 AS INT) AS new_frame, frame
         FROM fdelay WHERE frame % 3 = 0
       UNION ALL SELECT 'skip', anim, CAST(row_number() OVER (PARTITION BY anim ORDER BY frame) - 1 AS INT), frame
         FROM fdelay WHERE (frame + 1) % 3 <> 0""",
)
def _(spark, d):
    frames = V.fdelay(spark, d)
    out = None
    for rule in ("stride", "skip"):
        rows = A.frame_provenance(frames, "anim", 3, rule).select(F.lit(rule).alias("rule"), "anim", "new_frame", "frame")
        out = rows if out is None else out.union(rows)
    return out


_NORM = """SELECT CAST({n} AS INT) AS wanted, a.anim, CAST(i AS INT) AS frame, CASE WHEN a.k >= {n} THEN f.delay_ms ELSE z.delay_ms END AS delay_ms
  FROM (SELECT anim, count(*) AS k FROM fdelay GROUP BY anim) a, range({n}) r(i)
  LEFT JOIN fdelay f ON f.anim = a.anim AND f.frame = i JOIN fdelay z ON z.anim = a.anim AND z.frame = 0"""


@query(
    "normalize_delays",
    f"""SELECT CAST(1 AS INT) AS wanted, anim, CAST(0 AS INT) AS frame, CAST(100 AS INT) AS delay_ms FROM (SELECT DISTINCT anim FROM fdelay)
    UNION ALL {_NORM.format(n=20)} UNION ALL {_NORM.format(n=70)}""",
)
def _(spark, d):
    frames = V.fdelay(spark, d)
    out = None
    for wanted in (1, 20, 70):
        rows = A.normalize_delays(frames, "anim", wanted).select(F.lit(wanted).alias("wanted"), "anim", "frame", "delay_ms")
        out = rows if out is None else out.union(rows)
    return out


@query(
    "clamp_delay",
    """SELECT event_id, greatest(10, least(10000, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value*50) AS INT) - 30 END, 100))) AS delay_ms
       FROM events""",
)
def _(spark, d):
    raw = F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") * 50).cast("int") - 30)
    return V.table(spark, d, "events").select("event_id", clamp_delay(raw).alias("delay_ms"))


_CLOCK = """SELECT CAST({loops} AS INT) AS loops, anim, frame, fin AS finished FROM (SELECT *, {loops} > 0 AND {t} >= total*{loops} AS fin,
  CASE WHEN {loops} > 0 AND {t} >= total*{loops} THEN 0 ELSE {t} % total END AS moment FROM (
  SELECT anim, frame, sum(delay_ms) OVER (PARTITION BY anim ORDER BY frame) AS until, delay_ms, sum(delay_ms) OVER (PARTITION BY anim) AS total FROM fdelay))
  WHERE moment < until AND moment >= until - delay_ms"""


@query("frame_clock", f"{_CLOCK.format(loops=0, t=12345)} UNION ALL {_CLOCK.format(loops=3, t=12345)}")
def _(spark, d):
    frames = V.fdelay(spark, d)
    out = None
    for loops in (0, 3):
        rows = A.frame_clock(frames, "anim", 12345, loops).select(F.lit(loops).alias("loops"), "anim", "frame", "finished")
        out = rows if out is None else out.union(rows)
    return out


@query(
    "sync_groups",
    """SELECT event_type, grid, count(*) AS members,
       bool_or(near AND NOT fin AND elapsed >= delay) AS advances, count(*) FILTER (NOT fin) AS running
       FROM (SELECT event_type, user_id % 40 AS grid, value < 3 AS near, event_id % 5 = 0 AS fin, event_id % 150 AS elapsed,
         greatest(10, CAST(floor(value*60) AS INT)) AS delay FROM events) GROUP BY 1, 2""",
)
def _(spark, d):
    e = V.table(spark, d, "events").select(
        "event_type",
        (F.col("user_id") % 40).alias("grid"),
        (F.col("value") < 3).alias("in_range"),
        (F.col("event_id") % 5 == 0).alias("finished"),
        (F.col("event_id") % 150).alias("elapsed_ms"),
        F.greatest(F.lit(10), F.floor(F.col("value") * 60).cast("int")).alias("delay_ms"),
    )
    return A.sync_groups(e, ["event_type", "grid"])


_FLAGS = ("all_shades", "animated", "mux", "delta_frames", "sparse_frames", "av1", "av1_lossy", "av1_composite")


@query(
    "flag_bits",
    "SELECT event_id, "
    + ", ".join(f"(event_id % 256) & {1 << i} <> 0 AS {n}" for i, n in enumerate(_FLAGS))
    + ", user_id % 4 & 1 <> 0 AS srgb FROM events",
)
def _(spark, d):
    cols = flag_columns(F.col("event_id") % 256, F.col("user_id") % 4)
    return V.table(spark, d, "events").select("event_id", *(c.alias(n) for n, c in cols.items()))
