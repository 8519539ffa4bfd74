"""Chunks, budgets, batches, names and stock maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import payload as P
from gridspark.operators import budget as B
from gridspark.operators import chunks as K
from gridspark.operators import history as H
from gridspark.operators import secrets as X
from gridspark.operators import stock as ST
from gridspark.plans.registry import query
from gridspark.session import fresh_path
from gridspark.sources import batches as J
from gridspark.sources import views as V


def r6(c):
    return F.round(c, 6)


# ── scalar payload rules ────────────────────────────────────────────────────


@query(
    "chunk_count",
    """SELECT doc_id, CAST(ceil((n_chars + 2)/84::DOUBLE) AS INT) AS chunks,
       CAST(ceil(ceil(n_chars/3::DOUBLE)*4/48) AS INT) AS b64_chunks FROM documents""",
)
def _(spark, d):
    n = F.col("n_chars")
    return V.table(spark, d, "documents").select(
        "doc_id", P.chunk_count(n).alias("chunks"), P.base64_chunk_count(n).alias("b64_chunks")
    )


# Fixed values, written out for the checks: capacity per mode, channels in filling order, bytes per channel.
_CAPACITY = {"BANNER": 5290, "CARPET": 8176, "CARPET_SHADE": 10192, "CARPET_BANNERS": 13466, "CARPET_SHADE_BANNERS": 15482, "CARPET_BANNERS_SHADE": 15482}
_ORDER = {
    "BANNER": "", "CARPET": "carpet", "CARPET_SHADE": "carpet shade", "CARPET_BANNERS": "carpet overflow",
    "CARPET_SHADE_BANNERS": "carpet shade overflow", "CARPET_BANNERS_SHADE": "carpet overflow shade",
}
_BYTES = {"carpet": 8176, "shade": 2016, "overflow": 5290}


def _split_sql(mode: str) -> str:
    used, col = 0, {"carpet": "CAST(0 AS BIGINT)", "shade": "CAST(0 AS BIGINT)", "overflow": "CAST(0 AS BIGINT)"}
    for name in _ORDER[mode].split():
        col[name] = f"CAST(greatest(least(n_chars - {used}, {_BYTES[name]}), 0) AS BIGINT)"
        used += _BYTES[name]
    ov = col["overflow"]
    chunks = "CAST(ceil((n_chars + 2)/84::DOUBLE) AS INT)" if mode == "BANNER" else "CAST(0 AS INT)"
    return f"""SELECT doc_id, '{mode}' AS mode, {col['carpet']} AS carpet_bytes, {col['shade']} AS shade_bytes, {ov} AS overflow_bytes,
      CASE WHEN {ov} > 0 THEN CAST(ceil(({ov} + 2)/84::DOUBLE) AS INT) ELSE 0 END AS overflow_chunks, {chunks} AS chunks,
      n_chars <= {_CAPACITY[mode]} AS fits FROM documents"""


@query("channel_split", " UNION ALL ".join(_split_sql(m) for m in _CAPACITY))
def _(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    modes = F.array(
        *(
            F.struct(
                F.lit(m).alias("mode"), *(c.alias(n) for n, c in P.channel_split(F.col("n_chars"), m).items())
            )
            for m in P.MODES
        )
    )
    return docs.select("doc_id", F.inline(modes))


@query("truncate_utf8", "SELECT doc_id, lower(substr(hex(encode(text)), 1, 128)) AS head FROM documents")
def _(spark, d):
    cut = P.truncate_utf8(F.col("text"), P.TITLE_BYTES)
    return V.table(spark, d, "documents").select("doc_id", F.lower(F.hex(cut)).alias("head"))


@query(
    "crc32_check",
    """WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
        lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS t),
    octets AS MATERIALIZED (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'),
        lambda h: CAST(strpos('0123456789ABCDEF', h[1])*16 + strpos('0123456789ABCDEF', h[2]) - 17 AS BIGINT)) AS bs FROM documents)
    SELECT doc_id, xor(list_reduce(bs, lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) AS crc,
        doc_id % 9 <> 0 AS matches FROM octets, tab""",
)
def _(spark, d):
    docs = V.table(spark, d, "documents")
    data = F.encode("text", "UTF-8")
    # every ninth row carries a stored value that does not belong to it
    stored = F.crc32(data) + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)
    return docs.select("doc_id", F.crc32(data).alias("crc"), P.crc32_matches(data, stored).alias("matches"))


@query(
    "clean_name",
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '^.+\.[^.]*$') THEN regexp_replace(url, '^(.+)\.[^.]*$', '\1') ELSE url END AS stem,
       regexp_replace(regexp_replace(lower(regexp_replace(url, '\.[^.]+$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
       FROM pages""",
)
def _(spark, d):
    url = F.col("url")
    return V.table(spark, d, "pages").select("page_id", P.filename_stem(url).alias("stem"), P.slug(url).alias("slug"))


_SAVED = "regexp_extract(url, '/([a-z]+)/[0-9]+', 1) || '_' || lpad(CAST(page_id*7 % 1000 AS VARCHAR), 3, '0') || CASE WHEN page_id % 5 = 0 THEN '.txt' ELSE '.json' END"


@query(
    "next_counter",
    f"""SELECT stem, max(CAST(digits AS INT)) + 1 AS next FROM (SELECT regexp_extract(name, '^(.+)_[0-9]+\\.json$', 1) AS stem,
       regexp_extract(name, '^.+_([0-9]+)\\.json$', 1) AS digits FROM (SELECT {_SAVED} AS name FROM pages)) WHERE digits <> '' GROUP BY stem""",
)
def _(spark, d):
    number = F.lpad((F.col("page_id") * 7 % 1000).cast("string"), 3, "0")
    ending = F.when(F.col("page_id") % 5 == 0, ".txt").otherwise(".json")
    name = F.concat(F.regexp_extract("url", "/([a-z]+)/[0-9]+", 1), F.lit("_"), number, ending)
    return H.next_counter(V.table(spark, d, "pages").select(name.alias("name")), "name")


# ── budgets ─────────────────────────────────────────────────────────────────


@query(
    "tile_stats",
    """SELECT comp, tile, n AS bytes, CAST(ceil((n + 2)/84::DOUBLE) AS INT) AS chunks, round(n/5290::DOUBLE*100, 6) AS pct, n > 5290 AS overflow FROM sizes""",
)
def _(spark, d):
    stats = B.tile_stats(V.sizes(spark, d))
    return stats.withColumn("pct", r6("pct"))


@query(
    "comp_totals",
    "SELECT comp, CAST(sum(n) AS BIGINT) AS total_bytes, CAST(max(ceil((n + 2)/84::DOUBLE)) AS INT) AS max_chunks FROM sizes GROUP BY comp",
)
def _(spark, d):
    return B.comp_totals(V.sizes(spark, d))


_MODE_OF = "list_value({})[CAST(1 + tile % 6 AS INT)]".format(", ".join(f"'{m}'" for m in _CAPACITY))
_CAP_OF = "list_value({})[CAST(1 + tile % 6 AS INT)]".format(", ".join(map(str, _CAPACITY.values())))


@query("over_budget", f"SELECT comp, tile, n, {_MODE_OF} AS mode, {_CAP_OF} AS capacity FROM sizes WHERE n > {_CAP_OF}")
def _(spark, d):
    mode = F.element_at(F.array(*(F.lit(m) for m in P.MODES)), F.col("tile") % 6 + 1)
    return B.over_budget(V.sizes(spark, d).withColumn("mode", mode), F.col("mode"))


_DONORS = "SELECT comp, CAST(sum(greatest(n - 5290, 0)) AS BIGINT) AS overflow, CAST(ceil(sum(greatest(n - 5290, 0))/5206::DOUBLE) AS BIGINT) AS donors FROM sizes GROUP BY comp"


@query("donors_needed", _DONORS)
def _(spark, d):
    return B.donors_needed(V.sizes(spark, d))


@query(
    "append_blank",
    f"""SELECT comp, tile, n, FALSE AS donor_only FROM sizes UNION ALL
    SELECT comp, CAST(last + i AS INT) AS tile, CAST(0 AS BIGINT), TRUE FROM
      (SELECT w.comp, donors, last, unnest(range(1, donors + 1)) AS i FROM ({_DONORS}) w JOIN (SELECT comp, max(tile) AS last FROM sizes GROUP BY comp) t ON w.comp = t.comp WHERE donors > 0)""",
)
def _(spark, d):
    return B.append_blank(V.sizes(spark, d))


_STATUS_COLS = """count(*) FILTER (NOT dn) AS tiles, count(*) FILTER (NOT dn AND dir) AS direct_tiles, count(*) FILTER (NOT dn AND NOT dir) AS chunk_tiles,
  CAST(coalesce(sum(done) FILTER (NOT dn AND NOT dir), 0) AS BIGINT) AS done, CAST(coalesce(sum(total) FILTER (NOT dn AND NOT dir), 0) AS BIGINT) AS total,
  count(*) FILTER (NOT dn AND total > 63) AS over_budget, count(*) FILTER (dn) AS donors,
  CAST(coalesce(sum(total) FILTER (dn), 0) AS BIGINT) AS donor_chunks,
  CASE WHEN count(*) FILTER (NOT dn AND dir) = 0 THEN 'chunks' WHEN count(*) FILTER (NOT dn AND NOT dir) = 0 THEN 'direct' ELSE 'mixed' END AS kind"""


@query(
    "batch_status",
    f"""WITH t AS (SELECT comp, CAST(ceil((n + 2)/84::DOUBLE) AS INT) AS total, least(CAST(ceil((n + 2)/84::DOUBLE) AS INT), tile % 70) AS done,
      tile % 9 = 8 AS dn, tile % 3 = 1 AS dir FROM sizes)
    SELECT comp, {_STATUS_COLS} FROM t GROUP BY comp UNION ALL SELECT NULL, {_STATUS_COLS} FROM t""",
)
def _(spark, d):
    total = P.chunk_count(F.col("n"))
    tiles = V.sizes(spark, d).select(
        "comp",
        total.alias("total"),
        F.least(total, F.col("tile") % 70).alias("done"),
        F.lit(P.MAX_CHUNKS).alias("cap"),
        (F.col("tile") % 3 == 1).alias("direct"),
        (F.col("tile") % 9 == 8).alias("donor_only"),
    )
    return B.batch_status(tiles)


@query(
    "best_grid",
    """SELECT p_partkey, m.c AS cols, m.r AS rows FROM (SELECT p_partkey, min(struct_pack(s := abs(ratio - c/r)/greatest(ratio, c/r)*100 + c*r*0.1::DOUBLE, c := c, r := r)) AS m
      FROM (SELECT p_partkey, (1 + p_size)/(1 + p_partkey % 13)::DOUBLE AS ratio FROM part),
      (SELECT CAST(i AS INT) AS c FROM range(1, 9) t(i)), (SELECT CAST(i AS INT) AS r FROM range(1, 9) t(i)) GROUP BY p_partkey)""",
)
def _(spark, d):
    shapes = V.table(spark, d, "part").select(
        "p_partkey", (1 + F.col("p_size")).alias("w"), (1 + F.col("p_partkey") % 13).alias("h")
    )
    return B.best_grid(shapes, "w", "h").select("p_partkey", "cols", "rows")


# ── chunks and segments ─────────────────────────────────────────────────────

_CHUNKS = """SELECT doc_id, CAST(i AS INT) AS idx, substr(text, CAST(i*48 + 1 AS BIGINT), 48) AS body FROM
  (SELECT doc_id, text, unnest(range(CAST(ceil(length(text)/48::DOUBLE) AS BIGINT))) AS i FROM documents)"""


@query("chunk_explode", f"SELECT doc_id, idx, body, printf('%02x', idx) || body AS name FROM ({_CHUNKS})")
def _(spark, d):
    return K.chunk_explode(V.table(spark, d, "documents"), "doc_id", "text")


@query(
    "chunk_assemble",
    """SELECT doc_id, md5(text) AS digest, length(text) AS chars, CAST(ceil(length(text)/48::DOUBLE) AS BIGINT) AS n_chunks, TRUE AS complete FROM documents""",
)
def _(spark, d):
    chunks = K.chunk_explode(V.table(spark, d, "documents"), "doc_id", "text")
    whole = K.chunk_assemble(chunks, ["doc_id"])
    return whole.select(
        "doc_id",
        F.md5(F.encode("payload", "UTF-8")).alias("digest"),
        F.length("payload").cast("long").alias("chars"),
        "n_chunks",
        "complete",
    )


@query(
    "chunk_assemble_gaps",
    """SELECT grp, md5(string_agg(body, '' ORDER BY idx)) AS digest, count(*) AS n_chunks,
       min(idx) = 0 AND max(idx) = count(*) - 1 AS complete FROM parts WHERE (grp + idx) % 5 <> 3 GROUP BY grp""",
)
def _(spark, d):
    arrived = V.parts(spark, d).where((F.col("grp") + F.col("idx")) % 5 != 3)
    again = arrived.where(F.col("idx") % 2 == 0)  # repeats must not count
    whole = K.chunk_assemble(arrived.union(again), ["grp"])
    return whole.select("grp", F.md5(F.encode("payload", "UTF-8")).alias("digest"), "n_chunks", "complete")


@query(
    "valid_chunks",
    """SELECT doc_id, kind FROM (SELECT doc_id, CASE WHEN length(name) >= 6 AND name[:2] = 'LC' THEN 'LC' WHEN length(name) >= 10 AND name[:2] = 'LS' THEN 'LS'
       WHEN length(name) >= 24 AND name[:2] = 'MG' THEN 'MG' WHEN regexp_matches(name, '^[0-9a-fA-F+-][0-9a-fA-F]') THEN 'chunk' END AS kind
       FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'LC' WHEN 1 THEN 'LS' WHEN 2 THEN 'MG' WHEN 3 THEN printf('%02x', doc_id % 256) ELSE '' END || text AS name FROM documents))
       WHERE kind IS NOT NULL""",
)
def _(spark, d):
    i = F.col("doc_id")
    head = (
        F.when(i % 5 == 0, F.lit("LC"))
        .when(i % 5 == 1, F.lit("LS"))
        .when(i % 5 == 2, F.lit("MG"))
        .when(i % 5 == 3, K.hex_index(i % 256))
        .otherwise(F.lit(""))
    )
    kind = P.valid_chunk_kind(F.concat(head, F.col("text")))
    return V.table(spark, d, "documents").select("doc_id", kind.alias("kind")).where(F.col("kind").isNotNull())


@query(
    "missing_chunks",
    """SELECT grp, i AS idx FROM (SELECT grp, unnest(range(expected)) AS i FROM (SELECT DISTINCT grp, expected FROM parts))
       EXCEPT SELECT grp, idx FROM parts""",
)
def _(spark, d):
    parts = V.parts(spark, d)
    return K.missing_chunks(parts, parts, ["grp"])


@query(
    "first_incomplete",
    """SELECT grp, coalesce(min(CASE WHEN length(body) % 700 < total THEN idx END), -1) AS next_idx
       FROM (SELECT *, 40 + grp % 300 AS total FROM parts) GROUP BY grp""",
)
def _(spark, d):
    progress = V.parts(spark, d).select(
        "grp", "idx", (F.length("body") % 700).alias("done"), (40 + F.col("grp") % 300).alias("total")
    )
    return K.first_incomplete(progress, ["grp"])


@query(
    "group_complete",
    "SELECT grp, count(DISTINCT idx) AS seen, max(expected) AS total, count(DISTINCT idx) = max(expected) AS complete FROM parts GROUP BY grp",
)
def _(spark, d):
    return K.group_complete(V.parts(spark, d), ["grp"])


_ROLE_FRAMES = "SELECT conv_id, role, count(*) AS frames FROM conversations GROUP BY ALL"


@query(
    "group_consistent",
    " UNION ALL ".join(
        f"""SELECT {full} AS full_colour, conv_id, count(*) AS tiles, min(frames) AS frames FROM ({_ROLE_FRAMES}) GROUP BY conv_id
        HAVING count(*) >= 2 AND count(DISTINCT frames) = 1 AND min(frames) >= {least}"""
        for full, least in (("FALSE", 2), ("TRUE", 1))
    ),
)
def _(spark, d):
    tiles = V.table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("frames"))
    out = None
    for full in (False, True):
        # the tile rows carry their own frame count, named apart from the result's
        rows = K.group_consistent(tiles.withColumnRenamed("frames", "fc"), ["conv_id"], "fc", full)
        rows = rows.select(F.lit(full).alias("full_colour"), "conv_id", "tiles", "frames")
        out = rows if out is None else out.union(rows)
    return out


@query(
    "even_split",
    """SELECT doc_id, i AS part, CAST(sum(base + CASE WHEN i < rem THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - (base + CASE WHEN i < rem THEN 1 ELSE 0 END) AS "offset",
       base + CASE WHEN i < rem THEN 1 ELSE 0 END AS len FROM (SELECT doc_id, CAST(floor(n_chars/t) AS BIGINT) AS base, n_chars % t AS rem, unnest(range(t)) AS i
       FROM (SELECT doc_id, n_chars, 1 + doc_id % 7 AS t FROM documents))""",
)
def _(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    out = K.even_split(docs, ["doc_id"], "n_chars", 1 + F.col("doc_id") % 7)
    return out.select("doc_id", "part", "offset", "len")


OWN = 2000


def donor_segments(spark, d):
    """Texts above the budget: their tail in three donor slices, keyed by receiver."""
    docs = V.table(spark, d, "documents").select("doc_id", "text", F.length("text").cast("long").alias("total"))
    long_docs = docs.where(F.col("total") > OWN)
    tails = long_docs.withColumn("tail", F.col("total") - OWN)
    cut = K.even_split(tails, ["doc_id", "text", "total"], "tail", F.lit(3)).withColumn(
        "offset", (F.col("offset") + OWN).cast("int")
    )
    body = F.expr("substring(text, offset + 1, cast(len as int))")
    return cut.select("doc_id", F.col("part").alias("donor"), "offset", body.alias("body"), "total")


def own_segments(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text", F.length("text").cast("long").alias("total"))
    return docs.where(F.col("total") > OWN).select(
        "doc_id", F.lit(0).alias("offset"), F.substring("text", 1, OWN).alias("body"), "total"
    )


@query(
    "route_segments",
    """SELECT d.doc_id, source, i AS donor, CAST(2000 + i*CAST(floor((length(text)-2000)/3) AS BIGINT) + least(i, (length(text)-2000) % 3) AS INT) AS "offset",
       CAST(floor((length(text)-2000)/3) AS BIGINT) + CASE WHEN i < (length(text)-2000) % 3 THEN 1 ELSE 0 END AS len
       FROM documents d, range(3) r(i) WHERE length(text) > 2000""",
)
def _(spark, d):
    receivers = V.table(spark, d, "documents").select("doc_id", "source")
    routed = K.route_segments(donor_segments(spark, d), receivers, ["doc_id"])
    return routed.select("doc_id", "source", "donor", "offset", F.length("body").cast("long").alias("len"))


@query(
    "segment_assemble",
    """SELECT doc_id, CASE WHEN complete THEN md5(text) END AS digest, total, complete FROM
       (SELECT doc_id, text, length(text) AS total, doc_id % 4 <> 0 OR length(text) < 2003 AS complete FROM documents WHERE length(text) > 2000)""",
)
def _(spark, d):
    # every fourth receiver still waits for its last donor (which has nothing to add below three bytes)
    arrived = donor_segments(spark, d).where((F.col("doc_id") % 4 != 0) | (F.col("donor") != 2)).drop("donor")
    repeats = arrived.where(F.col("doc_id") % 2 == 0)
    segments = own_segments(spark, d).unionByName(arrived).unionByName(repeats)
    whole = K.segment_assemble(segments, ["doc_id"])
    digest = F.when(F.col("complete"), F.md5(F.encode("payload", "UTF-8")))
    return whole.select("doc_id", digest.alias("digest"), "total", "complete")


# ── secrets ─────────────────────────────────────────────────────────────────

KEY_RING = ["0123456789abcdef", "fedcba9876543210"]
LOST_KEY = "aaaabbbbccccdddd"


@query(
    "encrypt_column",
    "SELECT conv_id, turn, octet_length(encode(text)) + 28 AS secret_bytes, FALSE AS readable FROM conversations",
)
def _(spark, d):
    c = V.table(spark, d, "conversations")
    hidden = X.encrypt_column(F.col("text"), F.lit(KEY_RING[0]))
    return c.select(
        "conv_id",
        "turn",
        F.octet_length(hidden).cast("long").alias("secret_bytes"),
        (F.hex(hidden).contains(F.hex("text"))).alias("readable"),
    )


@query(
    "try_decrypt_column",
    """SELECT conv_id, turn, CASE WHEN conv_id % 3 = 2 THEN NULL ELSE text END AS plain,
       CASE WHEN conv_id % 3 = 2 THEN NULL ELSE CAST(conv_id % 3 AS INT) END AS key_rank FROM conversations""",
)
def _(spark, d):
    c = V.table(spark, d, "conversations")
    key = F.element_at(F.array(*(F.lit(k) for k in (*KEY_RING, LOST_KEY))), (F.col("conv_id") % 3 + 1).cast("int"))
    hidden = c.select("conv_id", "turn", X.encrypt_column(F.col("text"), key).alias("secret"))
    return X.try_decrypt_column(hidden, "secret", KEY_RING).drop("secret")


# ── batches, JSON and stock maps ────────────────────────────────────────────

FILE_DOCUMENTS = 10_000
_PROPS_K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query("props_extract", f"SELECT event_id, {_PROPS_K} AS k FROM events")
def _(spark, d):
    props = F.from_json("props", "k int")
    return V.table(spark, d, "events").select("event_id", props["k"].alias("k"))


@query(
    "read_batches",
    f"""SELECT event_id, {_PROPS_K} AS columns, 1 AS rows, 0 AS active, FALSE AS dither, 'CARPET_SHADE' AS codec,
        CAST(i AS INT) AS tile, CAST(CASE WHEN i = 0 THEN user_id ELSE 0 END AS INT) AS nonce, 1 AS frames, FALSE AS muxed
        FROM events, range(2) r(i)""",
)
def _(spark, d):
    # old snapshots: the k property as the grid width and one tile of two with a nonce, one document per line
    old = V.table(spark, d, "events").select(
        F.concat(
            F.lit('{"sourceFilename": "'),
            F.col("event_id").cast("string"),
            F.lit('", "columns": '),
            F.get_json_object("props", "$.k"),
            F.lit(', "tiles": [{"nonce": '),
            F.col("user_id").cast("string"),
            F.lit("}, {}]}"),
        ).alias("value"),
    )
    path = fresh_path(spark, "old-batches")
    old.write.option("maxRecordsPerFile", FILE_DOCUMENTS).text(path)
    head = J.read_batches(spark, path).select(
        F.col("sourceFilename").cast("long").alias("event_id"),
        "columns",
        "rows",
        F.col("activeTileIndex").alias("active"),
        "dither",
        F.col("codecMode").alias("codec"),
        "tiles",
    )
    tiles = J.batch_tiles(head, "event_id", "columns", "rows", "active", "dither", "codec")
    return tiles.select(
        "event_id", "columns", "rows", "active", "dither", "codec", "tile", "nonce", F.col("frameCount").alias("frames"), "muxed"
    )


@query(
    "write_batches",
    """SELECT user_id, '{"title":"' || event_type || '","columns":' || event_id % 8 + 1 || ',"rows":' || user_id % 8 + 1 || ',"tiles":[{"nonce":' || event_id || '}]}' AS json FROM events""",
)
def _(spark, d):
    e = V.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("sourceFilename"),
        F.col("event_type").alias("title"),
        (F.col("event_id") % 8 + 1).alias("columns"),
        (F.col("user_id") % 8 + 1).alias("rows"),
        F.array(F.struct(F.col("event_id").alias("nonce"))).alias("tiles"),
    )
    path = fresh_path(spark, "batches")
    J.write_batches(e, path)
    back = J.read_batches(spark, path, lines=True).select(
        F.col("sourceFilename").cast("long").alias("user_id"),
        "title",
        "columns",
        "rows",
        F.transform("tiles", lambda t: F.struct(t["nonce"].alias("nonce"))).alias("tiles"),
    )
    return J.batch_json(back, "user_id")


@query(
    "stock_explode",
    f"""SELECT event_id, 'w' || user_id % 3 AS world, user_id % 50 || ',64,' || event_id % 100 AS pos, event_type AS item, {_PROPS_K} AS n FROM events""",
)
def _(spark, d):
    e = V.table(spark, d, "events")
    place = F.concat((F.col("user_id") % 50).cast("string"), F.lit(",64,"), (F.col("event_id") % 100).cast("string"))
    items = F.create_map("event_type", F.from_json("props", "k int")["k"])
    nested = F.create_map(F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")), F.create_map(place, items))
    saved = e.select("event_id", F.to_json(nested).alias("json"))
    return ST.stock_explode(saved, F.from_json("json", ST.NESTED), "event_id")


@query(
    "stock_collapse",
    f"""SELECT world, pos, string_agg(item || '=' || n, ',' ORDER BY item) AS items FROM (
      SELECT 'w' || user_id % 3 AS world, CAST(user_id % 50 AS VARCHAR) AS pos, event_type AS item, max({_PROPS_K}) AS n FROM events GROUP BY ALL) GROUP BY ALL""",
)
def _(spark, d):
    rows = V.table(spark, d, "events").select(
        F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("world"),
        (F.col("user_id") % 50).cast("string").alias("pos"),
        F.col("event_type").alias("item"),
        F.from_json("props", "k int")["k"].alias("n"),
    )
    maps = ST.stock_collapse(rows)
    shown = F.transform(F.map_entries("items"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("world", "pos", F.array_join(shown, ",").alias("items"))


# ── history and pages ───────────────────────────────────────────────────────


@query(
    "history_top",
    """SELECT owner, id, saved_seq, rank, version, total_tiles, list_sum(list_transform(range(1, total_tiles + 1), lambda t: CAST(1 + (id + t) % 9 AS INT)))::INT AS total_frames
    FROM (SELECT *, CAST((1 + id % 3)*(1 + id % 2) AS INT) AS total_tiles, CAST(1 + id % 5 AS INT) AS version,
      CAST(row_number() OVER (PARTITION BY owner ORDER BY saved_seq DESC) AS INT) AS rank FROM sess) WHERE rank <= 30 AND version BETWEEN 2 AND 4""",
)
def _(spark, d):
    i = F.col("id")
    grid = {"version": (1 + i % 5).cast("int"), "grid_cols": (1 + i % 3).cast("int"), "grid_rows": (1 + i % 2).cast("int")}
    frames = F.transform(F.sequence(F.lit(1), F.col("grid_cols") * F.col("grid_rows")), lambda t: (1 + (i + t) % 9).cast("int"))
    saved = V.sess(spark, d).withColumns(grid).withColumn("frame_counts", frames)
    listed = H.session_totals(H.history_top(saved, "owner", "saved_seq", version="version"))
    return listed.select("owner", "id", "saved_seq", "rank", "version", "total_tiles", "total_frames")


def _page_sql(no: int) -> str:
    return f"""SELECT {no} AS asked, source, doc_id, row_no, pages FROM (SELECT source, doc_id, row_number() OVER w AS row_no,
      CAST(ceil(count(*) OVER (PARTITION BY source)/10::DOUBLE) AS BIGINT) AS pages FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
      WHERE row_no BETWEEN (greatest(1, least({no}, pages)) - 1)*10 + 1 AND greatest(1, least({no}, pages))*10"""


@query("page", " UNION ALL ".join(_page_sql(n) for n in (0, 2, 9999)))
def _(spark, d):
    docs = V.table(spark, d, "documents").select("source", "doc_id")
    out = None
    for no in (0, 2, 9999):
        rows = H.page(docs, ["source"], "doc_id", no).select(F.lit(no).alias("asked"), "source", "doc_id", "row_no", "pages")
        out = rows if out is None else out.union(rows)
    return out
