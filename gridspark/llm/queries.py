"""The registered queries of this subpackage, with DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import byte_bpe, gam_quality, graph_ann, jaccard_join, language_id, lexical_search, line_dedup, line_frequency, mixing, pii_tagger
from gridspark.llm import token_alignment, token_count, warc
from gridspark.llm.text import fold, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    found = language_id.predict(docs, language_id.learn(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return line_frequency.line_frequency(read(spark, folder, "documents"))


def op3_pii_tagger(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    found = pii_tagger.tag_documents(docs, pii_tagger.learn(docs))
    counts = [f"n_{kind}" for kind in pii_tagger.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans")


def op4_graph_ann(spark: SparkSession, folder: str) -> DataFrame:
    return graph_ann.nearest(read(spark, folder, "embeddings"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_count.count_tokens(read(spark, folder, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(read(spark, folder, "documents"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = byte_bpe.encode(read(spark, folder, "documents"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(read(spark, folder, "pages"))


def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_gam_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = gam_quality.learn(docs, read(spark, folder, "labels"))
    scored = gam_quality.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= gam_quality.CUTOFF).cast("int"))


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    kept = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align_tokenizers(read(spark, folder, "documents"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_line_frequency,
        op3_pii_tagger,
        op4_graph_ann,
        op5_token_counts,
        op6_source_mix,
        op7_byte_bpe,
        op8_warc,
        op9_ngram_jaccard,
        op10_gam_quality,
        op11_line_dedup,
        op12_token_alignment,
        op13_lexical_search,
    )
}

_LINES = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, pos, array_to_string(list_slice(ws, pos, pos + 2), ' ') AS three
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS pos FROM w WHERE len(ws) > 2)),
twice AS (SELECT rid, three FROM win GROUP BY ALL HAVING count(*) > 1),
again AS (SELECT rid, count(DISTINCT place) AS n_repeat_words
          FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS place FROM win JOIN twice USING (rid, three)) GROUP BY rid),
ln AS (SELECT rid, source, line, regexp_extract_all(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[^\x20\x09-\x0D]+') AS ws
       FROM (SELECT rid, source, unnest(string_split(t, chr(10))) AS line FROM d)),
live AS (SELECT rid, source, line, len(ws) AS words, array_to_string(ws, ' ') AS norm FROM ln WHERE len(ws) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM live GROUP BY rid),
often AS (SELECT coalesce(source, '') AS host, source IS NULL AS no_host, norm FROM live GROUP BY ALL HAVING count(DISTINCT rid) > 100),
gone AS (SELECT rid, sum(words) AS removed_words FROM live JOIN often
         ON coalesce(source, '') = host AND (source IS NULL) = no_host AND live.norm = often.norm GROUP BY rid),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
      CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
      FROM w LEFT JOIN dup USING (rid) LEFT JOIN again USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND n_words - removed_words >= n_words * 0.5 AS kept FROM b
"""

_MIX = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           length(coalesce(text, '')) AS chars,
           (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT *, -ln(CAST(u AS DOUBLE)) / greatest(0.1::DOUBLE, least(1.0::DOUBLE,
      1.0::DOUBLE - abs(chars::DOUBLE / greatest(size, 1)::DOUBLE - 6.5::DOUBLE) / 10.0::DOUBLE)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 3 * source_size AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weight_left
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap * weight_left <= rest * w AS is_full FROM f),
l AS (SELECT max(weight_left) FILTER (NOT is_full) AS top, arg_max(rest, weight_left) FILTER (NOT is_full) AS top_rest FROM g),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (top_rest * w)::DOUBLE / top::DOUBLE END AS target FROM g, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, source_size, target, epochs, target - (epochs * source_size)::DOUBLE AS budget,
      sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS through
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, epochs + CASE WHEN budget > 0 AND through - size / 2.0 < budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hexed FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hexed) AS top FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST('0x' || substr(hexed, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM g
"""

_JACCARD = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
       ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

_FIRST_LINES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
g AS (SELECT k.*, first_doc IS NOT NULL AND doc_id IS DISTINCT FROM first_doc AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY rid, doc_id
"""

_RANKED = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(len(ts)) AS BIGINT) AS all_terms FROM d WHERE len(ts) > 0),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
t AS (SELECT rid, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(((2 * all_docs + 2) / (2 * count(*) + 1))::DOUBLE)) AS BIGINT) AS w FROM t, s GROUP BY term, all_docs),
g AS (SELECT rid, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * all_docs) // all_terms))) AS gain FROM t, s),
r AS (SELECT item_id, rid, doc_id, CAST(sum(times * w * gain) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN g USING (term) GROUP BY ALL HAVING sum(times * w * gain) > 0),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid) AS INT) AS rank, doc_id, score FROM r)
SELECT * FROM o WHERE rank <= 10
"""

#: The tokenizers, the trained models and the approximate search have no SQL form; the tests hold them against plain versions.
CHECKS: dict[str, str] = {
    "op2_line_frequency": _LINES,
    "op6_source_mix": _MIX,
    "op8_warc": _WARC,
    "op9_ngram_jaccard": _JACCARD,
    "op11_line_dedup": _FIRST_LINES,
    "op13_lexical_search": _RANKED,
}
