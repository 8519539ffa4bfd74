"""Corpus operators against plain versions, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from gridspark.llm import byte_bpe, components, gam_quality, graph_ann, jaccard_join, language_id, line_frequency, mixing, pii_tagger, token_count, warc
from gridspark.llm.queries import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and repeated rows, a long text, clashing column names."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = [rng.choice(words) for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    texts = [None, "", " \n\t", "a", "a b", long, " ".join(base), " ".join(base), " ".join(near), "héé  ça\n va", "x\x1c y  z  　q", "퟿𐍈 ok 😀😀", "<|endoftext|> in a text"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None, 0.5, "x") for i, t in enumerate(texts)]
    rows += [rows[6], rows[0], (None, "no id at all here", "fr", "s1", 3, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_sql(spark, name):
    from tests.test_queries import TABLES, rows

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    want = db.execute(CHECKS[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_token_counts(spark, odd, none):
    tokenizer = token_count.load_tokenizer(token_count.default_path())
    want = Counter((r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False))) for r in odd.collect())
    assert Counter(map(tuple, token_count.count_tokens(odd).collect())) == want
    assert Counter(map(tuple, token_count.count_tokens(odd, huge=20).collect())) == want
    assert token_count.count_tokens(none).count() == 0


def test_resynchronisation_widens():
    tokenizer = token_count.load_tokenizer(token_count.default_path())

    def encode(text):
        return tokenizer.encode(text, add_special_tokens=False)

    rng = random.Random(2)
    for text in ("x" * 3000, "ab " * 900, "é" * 500 + " word" * 300, "".join(rng.choice("ab  \n.é1") for _ in range(4000))):
        assert token_count.encode_huge(encode, text, chunk=200, overlap=16) == encode(text).ids


def test_byte_bpe_matches_ranks(spark, odd, none):
    import tiktoken

    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    exact = tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    fuzz = ["".join(rng.choice("aAbc dé  \n\t'sll 0123.,!漢字а😀\x85\x1c ") for _ in range(60)) for _ in range(400)]
    codec = byte_bpe.Codec(byte_bpe.default_path(), byte_bpe.default_pattern())
    for text in fuzz:
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == exact.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()
        first, last = codec.offsets(packed, np.frombuffer(text.encode(), np.uint8))
        tokens = [codec.table[i] for i in np.frombuffer(packed, "<u4")]
        at = 0
        for token, a, b in zip(tokens, first, last):
            assert a == sum((x & 0xC0) != 0x80 for x in text.encode()[: at + 1]) - 1
            at += len(token)
            assert b == sum((x & 0xC0) != 0x80 for x in text.encode()[:at])
        assert "".join(byte_bpe.text_pieces(tokens)) == text
    both = byte_bpe.encode(odd, offsets=True, decoded=True)
    assert Counter(bytes(r.decoded) for r in both.collect()) == Counter((r.text or "").encode() for r in odd.collect())
    got = byte_bpe.decode(both).collect()
    want = Counter((r.doc_id, bytes(np.array(exact.encode_ordinary(r.text or ""), "<u4").tobytes()), (r.text or "").encode()) for r in odd.collect())
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert byte_bpe.encode(none).count() == 0


def test_line_frequency(spark, odd, none):
    rows = [(i, "Shared LINE 1\n" + " ".join("abcd"[i] + chr(97 + k % 26) + chr(97 + k // 26) for k in range(60)), None, "h", None, 0.0, "") for i in range(4)]
    rows += [(9, "shared  line 22\n" * 30, None, "h", None, 0.0, ""), (10, "shared line 1", None, None, None, 0.0, "")]
    found = {r.doc_id: r for r in line_frequency.line_frequency(spark.createDataFrame(rows, DOCS), max_docs=3).collect()}
    assert [found[i].removed_words for i in (0, 1, 2, 3, 9, 10)] == [3, 3, 3, 3, 90, 0]
    assert [found[i].kept for i in (0, 9, 10)] == [True, False, False]
    assert line_frequency.line_frequency(odd).count() == odd.count()
    assert line_frequency.line_frequency(none).count() == 0


def test_frequent_lines_are_cut(spark, odd, none):
    own = [" ".join("abcd"[i] + chr(97 + k % 26) + chr(97 + k // 26) for k in range(60)) for i in range(4)]
    rows = [(i, f"Shared LINE 1\n\n{own[i]}\nshared line  7", None, "h", None, 0.0, "") for i in range(4)]
    rows += [(9, "shared  line 22\n" * 30, None, "h", None, 0.0, ""), (10, "shared line 1", None, None, None, 0.0, ""), (11, None, None, "h", None, 0.0, "")]
    found = {r.doc_id: r for r in line_frequency.cut_frequent_lines(spark.createDataFrame(rows, DOCS), max_docs=3).collect()}
    assert [found[i].text for i in range(4)] == ["\n" + text for text in own]
    assert [found[i].text for i in (9, 10, 11)] == ["", "shared line 1", None]
    assert [found[i].removed_words for i in (0, 9, 10, 11)] == [6, 90, 0, 0]
    assert Counter(r.text for r in line_frequency.cut_frequent_lines(odd).collect()) == Counter(r.text for r in odd.collect())
    assert line_frequency.cut_frequent_lines(none).count() == 0


def plain_groups(rows, words, percent):
    sets = []
    for _, text in rows:
        ws = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
        sets.append({tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} or ({tuple(ws)} if ws else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    lowest = defaultdict(list)
    for (doc, _), g in zip(rows, group):
        lowest[g].append(doc)
    return Counter((doc, len(s), min((x for x in lowest[g] if x is not None), default=None)) for (doc, _), s, g in zip(rows, sets, group))


def test_heads_that_collide_refute_no_link():
    rule, frequent = jaccard_join.Rule(), np.zeros(1 << jaccard_join.SKETCH_BITS, bool)
    tokens = np.repeat(np.arange(1, 201, dtype=np.uint64) << np.uint64(32), 2) + np.tile(np.arange(2, dtype=np.uint64), 200)
    heads = jaccard_join._heads(tokens)
    assert not jaccard_join._refuted(heads.tobytes(), heads.tobytes(), 400, 400, frequent, rule)
    other = np.sort(np.concatenate([heads[:200], heads[:200] + np.uint32(100)]))
    last = np.append(heads[200:-1], other[-1])
    assert jaccard_join._refuted(other.tobytes(), last.tobytes(), 400, 200, frequent, rule)


def test_jaccard(spark, odd, none, monkeypatch):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(3000)]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for k in range(6):
        text = [rng.choice(words) for _ in range(rng.choice((8, 40, 200)))]
        for c in range(8):
            copy = list(text)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 + 10 * k + c, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows, 4, 85)
    assert Counter(map(tuple, jaccard_join.jaccard_components(docs).collect())) == want
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.keep_one(docs, jaccard_join.Rule(4, 85))
    alone = [r for r in rows if not (r[1] or "").split()]
    assert kept.count() == len(alone) + len({c for _, n, c in want if n})


@pytest.mark.parametrize("one_task", [1 << 20, 40, 0])
def test_components(spark, monkeypatch, one_task):
    """Paths, a star and loops, labelled in one task, after some rounds, and by rounds alone."""
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(300, 299), (299, 300), (7, 7)]
    want = {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}, 299: 299, 300: 299}
    got = components.connected(spark.createDataFrame(links[::-1], "a long, b long").repartition(5))
    assert {r.node: r.root for r in got.collect()} == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_frequent_tokens_find_every_link():
    """With any choice of frequent tokens two sets that link share an index token."""
    rng = np.random.default_rng(5)
    rule = jaccard_join.Rule(4, 85)
    for share in (0.0, 0.5, 0.97, 1.0):
        frequent = rng.random(1 << jaccard_join.SKETCH_BITS) < share
        for _ in range(300):
            n = int(rng.integers(7, 120))
            a = np.unique(jaccard_join.mix(rng.integers(0, 1 << 60, n).astype(np.uint64)))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], jaccard_join.mix(rng.integers(0, 1 << 60, 3).astype(np.uint64))]))
            shared = len(np.intersect1d(a, b))
            if np.array_equal(a, b) or 100 * shared < 85 * (len(a) + len(b) - shared):
                continue
            (x, fx), (y, fy) = jaccard_join.prefix_tokens(a, frequent, rule), jaccard_join.prefix_tokens(b, frequent, rule)
            assert len(np.intersect1d(x, y))
            heads = [jaccard_join._heads(f).tobytes() for f in (fx, fy)]
            assert not jaccard_join._refuted(*heads, len(a), len(b), frequent, rule)


def test_parities_bound_the_difference():
    """The bits in which two sets' parities differ never outnumber the tokens in which the sets do."""
    rng = np.random.default_rng(6)
    for n in (0, 1, 60, 5000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[rng.random(n) > 0.1], rng.integers(0, 1 << 63, n // 20).astype(np.uint64)])
        bits = sum(int(x ^ y).bit_count() for x, y in zip(jaccard_join.parity(a).view(np.uint64), jaccard_join.parity(b).view(np.uint64)))
        assert bits <= len(np.setxor1d(a, b))
        assert n != 60 or bits >= len(np.setxor1d(a, b)) - 4


def test_jaccard_later_rounds(spark, monkeypatch):
    """Texts that share a long passage fall into the same buckets without being linked: rounds of small steps find every link."""
    monkeypatch.setattr(jaccard_join, "STEP", 3)
    monkeypatch.setattr(jaccard_join, "SLICE", 4)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"q{rng.randrange(12)}" for _ in range(rng.randrange(4, 16))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((4, 85), (5, 80)):
        rule = jaccard_join.Rule(words, percent)
        assert Counter(map(tuple, jaccard_join.jaccard_components(docs, rule).collect())) == plain_groups(rows, words, percent)


def test_mix(spark, odd, none):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in rows)
    assert abs(sum({r.source_size: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1
    copies = mixing.mix_documents(odd)
    assert copies.columns == odd.columns
    assert copies.count() == sum(r.taken // r.size for r in rows if r.size)
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_warc(spark, tmp_path):
    trap = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0 after é"
    pages = [(1, "http://a\r\nb", "same"), (2, None, "same"), (3, "u", None), (4, "u", trap), (5, "u", "é" * 10), (None, "u", "same"), (7, "u", ""), (2, None, "same"), (8, "u", trap * 3)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest long")
    got = warc.archive_pages(df).collect()
    top = {}
    for page, _, html in pages:
        top[html or ""] = max(page or 0, top.get(html or "", 0))
    import base64

    def row(page, html):
        data = (html or "").encode()
        again = page != top[html or ""]
        return page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top[html or ""] if again else None

    assert Counter(map(tuple, got)) == Counter(row(p, h) for p, _, h in pages)
    assert warc.archive_pages(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.archive_pages(df.where("page_id in (1, 2)"), min_bytes=5).collect()} == {"response"}


def test_graph_recall(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[100:140] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [None] * 16), (None, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in graph_ann.nearest(df, shard=400).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        exact = v.astype(float) @ v[q].astype(float)
        exact[q] = -np.inf
        order = sorted(range(1500), key=lambda i: (-round(exact[i], 9), i))[:20]
        hits += len(set(order) & {i for i, _ in found})
        assert len(found) == 20 and q not in {i for i, _ in found}
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert hits / (20 * len(got)) >= 0.9
    assert graph_ann.nearest(df.limit(0)).count() == 0


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    net = language_id.learn(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = language_id.predict(docs, net).collect()
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in found]) > 0.9
    strange = language_id.predict(odd, net).collect()
    assert len(strange) == odd.count() and all(0 <= r.score <= 1 for r in strange)
    assert all(r.lang_pred == "und" for r in strange if r.doc_id in (0, 1, 2))
    assert language_id.learn(none) is None
    assert language_id.predict(odd, None).where("lang_pred <> 'und'").count() == 0


def test_network_gradients():
    rng = np.random.default_rng(8)
    w = {k: v.astype(np.float64) for k, v in language_id._new_weights(3, rng).items()}
    x, size, y = rng.integers(97, 103, (5, 4)), np.array([5, 5, 3, 5]), np.array([0, 1, 2, 1])

    def loss(weights):
        states = language_id._forward(weights, x)
        z = np.matmul(weights["out"], states) + weights["bias"][:, None]
        z = z - z.max(axis=1, keepdims=True)
        p = np.log(np.exp(z) / np.exp(z).sum(axis=1, keepdims=True))[:, y, np.arange(4)]
        return -(p * (np.arange(5)[:, None] < size)).sum() / size.sum()

    grads = language_id._gradients(w, x, size, y)
    for name in ("rec", "inner", "out", "in"):
        for at in list(zip(*np.nonzero(np.abs(grads[name]) > 1e-3)))[:4]:
            plus, minus = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            plus[name][at] += 1e-2
            minus[name][at] -= 1e-2
            assert abs((loss(plus) - loss(minus)) / 2e-2 - grads[name][at]) < 2e-3


def test_pii(spark, odd, none):
    text = "Mail a.b@c.org or é@x.y, ip 1.2.3.4 and 256.1.1.1, card 4111 1111 1111 1111, call +1 (314) 555-0199. x@y@z.com"
    base = pii_tagger.base_spans(text)
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert [(a, b) for k, a, b in base if k == "email"] == [m.span() for m in email.finditer(text)]
    assert [(k, text[a:b]) for k, a, b in base if k != "email"] == [("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (314) 555-0199")]
    rng = random.Random(9)
    for _ in range(500):
        t = "".join(rng.choice("ab@.@-1 ") for _ in range(40))
        assert pii_tagger.emails(t) == [m.span() for m in email.finditer(t)]
    tagger = pii_tagger.train(["filler text here " * 20 + text, "plain words " * 40] * 10, steps=60)
    docs = spark.createDataFrame([(1, text * 30), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii_tagger.tag_documents(docs, tagger).collect()}
    assert rows[1].base_spans == pii_tagger.written(pii_tagger.base_spans(text * 30))
    assert set(rows[1].base_spans.split(",")) <= set(rows[1].spans.split(","))
    assert rows[2].spans == rows[3].spans == "" and rows[2].n_email == 0
    masked = {r.doc_id: r.text for r in pii_tagger.mask_documents(docs, tagger).collect()}
    assert "4111" not in masked[1] and "a.b@c.org" not in masked[1] and masked[2] is None
    assert pii_tagger.learn(none) is None and pii_tagger.tag_documents(odd, None).count() == odd.count()


def test_skipping_viterbi_is_exact():
    rng = np.random.default_rng(10)
    step = rng.normal(0, 1, (pii_tagger.TAGS, pii_tagger.TAGS)).astype(np.float32)
    gain = 2 * max(0.0, float((step - step[0, 0]).max()))
    e = rng.normal(0, 1, (30, pii_tagger.TAGS, 200)).astype(np.float32)
    e[:, 0] = e[:, 1:].max(axis=1) + gain + 1e-3
    assert not pii_tagger.viterbi(e, step).any()


def test_quality(spark, odd, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = gam_quality.learn(docs, labels)
    scored = gam_quality.score(odd, model)
    assert scored.count() == odd.count() and set(scored.columns) == set(odd.columns)
    assert all(0 <= r.score <= 1 for r in scored.collect())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = gam_quality.score(docs.select("doc_id", "text"), model).collect()
    good = [r.score for r in rows if truth.get(r.doc_id) == 1]
    bad = [r.score for r in rows if truth.get(r.doc_id) == 0]
    assert np.mean(good) > np.mean(bad) + 0.3
    assert gam_quality.score(odd, gam_quality.learn(none, labels.limit(0))).select("score").distinct().count() == 1


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "tokens":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    assert docs.count() > 0
