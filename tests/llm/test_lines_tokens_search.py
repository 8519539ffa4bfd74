"""Line dedup, tokenizer alignment and lexical search against plain versions, on odd tables and on the small ones."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pytest

from gridspark.llm import lexical_search, line_dedup, token_alignment
from gridspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Columns that clash with names used inside the operators.
DOCS = "doc_id long, text string, lang string, source string, row long, h1 long, bag string, block long, first long, n long"
BLANKS = " \t\n\x0b\f\r"


def lower(text):
    return text.translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    words = [f"Wort{i}" for i in range(60)] + ["été", "漢字漢字", "x_y", "a-b"]
    shared = ["This line stands in many documents", "  ÄÖÜ äöü with letters of Its own \t", "short"]
    long = "\n".join(" ".join(rng.choice(words) for _ in range(8)) if i % 50 else shared[i % 2] for i in range(4000))
    texts = [None, "", "\n", " \n\t", long, "\n".join(shared), "\n\n".join(shared) + "\n", shared[0].upper() + "\n" + shared[0], shared[1], "ten chars!", "TEN CHARS!  ", "one", "<|endoftext|> ab ▁ c", "x" * 3000, "trailing  ", "  leading", "a\x00b c\x85d　e \x1cf"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    rows = [(i, t, None, "s" if i % 3 else None, 1, 2, "b", 3, 4, 5) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0], (5, "another text under the same id\n" + shared[0], *rows[0][2:]), (None, shared[0], *rows[0][2:]), (None, "only without an id\nonly without an id", *rows[0][2:])]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain_lines(rows):
    last = 1 << 70
    key = lambda line: lower(line.strip(BLANKS))
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), last), last if doc is None else doc)
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in first or first[key(x)] == (last if doc is None else doc)]
        out[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("slice_rows", [line_dedup.SLICE_ROWS, 3])
def test_line_dedup(odd, none, slice_rows):
    got = line_dedup.drop_lines(odd, line_dedup.keep_bitmaps(odd, slice_rows=slice_rows))
    assert Counter(map(tuple, got.collect())) == plain_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert line_dedup.drop_lines(none, line_dedup.keep_bitmaps(none)).count() == 0


def test_bitmaps_are_sparse(spark):
    lines = [f"a line of its own, number {i}" for i in range(1000)]
    again = lines.copy()
    again[700] = "another line that only this one holds"
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(f"fresh text of line {i}" if i != 700 else lines[700] for i in range(1000))), (3, "\n".join(again))], "doc_id long, text string")
    maps = {r.doc_id: [(e.word, e.bits) for e in r.words] for r in line_dedup.keep_bitmaps(docs).collect()}
    assert maps[2] == [(700 // 64, ~(1 << 700 % 64))]
    assert set(maps) == {2, 3} and len(maps[3]) == 16


def test_line_dedup_has_no_python_stage(odd):
    plan = line_dedup.drop_lines(odd, line_dedup.keep_bitmaps(odd))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.fixture(scope="module")
def aligner():
    return token_alignment.Aligner(*token_alignment.default_paths())


def plain_alignment(aligner, text):
    """Counts, written groups and links by walking both lists; the byte-level side through its own library."""
    if not text:
        return None
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(aligner.a_bytes[i] for i in a) != whole or b"".join(aligner.b_bytes[i] for i in b) != whole:
        return None
    a_ends, b_ends = np.cumsum([len(aligner.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(aligner.b_bytes[i]) for i in b]).tolist()
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        k, m = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        links.append((a[k - 1], b[m - 1]))
        i, j = k, m
    return len(a), len(b), ";".join(groups), links


def plain_table(aligner, rows):
    found = [(doc, plain_alignment(aligner, text)) for doc, text in rows]
    counts = Counter(x for _, f in found if f for x in f[3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = Counter()
    for doc, f in found:
        if f is None:
            out[doc, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        n_a, n_b, written, links = f
        n_best = sum(counts[x] == best[x[1]] for x in links)
        out[doc, n_a, n_b, written.count(";") + 1, len(links), n_best, sum(counts[x] for x in links), hashlib.sha256(written.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block_pairs", [token_alignment.BLOCK_PAIRS, 20])
def test_alignment(aligner, odd, none, block_pairs):
    got = token_alignment.align_tokenizers(odd, block_pairs=block_pairs)
    assert Counter(map(tuple, got.collect())) == plain_table(aligner, [(r.doc_id, r.text) for r in odd.collect()])
    assert token_alignment.align_tokenizers(none).count() == 0


def test_alignment_of_the_table(spark, aligner):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, QUERIES["op12_token_alignment"](spark, FOLDER).collect())) == plain_table(aligner, docs)


def test_parts_and_ranks_change_nothing(aligner):
    rng = random.Random(5)
    marks = ["a", "A", "bc", " ", "  ", " d", "é", "\n", "\t", "'s", "ll", "0", "12", ".", "漢", "а", "😀", "\x85", "\x1c", "▁", "ﬁ", "\xa0", "　", "<s>", "<|endoftext|>", "\x00", "the ", " of", "ing", "̈"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    small = token_alignment.Aligner(*token_alignment.default_paths())
    small.parts = lambda text, size=5: token_alignment.Aligner.parts(small, text, size)
    for way in (aligner, small):
        for text, got in zip(texts, way.align(texts)):
            want = plain_alignment(aligner, text)
            assert (got and (got[0], got[1], got[3], got[4].tolist())) == (want and (*want[:3], [a * token_alignment.B_IDS + b for a, b in want[3]])), text


def test_group_labels():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 60)
        a, b = (np.array(sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n - 1))})) for _ in range(2))
        last = token_alignment.groups_of(a, b)
        shared = np.intersect1d(a, b)
        want = len(a) + np.searchsorted(b, shared[np.searchsorted(shared, np.concatenate([a, b]))])
        assert last.tolist() == want.tolist()


def plain_search(docs, items, top=10):
    find = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
    bags = [(doc, find(text)) for doc, text in docs]
    bags = [(doc, len(t), Counter(t)) for doc, t in bags if t]
    total, terms = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for *_, bag in bags for t in bag)
    wanted = defaultdict(Counter)
    for item, text in items:
        wanted[item] += Counter(find(text))
    out = Counter()
    for item, times in wanted.items():
        scores = []
        for doc, n, bag in bags:
            m = 100 - 75 + (75 * n * total) // terms
            score = sum(k * floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t, k in times.items() if bag[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out.update((item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top]))
    return out


@pytest.mark.parametrize("block_terms", [lexical_search.BLOCK_TERMS, 5])
def test_lexical_search(spark, odd, none, block_terms):
    items = [(1, "Wort1 wort2, WORT3 wort3 été"), (2, None), (3, ""), (4, "nothing of this is there"), (None, "漢字漢字 x_y y"), (5, "line documents"), (5, "line stands"), (6, "Wort1 wort2, WORT3 wort3 été"), (-7, "ten chars")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, item long")
    got = lexical_search.search(odd, table, block_terms=block_terms)
    assert Counter(map(tuple, got.collect())) == plain_search([(r.doc_id, r.text) for r in odd.collect()], items)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert lexical_search.search(none, table).count() == 0
    assert lexical_search.search(odd, table.where("false")).count() == 0


def test_classes_of_many_copies(spark):
    """Copies, and texts that tie with them in other words, come back by ascending id."""
    docs = [(i, "alpha beta" if i % 3 else "beta alpha") for i in range(200, 100, -1)] + [(50, "alpha gamma gamma"), (7, "delta"), (8, "alpha, beta")]
    items = [(1, "alpha beta"), (2, "gamma delta")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, lexical_search.search(*frames).collect())) == plain_search(docs, items)
    assert [r.doc_id for r in lexical_search.search(*frames).where("item_id = 1").orderBy("rank").collect()][:3] == [8, 101, 102]
