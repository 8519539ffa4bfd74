"""How the tokens of two tokenizers line up: groups between shared token ends, and how often each pair of ids ends together.

Both encodings of a text are taken as byte ranges over the same bytes, a space and the text.  A token points to the token
of the other side that overlaps it and reaches farthest to the right, or to itself when nothing reaches farther.
Doubling these successors, for all tokens of a batch at once, leads every token to the last one of its group.

Neither tokenizer joins a non-space with the space behind it (the byte-level pattern never matches across such a place,
and no piece of the other vocabulary holds a space behind another character, which is checked).  Such places are token
ends on both sides, whatever stands around them, so long texts are encoded in parts that are cut there.

The id pairs are counted over the whole corpus without sending them text by text: rows are blocks of documents, and
a block counts each pair once.  Pair counts are joined back per block, and a block looks its own pairs up.

Cases: a null or empty text, and one whose tokens do not give back its bytes, has zeros and an empty digest.  Rows with
equal or null ids are aligned one by one; each counts.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.text import worker_object
from gridspark.llm.token_count import WHITE, load_tokenizer
from gridspark.session import cut_lineage

PART = 1 << 16  # characters of a long text that are encoded at once
TOGETHER = 1 << 20  # characters of the texts that are aligned at once
BLOCK_PAIRS = 1 << 21  # (document, pair) entries after which a block ends
B_IDS = 1 << 16

#: A space behind a character that no definition counts as white space.
CUT = re.compile(f"(?<=[^{WHITE}]) ")

COLUMNS = "n_a long, n_b long, n_groups long, n_links long"


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The last token of each token's group: tokens of A first, then those of B, given their increasing ends.

    The ranges of either side lie one behind the other from 0.  At equal ends the token of B is the last one.
    """
    n = len(a_ends)
    if not n or not len(b_ends):
        return np.arange(n + len(b_ends))
    # the farthest token of the other side that starts before this one ends
    far_b = np.searchsorted(np.concatenate([[0], b_ends[:-1]]), a_ends, side="left") - 1
    far_a = np.searchsorted(np.concatenate([[0], a_ends[:-1]]), b_ends, side="left") - 1
    here = np.arange(n + len(b_ends))
    after = np.concatenate([
        np.where(b_ends[far_b] >= a_ends, n + far_b, here[:n]),
        np.where(a_ends[far_a] > b_ends, far_a, here[n:]),
    ])
    while True:
        twice = after[after]
        if np.array_equal(twice, after):
            return after
        after = twice


def _byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next one from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _bytes_a(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table, alphabet = {}, _byte_alphabet()
    for entry, i in spec["model"]["vocab"].items():
        table[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
    for extra in spec.get("added_tokens", ()):
        table[extra["id"]] = extra["content"].encode()
    return [table.get(i, b"") for i in range(max(table) + 1)]


def _bytes_b(model) -> list[bytes]:
    def one(i: int) -> bytes:
        if model.is_byte(i):
            return bytes([int(model.id_to_piece(i)[3:-1], 16)])
        return model.id_to_piece(i).replace("▁", " ").encode()

    return [one(i) for i in range(model.get_piece_size())]


def _ranked(path: str):
    """The encoder of tiktoken for a byte-level file whose ids are the order of its merges; None for any other file.

    Both libraries then give the same ids (the tests compare them); this one is several times as fast.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
    vocab = model["vocab"]
    first = len(vocab) - len(merges)
    plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or first != 256 or any(vocab.get(a + b) != first + i for i, (a, b) in enumerate(merges)):
        return None
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in entry): i for entry, i in vocab.items()}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the alignment of a list of texts."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.ranked = _ranked(a_path)
        self.a = load_tokenizer(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = _bytes_a(a_path), _bytes_b(self.b)
        self.a_size, self.b_size = (np.array([len(t) for t in table]) for table in (self.a_bytes, self.b_bytes))
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        self.cuts = self.ranked is not None and not any("▁" in p.lstrip("▁") for p in pieces)
        ids = max(len(self.a_bytes), len(self.b_bytes))
        self.names = np.array([[f"{i}{mark}" for i in range(ids)] for mark in ",|;\n"], dtype=object)

    def encode_a(self, text: str) -> list[int]:
        if self.ranked is not None:
            return self.ranked.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def parts(self, text: str, size: int = PART) -> list[str]:
        """A long text in parts of about ``size`` characters, cut at ends of tokens on both sides; the space at a cut is left out."""
        out, at = [], 0
        while self.cuts and len(text) - at > size:
            cut = CUT.search(text, at + size, len(text) - 1)  # a space at the very end stays with its part
            if cut is None:
                break
            out.append(text[at : cut.start()])
            at = cut.end()
        out.append(text[at:])
        return out

    def encoded(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a space and the text on both sides, if they give back its bytes."""
        a: list[int] = []
        b: list[int] = []
        for part in self.parts(text):
            whole = (" " + part).encode()
            ids, others = self.encode_a(" " + part), self.b.encode(part)
            for found, table in ((ids, self.a_bytes), (others, self.b_bytes)):
                if b"".join(map(table.__getitem__, found)) != whole:
                    return None
            a += ids
            b += others
        return a, b

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray] | None]:
        """Per text its numbers of tokens and groups, its groups as written, and its linked id pairs; None without tokens."""
        coded = [self.encoded(t) if t else None for t in texts]
        present = [c for c in coded if c is not None]
        if not present:
            return coded
        a, b = (np.fromiter(chain.from_iterable(c[side] for c in present), np.int64) for side in (0, 1))
        a_upto, b_upto = (np.cumsum([len(c[side]) for c in present]) for side in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        last = groups_of(a_ends, b_ends)
        # groups follow one another on both sides, so where the label changes a new group begins
        a_group, b_group = (np.cumsum(np.diff(x, prepend=x[0]) != 0) for x in (last[: len(a)], last[len(a) :]))
        place = np.concatenate([a_group * 2, b_group * 2 + 1])
        order = np.argsort(place, kind="stable")
        step = np.diff(place[order], append=-1)
        mark = np.where(step == 0, 0, np.where((step == 1) & (place[order] % 2 == 0), 1, 2))
        mark[a_upto + b_upto - 1] = 3
        written = "".join(self.names[mark, np.concatenate([a, b])[order]].tolist()).split("\n")
        _, in_a, in_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        pairs = a[in_a] * B_IDS + b[in_b]
        link_upto = np.searchsorted(in_a, a_upto, side="left")
        groups = np.diff(a_group[a_upto - 1] + 1, prepend=0)
        links = np.split(pairs, link_upto[:-1])
        found = iter([(len(c[0]), len(c[1]), int(g), w, p) for c, g, w, p in zip(present, groups, written, links)])
        return [None if c is None else next(found) for c in coded]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_ROW = pa.schema([("block", pa.int64()), *_DOC, ("n_pairs", pa.int64()), ("packed", pa.binary()), ("pairs", pa.binary()), ("times", pa.binary())])
_ROW_SQL = f"block long, doc_id long, {COLUMNS}, groups_sha256 string, n_pairs long, packed binary, pairs binary, times binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


class _Block:
    """Documents in a row whose pairs are numbered together, so that a document's pairs take a byte or two each."""

    def __init__(self, number: int):
        self.number, self.docs, self.held = number, [], 0

    def add(self, doc, found) -> None:
        if found is None:
            self.docs.append(((doc, 0, 0, 0, 0, ""), None, None))
            return
        n_a, n_b, n_groups, written, links = found
        pairs, times = np.unique(links, return_counts=True)
        digest = hashlib.sha256(written.encode()).hexdigest()
        self.docs.append(((doc, n_a, n_b, n_groups, len(links), digest), pairs, times))
        self.held += len(pairs)

    def closed(self):
        """The rows of the documents, and one row (``doc_id`` and counts null) with the block's pairs and how often it has each."""
        some = [d for d in self.docs if d[1] is not None]
        pairs, at = np.unique(np.concatenate([p for _, p, _ in some] or [np.empty(0, np.int64)]), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate([t for *_, t in some] or [np.empty(0)]), minlength=len(pairs)).astype("<i8")
        rows, done = [], 0
        for row, own, n in self.docs:
            packed, size = b"", 0
            if own is not None:
                size = len(own)
                steps = np.diff(at[done : done + size], prepend=0).astype("<u4")
                packed = pa.compress(steps.tobytes() + n.astype("<u4").tobytes(), "zstd", asbytes=True)
                done += size
            rows.append((self.number, *row, size, packed, None, None))
            if len(rows) == 512:
                yield _rows(rows)
                rows = []
        rows.append((self.number, *[None] * len(_DOC), None, None, pairs.astype("<i8").tobytes(), times.tobytes()))
        yield _rows(rows)


def _aligned(docs: DataFrame, id_col: str, text_col: str, a_path: str | None, b_path: str | None, block_pairs: int) -> DataFrame:
    """One row per document with its distinct pairs, and one per block of documents with the block's."""

    def run(batches):
        paths = (a_path, b_path) if a_path and b_path else default_paths()
        aligner = worker_object(f"aligner-{paths}", lambda: Aligner(*paths))
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            at = 0
            while at < len(ids):
                some, size = [], 0
                while at + len(some) < len(ids) and size < TOGETHER:
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                for doc, found in zip(ids[at : at + len(some)], aligner.align(some)):
                    block.add(doc, found)
                at += len(some)
                if block.held >= block_pairs:
                    yield from block.closed()
                    block = _Block(block.number + 1)
        if block.docs:
            yield from block.closed()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, _ROW_SQL)


def _unpacked(blocks: DataFrame) -> DataFrame:
    """``block, pair, n`` for every distinct pair of a block."""

    def run(batches):
        for batch in batches:
            for block, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "times"))):
                n = len(pairs) // 8
                arrays = [pa.array(np.full(n, block)), pa.array(np.frombuffer(pairs, "<i8")), pa.array(np.frombuffer(times, "<i8"))]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "pair", "n"])

    return blocks.select("block", "pairs", "times").mapInArrow(run, "block long, pair long, n long")


def _looked_up(rows, counts):
    """Each document of a block against the corpus-wide counts of the block's pairs, which are numbered in order."""
    import pyarrow.compute as pc

    counts = counts.take(pc.sort_indices(counts.column("pair")))
    n, best = (counts.column(c).to_numpy() for c in ("n", "best"))
    n_best, count_sum = [], []
    for size, packed in zip(rows.column("n_pairs").to_pylist(), rows.column("packed").to_pylist()):
        raw = np.frombuffer(pa.decompress(packed, 8 * size, "zstd", asbytes=True), "<u4").astype(np.int64)
        at, times = np.cumsum(raw[:size]), raw[size:]
        n_best.append(int(times[n[at] == best[at]].sum()))
        count_sum.append(int((times * n[at]).sum()))
    kept = rows.select([name for name, _ in _DOC])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, n, best``: links that hold the id pair (A's id * 65536 + B's id), and the most that any pair of that B id has."""
    counts = cut_lineage(blocks.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.col("pair") % B_IDS
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("best"))
    return counts.withColumn("b_id", b_id).join(F.broadcast(most), "b_id").select("pair", "n", "best")  # at most 2^16 rows


def align_tokenizers(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    a_path: str | None = None,
    b_path: str | None = None,
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """Per document: ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and the digest of its groups.

    ``a_path`` names a byte-level file of the tokenizers library, ``b_path`` a sentencepiece model, on every executor.
    """
    aligned = cut_lineage(_aligned(docs, id_col, text_col, a_path, b_path, block_pairs), "aligned")
    blocks = cut_lineage(_unpacked(aligned.where("pairs is not null")), "block-pairs")
    found = blocks.select("block", "pair").join(pair_counts(blocks), "pair")
    rows = aligned.where("n_a > 0")
    schema = f"doc_id long, {COLUMNS}, groups_sha256 string, n_best long, count_sum long"
    counted = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_looked_up, schema)
    zeros = aligned.where("n_a = 0").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return counted.select(order).union(zeros.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}).select(order))
