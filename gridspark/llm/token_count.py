"""Token counts with a file of the tokenizers library; huge documents by overlap resynchronisation.

A pre-token never runs from a non-space into a white-space character, so a
boundary before a space that follows a non-space is a boundary of the whole
encoding, whatever stands around it.  Two things rest on that:

* An ordinary text is cut at those places and each distinct piece is encoded
  once per worker (bounded memory).
* A huge text is encoded in overlapping chunks with offsets.  Two neighbours
  are spliced at a common boundary of that kind, behind which both encodings
  go on with the same tokens; when they have none, the overlap is doubled.

Cases: null and empty texts have 0 bytes and 0 tokens; rows with equal ids are
counted one by one; only id and text are read.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.text import worker_object

HUGE = 50_000
CHUNK = 16_384
OVERLAP = 512
AGREE = 3
KEPT_PIECES = 200_000
KEPT_CHARS = 8 << 20

WHITE = r"\t-\r\x1c- \x85\xa0  -     　"
#: A space behind a character that no definition counts as white space.
CUT = re.compile(f" (?<![{WHITE}] )")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces:
    """What ``encode`` gives for pieces between proven boundaries, each computed once while there is room."""

    def __init__(self, encode):
        self.encode, self.first, self.later = encode, {}, {}
        self.chars = 0

    def _fill(self, kept: dict, pieces: list[str], lead: str) -> None:
        if len(kept) > KEPT_PIECES or self.chars > KEPT_CHARS:
            self.first.clear()
            self.later.clear()
            self.chars = 0
        self.chars += sum(map(len, pieces))
        kept.update(zip(pieces, self.encode([lead + p for p in pieces])))

    def __call__(self, text: str) -> list:
        head, *rest = CUT.split(text)
        if head not in self.first:
            self._fill(self.first, [head], "")
        out = [self.first[head]]
        if len(rest) == 0:
            return out
        distinct = set(rest)
        fresh = distinct.difference(self.later)
        if fresh:
            if len(self.later) > KEPT_PIECES or self.chars > KEPT_CHARS:
                fresh = distinct  # all are needed again once the others are forgotten
            self._fill(self.later, list(fresh), " ")
        out += map(self.later.__getitem__, rest)
        return out


def _splice(text: str, left, left_at: int, right, right_at: int, end: int) -> int | None:
    """The first proven boundary in the overlap behind which both encodings agree."""
    left_from = {left_at + s: i for i, (s, _) in reversed(list(enumerate(left.offsets)))}
    right_from = {right_at + s: i for i, (s, _) in reversed(list(enumerate(right.offsets)))}
    for m in CUT.finditer(text, right_at + 1, end):
        b = m.start()
        if b in left_from and b in right_from and b > right_at:
            i, j = left_from[b], right_from[b]
            if left.ids[i : i + AGREE] == right.ids[j : j + AGREE] and len(left.ids) >= i + AGREE:
                return b
    return None


def encode_huge(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a text, encoded in overlapping chunks; ``encode`` gives ids and offsets."""
    ids: list[int] = []
    at, begin = 0, 0
    left = encode(text[:chunk])
    end = min(chunk, len(text))
    while end < len(text):
        wide = overlap
        while True:
            start = max(at, end - wide)
            # the overlap has eaten the chunk, or holds no boundary however wide: encode it together with the next one
            if start == at or not CUT.search(text, at + 1, end):
                end = min(len(text), end + max(chunk, end - at))  # doubled, so that all tries together cost twice the last
                left, joined = encode(text[at:end]), True
                break
            right = encode(text[start : start + chunk + wide])
            b = _splice(text, left, at, right, start, end)
            if b is not None:
                joined = False
                break
            wide *= 2
        if joined:
            continue
        ids += [x for x, (s, _) in zip(left.ids, left.offsets) if begin <= at + s < b]
        left, at, begin, end = right, start, b, min(len(text), start + chunk + wide)
    ids += [x for x, (s, _) in zip(left.ids, left.offsets) if at + s >= begin]
    return ids


def _counter(path: str):
    tokenizer = load_tokenizer(path)

    def lengths(texts):
        return [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return tokenizer, Pieces(lengths)


def _special_strings(path: str) -> list[str]:
    return [t.content for t in load_tokenizer(path).get_added_tokens_decoder().values()]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, huge: int = HUGE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` per row; ``path`` names the tokenizer file on every executor."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        where = path or default_path()
        tokenizer, pieces = worker_object(f"counter-{where}", lambda: _counter(where))
        special = worker_object(f"special-{where}", lambda: _special_strings(where))

        def encode(text):
            return tokenizer.encode(text, add_special_tokens=False)

        for batch in batches:
            sizes, counts = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                if any(s in text for s in special):
                    counts.append(len(encode(text)))  # added tokens are matched before the text is split
                elif len(text) > huge:
                    counts.append(len(encode_huge(encode, text)))
                else:
                    counts.append(sum(pieces(text)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], schema=out)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
