"""Byte-level BPE from a rank file, with the tokenizers library: encoding, offsets and decoding.

A rank file lists byte strings; two neighbours merge when their concatenation
is listed, lowest rank first.  The library wants characters and pairs, so the
256 bytes are written as 256 printable characters and every split of a token
into two tokens becomes a merge of that token's rank.

Cases: null and empty texts have no ids; equal rows are encoded one by one;
decoding an id that the file lacks raises.  Bytes of one character may be
spread over tokens: the bytes decode exactly, and :func:`text_pieces` holds an
unfinished character back until its last byte has come.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.text import small_batches, tidy, utf8_views, worker_object
from gridspark.llm.token_count import Pieces


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def build_tokenizer(ranks: dict[bytes, int], pattern: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    as_char = byte_characters()

    def written(token: bytes) -> str:
        return "".join(as_char[b] for b in token)

    ordered = sorted(ranks, key=ranks.get)
    merges = [
        (written(token[:i]), written(token[i:]))
        for token in ordered
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    model = models.BPE(vocab={written(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer


class Table:
    """The byte string of each id of one rank file: all that decoding and offsets need."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.sizes = np.array([len(t) for t in self.table], np.int64)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def offsets(self, packed: bytes, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one behind its last, by counting character starts among the bytes."""
        edge = np.concatenate([[0], np.cumsum(self.sizes[np.frombuffer(packed, "<u4")])])
        begun = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        first = begun[np.minimum(edge[:-1] + 1, len(text))] - 1
        return first, begun[edge[1:]]


class Codec(Table):
    """Encoder and byte table of one rank file."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        super().__init__(ranks)
        self.tokenizer = build_tokenizer(ranks, pattern)
        self.pieces = Pieces(self._packed)

    def _packed(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(text))


def text_pieces(tokens: Iterable[bytes]) -> Iterator[str]:
    """The text of a run of tokens; an unfinished character waits for its other bytes, stray bytes become U+FFFD."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for token in tokens:
        yield decoder.decode(token)
    yield decoder.decode(b"", True)


def _codec(path: str | None, pattern: str | None) -> Codec:
    path, pattern = path or default_path(), pattern or default_pattern()
    return worker_object(f"codec-{path}-{pattern}", lambda: Codec(path, pattern))


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    offsets: bool = False,
    decoded: bool = False,
) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit); with ``offsets`` also ``starts`` and ``ends`` in characters,
    with ``decoded`` also the bytes that the ids decode to, in the same stage."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    schema = "doc_id long, n_tokens long, ids binary"
    if offsets:
        fields += [("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
        schema += ", starts array<long>, ends array<long>"
    if decoded:
        fields.append(("decoded", pa.binary()))
        schema += ", decoded binary"
    out = pa.schema(fields)

    def run(batches):
        codec = _codec(path, pattern)
        for batch in small_batches(batches, "text"):
            ids, spans = [], []
            for buf in utf8_views(batch.column("text")):
                packed = codec.encode(buf.tobytes().decode("utf-8", "replace"))
                ids.append(packed)
                if offsets:
                    spans.append([x.tolist() for x in codec.offsets(packed, buf)])
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if offsets:
                columns += [pa.array([s[k] for s in spans], pa.list_(pa.int64())) for k in (0, 1)]
            if decoded:
                columns.append(pa.array(map(codec.decode, ids), pa.binary()))
            yield pa.record_batch(columns, schema=out)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(tidy(run, "codec-"), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``, to ``doc_id, n_tokens, ids``."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches):
        # a worker of its own, beside the one that encodes: it needs no tokenizer
        file = path or default_path()
        table = worker_object(f"table-{file}", lambda: Table(read_ranks(file)))
        for batch in batches:
            decoded = [table.decode(x.as_py() or b"") for x in batch.column("ids")]
            yield pa.record_batch([*(batch.column(f.name) for f in list(out)[:3]), pa.array(decoded, pa.binary())], schema=out)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
