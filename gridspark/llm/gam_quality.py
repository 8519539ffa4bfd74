"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins.  Cyclic boosting visits the features in turn and
adds a shallow tree over one feature's bins to that feature's lookup table; then
the pairs with the largest gain get tables of their own in the same way.  A
score is a sum of table entries, so a batch is scored by one addition per table.

The labels are learned from a bounded sample (``MAX_TRAIN`` labelled documents,
those with the smallest hash of their id); only that sample's features reach
the driver.  Scoring reads every document once and shuffles nothing.

Cases: null and empty texts have features of zero length and a score like any
other; labels other than 0 and 1 and null ids are not learned from; repeated
labels and documents count once per row.  Without labels of both kinds the
score is the share of label 1 (0.5 with none).  Columns of the input that are
named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridspark.llm.text import SPACE, fold, repeated_words, share, tidy, unit_interval, utf8_views, word_hashes, word_spans

MAX_TRAIN = 20_000
BINS = 48
PAIR_BINS = 8
ROUNDS = 200
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.1
DEPTH = 2
CUTOFF = 0.3

FEATURES = (
    "log_words",
    "word_length",
    "word_length_spread",
    "distinct_share",
    "repeat_share",
    "adjacent_repeat_share",
    "top_word_share",
    "upper_share",
    "digit_share",
    "symbol_share",
    "exclamation_share",
    "bar_share",
    "stop_share",
    "white_share",
    "non_ascii_share",
    "log_line_words",
    "repeated_line_share",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _mask(bytes(range(65, 91)))
_LETTER = _UPPER | _mask(bytes(range(97, 123)))
_DIGIT = _mask(b"0123456789")
_SYMBOL = _mask(b"#*$%&<>@^~=+_\\/{}[]")
_EXCLAIM, _BAR, _STOP = _mask(b"!?"), _mask(b"|"), _mask(b".,;:")


def features(buf: np.ndarray) -> np.ndarray:
    """The feature vector of one text, in the order of ``FEATURES``."""
    out = np.zeros(len(FEATURES))
    if len(buf) == 0:
        return out
    counts = np.bincount(buf, minlength=256)
    starts, ends = word_spans(buf)
    n, size = len(starts), len(buf)
    lines = [x for x in buf.tobytes().split(b"\n") if not x.isspace() and x]
    out[0] = np.log1p(n)
    if n:
        length = ends - starts
        words = word_hashes(buf, starts, ends, fold_case=True)
        _, times = np.unique(words, return_counts=True)
        out[1], out[2] = length.mean(), length.std()
        out[3], out[4] = len(times) / n, repeated_words(words) / n
        out[5] = np.count_nonzero(words[1:] == words[:-1]) / n
        out[6] = times.max() / n
    out[7] = counts[_UPPER].sum() / max(1, counts[_LETTER].sum())
    for k, mask in ((8, _DIGIT), (9, _SYMBOL), (10, _EXCLAIM), (11, _BAR), (12, _STOP), (13, SPACE)):
        out[k] = counts[mask].sum() / size
    out[14] = counts[128:].sum() / size
    out[15] = np.log1p(n / max(1, len(lines)))
    out[16] = 1 - len(set(lines)) / max(1, len(lines))
    return out


@dataclass
class Model:
    """Lookup tables: one per feature, one per pair of features."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            i = np.searchsorted(self.coarse[a], x[:, a], side="right")
            total += table[i * PAIR_BINS + np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, penalty: float = 1.0) -> np.ndarray:
    """Leaf value per bin of a tree of at most ``depth`` splits in a row over ordered bins."""
    value = np.full(len(g), g.sum() / (h.sum() + penalty))
    if depth == 0 or len(g) < 2:
        return value
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty)
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= g.sum() ** 2 / (h.sum() + penalty) + 1e-9:
        return value
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1, penalty), _tree(g[cut:], h[cut:], depth - 1, penalty)])


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Four leaves over two features: the best cut of the first, then one of the second on each side; with its gain."""
    g, h = g.reshape(PAIR_BINS, PAIR_BINS), h.reshape(PAIR_BINS, PAIR_BINS)
    best, found = -1.0, None
    for cut in range(1, PAIR_BINS):
        out = np.empty_like(g)
        gain = 0.0
        for part in (slice(0, cut), slice(cut, PAIR_BINS)):
            leaf = _tree(g[part].sum(0), h[part].sum(0), 1, penalty)
            out[part] = leaf
            gain += float((leaf * g[part].sum(0)).sum())
        if gain > best:
            best, found = gain, out
    return found.ravel(), best


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits the tables to features ``x`` and labels ``y`` (0 or 1)."""
    width = len(FEATURES)
    share = float(y.mean()) if len(y) else 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    none = [np.empty(0)] * width
    if len(y) == 0 or y.min() == y.max():
        return Model(base, none, [np.zeros(1)] * width, none, [], [])
    edges = [_edges(x[:, k], BINS) for k in range(width)]
    bins = [np.searchsorted(edges[k], x[:, k], side="right") for k in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)

    def sums(at, size):
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(ROUNDS):
        for k in range(width):
            step = RATE * _tree(*sums(bins[k], len(tables[k])), DEPTH)
            tables[k] += step
            total += step[bins[k]]
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(width)]
    cell = [np.searchsorted(coarse[k], x[:, k], side="right") for k in range(width)]
    everything = [(a, b) for a in range(width) for b in range(a + 1, width)]
    joint = {(a, b): cell[a] * PAIR_BINS + cell[b] for a, b in everything}
    size = PAIR_BINS * PAIR_BINS
    pairs = sorted(everything, key=lambda ab: -_pair_tree(*sums(joint[ab], size))[1])[:PAIRS]
    pair_tables = [np.zeros(size) for _ in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, ab in enumerate(pairs):
            step = RATE * _pair_tree(*sums(joint[ab], size))[0]
            pair_tables[k] += step
            total += step[joint[ab]]
    return Model(base, edges, tables, coarse, pairs, pair_tables)


def _matrix(column) -> np.ndarray:
    rows = [features(buf) for buf in utf8_views(column)]
    return np.array(rows).reshape(len(rows), len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, held_out_fold: int | None = 0, folds: int = 5, max_train: int = MAX_TRAIN) -> Model:
    """A model from at most ``max_train`` labelled documents whose id is not in the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if held_out_fold is not None:
        known = known.where(fold("doc_id", folds) != held_out_fold)
    order = unit_interval(F.col("doc_id"), "gam")
    chosen = known.orderBy(order, "doc_id", "quality").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("text"))
            packed = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), packed], ["doc_id", "quality", "x"])

    rows = sample.mapInArrow(tidy(run), "doc_id long, quality int, x array<double>")
    # repeated documents may make the sample longer than the labels: the bound holds for it as well
    rows = rows.orderBy("doc_id", "quality", "x").limit(2 * max_train).toPandas()
    if rows.empty:
        return train(np.empty((0, len(FEATURES))), np.empty(0))
    return train(np.stack(rows["x"].to_list()), rows["quality"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as column ``out``."""
    docs = docs.drop(out)
    shared = share(docs.sparkSession, model)
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def run(batches):
        kept = shared()
        for batch in batches:
            found = kept.score(_matrix(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(tidy(run), schema)
