"""Language ID by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of ``WIDTH`` bytes; both directions of the network
run over a block of windows at a time, every position gets probabilities from
the two states at it, and a document's probabilities are the mean over its
positions.  The network is trained in numpy by backpropagation through time on
windows of a bounded sample (``PER_LANGUAGE`` documents per language).

Cases: null texts and texts without a letter are ``und`` with score 0; without
any language to learn all documents are.  Rows with null lang are not learned
from; repeated rows count one by one.  lang, source and id never enter a
prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.nets import Adam, byte_inputs, cut_windows, input_gradients, window_starts
from gridspark.llm.text import fold, share, unit_interval, utf8_views

WIDTH = 64
HIDDEN = 8
PAD = 256
BLOCK = 2048
PER_LANGUAGE = 400
STEPS = 160
TRAIN_WINDOWS = 192
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities ``(languages, width, windows)`` of every position of ``x`` (width, windows)."""
        states = _forward(self.weights, x)
        logits = np.matmul(self.weights["out"], states) + self.weights["bias"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.transpose(1, 0, 2)


def _new_weights(languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """The leading 2 is the direction; gates are reset, update and new value."""
    return {
        "in": rng.normal(0, 0.3, (2, 3 * HIDDEN, PAD + 1)).astype(np.float32),
        "rec": rng.normal(0, 0.35, (2, 3 * HIDDEN, HIDDEN)).astype(np.float32),
        "inner": np.zeros((2, HIDDEN, 1), np.float32),
        "out": rng.normal(0, 0.3, (languages, 2 * HIDDEN)).astype(np.float32),
        "bias": np.zeros(languages, np.float32),
    }


def _forward(w: dict[str, np.ndarray], x: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States ``(width, 2 * HIDDEN, windows)``; gates are tanh, halved and raised to lie between 0 and 1."""
    width, n = x.shape
    h = np.zeros((2, HIDDEN, n), np.float32)
    states = np.empty((width, 2, HIDDEN, n), np.float32)
    a, p = np.empty((2, 3 * HIDDEN, n), np.float32), np.empty((2, 3 * HIDDEN, n), np.float32)
    half = np.float32(0.5)
    for t in range(width):
        byte_inputs(w["in"], x, t, a)
        np.matmul(w["rec"], h, out=p)
        gates, q = a[:, : 2 * HIDDEN], p[:, 2 * HIDDEN :]
        gates += p[:, : 2 * HIDDEN]
        np.tanh(gates, out=gates)
        squashed = gates * half
        squashed += half
        q += w["inner"]
        new = squashed[:, :HIDDEN] * q
        new += a[:, 2 * HIDDEN :]
        np.tanh(new, out=new)
        if tape is not None:
            tape.append((h, gates.copy(), squashed, q.copy(), new))
        h = h - new
        h *= squashed[:, HIDDEN:]
        h += new
        states[t, 0] = h[0]
        states[width - 1 - t, 1] = h[1]
    return states.reshape(width, 2 * HIDDEN, n)


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, size: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean cross-entropy over all positions, back through both directions."""
    width, n = x.shape
    tape: list = []
    states = _forward(w, x, tape)
    logits = np.matmul(w["out"], states) + w["bias"][:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    p[:, y, np.arange(n)] -= 1
    p *= (np.arange(width)[:, None] < size)[:, None, :] / size.sum()
    p = p.astype(np.float32)
    grads = {"out": np.einsum("tkn,thn->kh", p, states), "bias": p.sum(axis=(0, 2))}
    down = np.matmul(w["out"].T, p).reshape(width, 2, HIDDEN, n)
    rec, inner = np.zeros_like(w["rec"]), np.zeros_like(w["inner"])
    table = np.zeros((2, PAD + 1, 3 * HIDDEN), np.float32)
    dh = np.zeros((2, HIDDEN, n), np.float32)
    for t in range(width - 1, -1, -1):
        dh[0] += down[t, 0]
        dh[1] += down[width - 1 - t, 1]
        h, gates, squashed, q, new = tape[t]
        r, z = squashed[:, :HIDDEN], squashed[:, HIDDEN:]
        d_new = dh * (1 - z) * (1 - new * new)
        d_gate = np.concatenate([d_new * q, dh * (h - new)], axis=1) * 0.5 * (1 - gates * gates)
        d_p = np.concatenate([d_gate, d_new * r], axis=1)
        inner += d_p[:, 2 * HIDDEN :].sum(axis=2, keepdims=True)
        rec += d_p @ h.transpose(0, 2, 1)
        input_gradients(table, x, t, np.concatenate([d_gate, d_new], axis=1))
        dh = dh * z + w["rec"].transpose(0, 2, 1) @ d_p
    return grads | {"rec": rec, "inner": inner, "in": table.transpose(0, 2, 1)}


def train(texts: list[bytes], langs: list[str], steps: int = STEPS, seed: int = 7) -> Network | None:
    """A network from labelled texts, or None without labels."""
    if not texts:
        return None
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    weights = _new_weights(len(languages), rng)
    net = Network(languages, weights)
    y = np.array([languages.index(x) for x in langs])
    lengths = np.array([len(t) for t in texts])
    edges = np.concatenate([[0], np.cumsum(lengths)])
    symbols = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    text, start = window_starts(lengths, WIDTH, WIDTH)
    if len(text) == 0 or len(languages) == 1:
        return net
    # every language is drawn equally often
    chance = 1 / np.bincount(y[text], minlength=len(languages))[y[text]]
    chance /= chance.sum()
    adam = Adam(weights, 0.03)
    for step in range(steps):
        adam.rate = 0.03 * (1 - step / steps) + 0.002
        pick = rng.choice(len(text), TRAIN_WINDOWS, p=chance)
        x, size = cut_windows(symbols, edges, text[pick], start[pick], WIDTH, PAD)
        adam.update(_gradients(weights, x, size, y[text[pick]]))
    return net


def learn(docs: DataFrame, held_out_fold: int = 2, folds: int = 4, per_language: int = PER_LANGUAGE, excerpt: int = 512) -> Network | None:
    """Trains on about ``per_language`` documents of each language outside the held-out fold, one excerpt of each."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held_out_fold))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    u = unit_interval(F.col("doc_id"), "lang")
    room = F.greatest(F.length("text") - excerpt, F.lit(0)) + 1
    part = F.substring("text", (F.floor(unit_interval(F.col("doc_id"), "part") * room) + 1).cast("int"), F.lit(excerpt))
    sample = known.where(u <= share[F.col("lang")]).select("lang", part.alias("part"))
    # repeated or null ids share one draw: the bound holds for each language on its own
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("part"))
    rows = sample.withColumn("nth", nth).where(F.col("nth") <= 2 * per_language).orderBy("lang", "part").collect()
    return train([r["part"].encode() for r in rows], [r["lang"] for r in rows])


def _pooled(net: Network, views: list[np.ndarray]) -> np.ndarray:
    """Mean probabilities over the positions of each text."""
    lengths = np.array([len(v) for v in views], np.int64)
    total = np.zeros((len(views), len(net.languages)))
    if lengths.sum() == 0:
        return total
    edges = np.concatenate([[0], np.cumsum(lengths)])
    symbols = np.concatenate(views)
    text, start = window_starts(lengths, WIDTH, WIDTH)
    for a in range(0, len(text), BLOCK):
        part = slice(a, a + BLOCK)
        x, size = cut_windows(symbols, edges, text[part], start[part], WIDTH, PAD)
        p = net.label(x)
        if size.min() < WIDTH:
            p = p * (np.arange(WIDTH)[:, None] < size)
        np.add.at(total, text[part], p.sum(axis=1).T)
    return total / np.maximum(lengths, 1)[:, None]


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row."""
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = share(docs.sparkSession, net)

    def run(batches):
        model = shared()
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                views = list(utf8_views(batch.column("text")))
                langs, scores = [UNKNOWN] * len(views), [0.0] * len(views)
                if model is not None:
                    pooled = _pooled(model, views)
                    best = pooled.argmax(axis=1)
                    for i, view in enumerate(views):
                        if any(map(str.isalpha, view.tobytes().decode("utf-8", "replace"))):
                            langs[i], scores[i] = model.languages[best[i]], min(1.0, float(pooled[i, best[i]]))
                yield pa.record_batch([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=out)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")
