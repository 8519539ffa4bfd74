"""Personal data by fixed patterns and a bidirectional LSTM with CRF transitions over characters.

The patterns give the base spans.  The network is trained in numpy on windows of
a bounded sample (``MAX_TRAIN`` documents) whose base spans are the labels, and
tags every character of every text: overlapping windows are decoded with the
CRF, each character keeps the tag of the window in which it lies farther from
the edge, and runs of one tag are joined across windows.  Runs that overlap no
base span and look like their kind are added to the base spans.

Decoding runs only where it can change anything: when the tag "none" leads at
every position by more than twice what any transition can gain, the best path
is "none" throughout, and the window is done.

Cases: null texts count as empty and have no spans; equal rows are tagged one
by one; offsets are code points.  Without any labelled span the network adds none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridspark.llm.nets import Adam, byte_inputs, cut_windows, input_gradients, window_starts
from gridspark.llm.text import share, small_batches, tidy, unit_interval

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + len(KINDS)
WIDTH, OVERLAP = 288, 32
HIDDEN = 5
OTHER, PAD = 128, 129
BLOCK = 512
DOUBTFUL = 512
BATCH_ROWS, BATCH_BYTES = 500, 1 << 20
MAX_TRAIN = 3000
STEPS = 200
TRAIN_WIDTH, TRAIN_WINDOWS = 96, 96

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGITS_AND_DOTS = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: What a run must look like to be added: its alphabet, and how many digits.
LOOKS = {
    "email": re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+"),
    "ip": re.compile(r"[0-9]+([.:][0-9]+)+"),
    "card": re.compile(r"[0-9][0-9 .-]+[0-9]"),
    "phone": re.compile(r"[+(]?[0-9][0-9 ().-]+[0-9]"),
}
MOST = {"email": (0, 99), "ip": (4, 17), "card": (13, 19), "phone": (8, 15)}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; anchored at each @, so that long runs without one cost nothing."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def ips(text: str) -> list[tuple[int, int, list[str]]]:
    """Four numbers joined by single dots, leftmost first; each run of digits and dots is read once."""
    found = []
    for run in DIGITS_AND_DOTS.finditer(text):
        numbers = run.group().split(".")
        at, i = run.start(), 0
        while i + 3 < len(numbers):
            four = numbers[i : i + 4]
            if all(four):
                end = at + sum(map(len, four)) + 3
                found.append((at, end, four))
                at, i = end + 1, i + 4
            else:
                at, i = at + len(numbers[i]) + 1, i + 1
    return found


def base_spans(text: str) -> list[Span]:
    """The pattern's spans by kind, then start."""
    spans: list[Span] = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return spans
    spans += [("ip", a, b) for a, b, parts in ips(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def characters(text: str) -> np.ndarray:
    """One symbol per code point: ASCII as it is, one symbol for all others."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), OTHER).astype(np.uint8)


def _new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    """The leading 2 is the direction; gates are input, forget and output, then the new value."""
    table = rng.normal(0, 0.3, (2, 4 * HIDDEN, PAD + 1)).astype(np.float32)
    table[:, HIDDEN : 2 * HIDDEN] += 0.5  # remember at first
    return {
        "in": table,
        "rec": rng.normal(0, 0.35, (2, 4 * HIDDEN, HIDDEN)).astype(np.float32),
        "out": rng.normal(0, 0.3, (TAGS, 2 * HIDDEN)).astype(np.float32),
        "bias": np.zeros(TAGS, np.float32),
        "step": np.zeros((TAGS, TAGS), np.float32),
    }


def _forward(w: dict[str, np.ndarray], x: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States ``(width, 2 * HIDDEN, windows)``; gates are tanh, raised and halved to lie between 0 and 1."""
    width, n = x.shape
    h, c = np.zeros((2, HIDDEN, n), np.float32), np.zeros((2, HIDDEN, n), np.float32)
    states = np.empty((width, 2, HIDDEN, n), np.float32)
    a, p = np.empty((2, 4 * HIDDEN, n), np.float32), np.empty((2, 4 * HIDDEN, n), np.float32)
    one, half = np.float32(1), np.float32(0.5)
    for t in range(width):
        byte_inputs(w["in"], x, t, a)
        np.matmul(w["rec"], h, out=p)
        a += p
        np.tanh(a, out=a)
        raised = a[:, : 3 * HIDDEN] + one
        before = c
        c = raised[:, HIDDEN : 2 * HIDDEN] * c
        c += raised[:, :HIDDEN] * a[:, 3 * HIDDEN :]
        c *= half
        squashed = np.tanh(c)
        if tape is not None:
            tape.append((h, before, a.copy(), raised * half, squashed))
        h = raised[:, 2 * HIDDEN :] * squashed
        h *= half
        states[t, 0] = h[0]
        states[width - 1 - t, 1] = h[1]
    return states.reshape(width, 2 * HIDDEN, n)


def _emissions(w: dict[str, np.ndarray], states: np.ndarray) -> np.ndarray:
    return np.matmul(w["out"], states) + w["bias"][:, None]


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


def _crf_gradients(e: np.ndarray, step: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean negative log-likelihood of tags ``y`` by emissions ``e`` (width, tags, windows) and transitions."""
    width, _, n = e.shape
    live = np.arange(width)[:, None] < size
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, width):
        new = _log_sum(alpha[t - 1][:, None] + step[:, :, None], 0) + e[t]
        alpha[t] = np.where(live[t], new, alpha[t - 1])
    total = _log_sum(alpha[-1], 0)
    for t in range(width - 2, -1, -1):
        new = _log_sum(step[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
        beta[t] = np.where(live[t + 1], new, beta[t + 1])
    at = np.arange(n)
    d_e = np.zeros_like(e)
    d_step = np.zeros_like(step)
    for t in range(width):
        d_e[t] = np.exp(alpha[t] + beta[t] - total) * live[t]
        d_e[t][y[t], at] -= live[t]
        if t:
            pair = np.exp(alpha[t - 1][:, None] + step[:, :, None] + (e[t] + beta[t])[None] - total) * live[t]
            d_step += pair.sum(axis=2)
            np.add.at(d_step, (y[t - 1], y[t]), -live[t].astype(np.float32))
    scale = np.float32(1 / n)
    return d_e * scale, d_step * scale


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    width, n = x.shape
    tape: list = []
    states = _forward(w, x, tape)
    d_e, d_step = _crf_gradients(_emissions(w, states), w["step"], y, size)
    grads = {"step": d_step, "out": np.einsum("tkn,thn->kh", d_e, states), "bias": d_e.sum(axis=(0, 2))}
    down = np.matmul(w["out"].T, d_e).reshape(width, 2, HIDDEN, n)
    rec = np.zeros_like(w["rec"])
    table = np.zeros((2, PAD + 1, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((2, HIDDEN, n), np.float32), np.zeros((2, HIDDEN, n), np.float32)
    for t in range(width - 1, -1, -1):
        dh[0] += down[t, 0]
        dh[1] += down[width - 1 - t, 1]
        h, before, a, gates, squashed = tape[t]
        i, f, o, g = *np.split(gates, 3, axis=1), a[:, 3 * HIDDEN :]
        dc = dc + dh * o * (1 - squashed * squashed)
        d_gates = np.concatenate([dc * g, dc * before, dh * squashed], axis=1) * 0.5 * (1 - a[:, : 3 * HIDDEN] ** 2)
        d_a = np.concatenate([d_gates, dc * i * (1 - g * g)], axis=1)
        rec += d_a @ h.transpose(0, 2, 1)
        input_gradients(table, x, t, d_a)
        dc = dc * f
        dh = w["rec"].transpose(0, 2, 1) @ d_a
    return grads | {"rec": rec, "in": table.transpose(0, 2, 1)}


def viterbi(e: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best tags ``(width, windows)`` for emissions ``(width, tags, windows)``."""
    width, _, n = e.shape
    score = e[0]
    back = np.empty((width, TAGS, n), np.int8)
    for t in range(1, width):
        options = score[:, None] + step[:, :, None]
        back[t] = options.argmax(axis=0)
        score = options.max(axis=0) + e[t]
    tags = np.empty((width, n), np.int8)
    tags[-1] = score.argmax(axis=0)
    at = np.arange(n)
    for t in range(width - 1, 0, -1):
        tags[t - 1] = back[t][tags[t], at]
    return tags


@dataclass
class Tagger:
    weights: dict[str, np.ndarray]

    def doubtful(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows whose best path may hold another tag than 0, and their emissions."""
        e = _emissions(self.weights, _forward(self.weights, x))
        step = self.weights["step"]
        gain = 2 * max(0.0, float((step - step[0, 0]).max()))
        lead = (e[:, 0] - e[:, 1:].max(axis=1)).min(axis=0)
        found = np.flatnonzero(lead <= gain)
        return found, e[:, :, found]


def windows_with(tags: np.ndarray, tag: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers of the windows ``low`` to ``high`` that hold the tag; the windows themselves are never laid out."""
    at = np.flatnonzero(tags == tag)
    return np.flatnonzero(np.searchsorted(at, low) < np.searchsorted(at, high))


def train(texts: list[str], steps: int = STEPS, seed: int = 5) -> Tagger | None:
    """A tagger from texts labelled by their base spans; None if no text has one."""
    symbols = [characters(t) for t in texts]
    lengths = np.array([len(s) for s in symbols], np.int64)
    tags = [np.zeros(n, np.int8) for n in lengths]
    for text, marks in zip(texts, tags):
        for kind, a, b in base_spans(text):
            marks[a:b] = 1 + KINDS.index(kind)
    if not any(m.any() for m in tags):
        return None
    edges = np.concatenate([[0], np.cumsum(lengths)])
    flat, flat_tags = np.concatenate(symbols), np.concatenate(tags)
    text, start = window_starts(lengths, TRAIN_WIDTH, TRAIN_WIDTH // 2)
    # half of the windows hold a span, every kind equally often; the others are drawn from all
    low = edges[text] + start
    high = low + np.minimum(TRAIN_WIDTH, lengths[text] - start)
    by_kind = [windows_with(flat_tags, k, low, high) for k in range(1, TAGS)]
    by_kind = [k for k in by_kind if len(k)]
    rng = np.random.default_rng(seed)
    weights = _new_weights(rng)
    adam = Adam(weights)
    for step in range(steps):
        adam.rate = 0.03 * (1 - step / steps) + 0.002
        share = TRAIN_WINDOWS // (2 * len(by_kind))
        pick = np.concatenate([*(rng.choice(k, share) for k in by_kind), rng.choice(len(text), TRAIN_WINDOWS // 2)])
        x, size = cut_windows(flat, edges, text[pick], start[pick], TRAIN_WIDTH, PAD)
        y, _ = cut_windows(flat_tags, edges, text[pick], start[pick], TRAIN_WIDTH, 0)
        adam.update(_gradients(weights, x, y, size))
    return Tagger(weights)


def learn(docs: DataFrame, max_train: int = MAX_TRAIN, excerpt: int = 4000) -> Tagger | None:
    """Trains on excerpts of at most ``max_train`` documents, five in six of them with a digit or an @."""
    rows = docs.where(F.col("text").isNotNull())
    order = unit_interval(F.col("doc_id"), "pii")
    room = F.greatest(F.length("text") - excerpt, F.lit(0)) + 1
    part = F.substring("text", (F.floor(unit_interval(F.col("doc_id"), "part") * room) + 1).cast("int"), F.lit(excerpt))
    parts = rows.select(order.alias("u"), part.alias("part"))
    likely = parts.where(F.col("part").rlike("[0-9@]")).orderBy("u", "part").limit(max_train * 5 // 6)
    plain = parts.orderBy("u", "part").limit(max_train // 6)
    return train([r["part"] for r in likely.union(plain).collect()])


def _runs(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Tag, start and end of each run of one tag other than 0."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
    return [(int(tags[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:]) if tags[a]]


def tag_texts(tagger: Tagger, texts: list[str]) -> list[np.ndarray | None]:
    """The tag of every character of every text; None where all are 0."""
    symbols = [characters(t) for t in texts]
    lengths = np.array([len(s) for s in symbols], np.int64)
    found: list[np.ndarray | None] = [None] * len(texts)
    if lengths.sum() == 0:
        return found
    edges = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate(symbols)
    text, start = window_starts(lengths, WIDTH, WIDTH - OVERLAP)
    # windows of like length together, so that little is padded
    size = np.minimum(WIDTH, lengths[text] - start)
    order = np.argsort(-size, kind="stable")
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def decode() -> None:
        if not waiting:
            return
        e = np.zeros((WIDTH, TAGS, sum(len(k) for k, _ in waiting)), np.float32)
        at = 0
        for windows, part in waiting:
            e[: len(part), :, at : at + len(windows)] = part
            at += len(windows)
        tags = viterbi(e, tagger.weights["step"])
        for column, k in enumerate(np.concatenate([windows for windows, _ in waiting])):
            doc, first, n = int(text[k]), int(start[k]), int(size[k])
            # of an overlap, the window that is farther from its edge decides
            low = OVERLAP // 2 if first else 0
            high = n if first + n == lengths[doc] else n - OVERLAP // 2
            if tags[low:high, column].any():
                if found[doc] is None:
                    found[doc] = np.zeros(lengths[doc], np.int8)
                found[doc][first + low : first + high] = tags[low:high, column]
        waiting.clear()

    for a in range(0, len(order), BLOCK):
        part = order[a : a + BLOCK]
        x, _ = cut_windows(flat, edges, text[part], start[part], int(size[part[0]]), PAD)
        some, e = tagger.doubtful(x)
        if len(some):
            waiting.append((part[some], e))
        if sum(len(k) for k, _ in waiting) >= DOUBTFUL:
            decode()
    decode()
    return found


def added_spans(text: str, tags: np.ndarray | None, base: list[Span]) -> list[Span]:
    """Runs of tags that overlap no base span, trimmed of white space, with what their kind cannot lack."""
    if tags is None:
        return []
    taken = sorted((a, b) for _, a, b in base)
    found = []
    for tag, a, b in _runs(tags):
        kind = KINDS[tag - 1]
        piece = text[a:b]
        a, b = a + len(piece) - len(piece.lstrip()), b - (len(piece) - len(piece.rstrip()))
        piece = text[a:b]
        digits = len(NOT_DIGIT.sub("", piece))
        within = (a and text[a - 1].isalnum()) or text[b : b + 1].isalnum()  # a piece of a longer word
        likely = not within and LOOKS[kind].fullmatch(piece) and MOST[kind][0] <= digits <= MOST[kind][1]
        if likely and not any(x < b and a < y for x, y in taken):
            found.append((kind, a, b))
    return found


def find_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text, by kind and start."""
    tags = tag_texts(tagger, texts) if tagger is not None else [None] * len(texts)
    out = []
    for text, marks in zip(texts, tags):
        base = base_spans(text)
        both = base + added_spans(text, marks, base)
        out.append((base, sorted(both, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def tag_documents(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base), ``base_spans`` and ``spans`` (kind:start:end, comma-joined)."""
    counts = [(f"n_{k}", pa.int64()) for k in KINDS]
    out = pa.schema([("doc_id", pa.int64()), *counts, ("base_spans", pa.string()), ("spans", pa.string())])
    shared = share(docs.sparkSession, tagger)

    def run(batches):
        model = shared()
        for batch in small_batches(batches, "text", BATCH_ROWS, BATCH_BYTES):
            found = find_spans(model, [t or "" for t in batch.column("text").to_pylist()])
            numbers = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            names = [pa.array([written(s[i]) for s in found], pa.string()) for i in (0, 1)]
            yield pa.record_batch([batch.column("doc_id"), *numbers, *names], schema=out)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string"
    return texts.mapInArrow(tidy(run), schema)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text_col`` masked; all other columns as they are, null texts stay null."""
    shared = share(docs.sparkSession, tagger)
    place = docs.columns.index(text_col)
    fields = [StructField(f.name, StringType() if f.name == text_col else f.dataType, True) for f in docs.schema.fields]

    def run(batches):
        model = shared()
        for batch in small_batches(batches, place, BATCH_ROWS, BATCH_BYTES):
            texts = batch.column(place).to_pylist()
            found = find_spans(model, [t or "" for t in texts])
            masked = [None if t is None else mask(t, every) for t, (_, every) in zip(texts, found)]
            columns = list(batch.columns)
            columns[place] = pa.array(masked, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(tidy(run), StructType(fields))
