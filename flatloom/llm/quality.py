"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of up to 64 words. A passage is encoded by the shares of hashed
word features (the shape of a word, its punctuation, the lowered word, whether the document
said it before) and a learned layer. Gated attention weighs the passages of a document; the
weighted sum is scored. All weights are learned from document labels alone.

Learning uses at most `SAMPLE` labelled documents, those with the smallest hashes of their ids
and texts of at most `SAMPLE_BYTES` bytes: a bounded sample, encoded and fitted in one task.
Scoring covers every passage of every document.

Edge cases: a document without words has one empty passage. Null labels and labels without a
document are ignored; of several labels of a document the mean decides, ties are good. Without
labels every score is 0.5. A null id has the remainder of the empty string and may be scored but
has no label. Repeated rows are scored each. Columns other than the named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import SPACED, Words, mix, word_slices

SAMPLE = 4000
SAMPLE_BYTES = 1 << 17
PASSAGE = 64
#: Features: shapes, punctuation, said before, hashed words.
SHAPES, MARKS, WORDS = 96, 64, 352
SIZE = SHAPES + MARKS + 2 + WORDS
HIDDEN, GATE = 24, 12
EPOCHS, RATE, DECAY = 60, 0.01, 1e-4

_U = np.uint64


def _kinds() -> np.ndarray:
    """Of each byte: 0 small letter or other text, 1 capital, 2 digit, 3 punctuation."""
    kinds = np.full(256, 3, dtype=np.int8)
    kinds[97:123] = 0
    kinds[128:] = 0
    kinds[65:91] = 1
    kinds[48:58] = 2
    return kinds


def _per_word(values: np.ndarray, w: Words) -> np.ndarray:
    """Sums of a per-byte array over each word."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[w.end] - total[w.start]


def passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(features, first passage of each text): a row of SIZE shares for each passage."""
    kinds = _kinds()[w.data]
    length = w.end - w.start
    capitals, digits, marks = (_per_word(kinds == k, w) for k in (1, 2, 3))
    # Case pairs of two-byte letters: C3 80-9E are capitals.
    two = np.zeros(len(w.data), dtype=bool)
    two[1:] = (w.data[:-1] == 0xC3) & (w.data[1:] >= 0x80) & (w.data[1:] <= 0x9E)
    capitals = capitals + _per_word(two, w)
    letters = np.maximum(length - digits - marks, 1)
    case = np.where(capitals == 0, 0, np.where(2 * capitals <= letters, 1, 2))
    shape = ((case * 4 + np.minimum(marks, 3)) * 2 + (digits > 0)) * 4 + np.digitize(length, [4, 8, 14])
    code = np.where(kinds == 3, w.data.astype(np.int64) * 31 + 7, 0)
    mark = np.where(marks > 0, _per_word(code, w) % (MARKS - 1) + 1, 0)
    row = w.row
    seen = mix(w.hash + row.astype(_U) * _U(0x9E3779B97F4A7C15))
    first = np.zeros(len(seen), dtype=bool)
    first[np.unique(seen, return_index=True)[1]] = True
    hashed = (w.hash % _U(WORDS)).astype(np.int64)

    counts = np.maximum(-(-np.diff(w.first) // PASSAGE), 1)
    begin = np.concatenate([[0], np.cumsum(counts)])
    place = begin[row] + (np.arange(len(row)) - w.first[row]) // PASSAGE
    n = int(begin[-1])
    out = np.zeros((n, SIZE), dtype=np.float32)
    base = 0
    for feature, size in ((shape, SHAPES), (mark, MARKS), (first.astype(np.int64), 2), (hashed, WORDS)):
        cells = np.bincount(place * size + feature, minlength=n * size).reshape(n, size)
        out[:, base : base + size] = cells
        base += size
    words = np.maximum(out[:, :SHAPES].sum(axis=1, keepdims=True), 1)
    return np.sqrt(out / words), begin


class Model:
    """Gated attention over encoded passages; `parts` are the weight arrays."""

    shapes = ((SIZE, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE, 1), (HIDDEN, 1), (1,))

    def __init__(self, parts: list[np.ndarray]) -> None:
        self.parts = parts

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        random = np.random.default_rng(seed)
        return cls([(random.standard_normal(s) / np.sqrt(max(s[0], 1)) if len(s) > 1 else np.zeros(s)).astype(np.float32) for s in cls.shapes])

    @classmethod
    def load(cls, data: bytes) -> Model:
        flat, parts = np.frombuffer(data, np.float32), []
        for s in cls.shapes:
            n = int(np.prod(s))
            parts.append(flat[:n].reshape(s))
            flat = flat[n:]
        return cls(parts)

    def dump(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float32).tobytes()

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        encode, shift, tanh, gate, weigh, score, bias = self.parts
        heads, bag = begin[:-1], np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        h = np.tanh(x @ encode + shift)
        t, g = np.tanh(h @ tanh), 1 / (1 + np.exp(-(h @ gate)))
        raw = (t * g @ weigh)[:, 0]
        raw = np.exp(raw - np.maximum.reduceat(raw, heads)[bag])
        a = raw / np.add.reduceat(raw, heads)[bag]
        z = np.add.reduceat(h * a[:, None], heads, axis=0)
        p = 1 / (1 + np.exp(-(z @ score)[:, 0] - bias[0]))
        return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p}

    def gradients(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        encode, shift, tanh, gate, weigh, score, bias = self.parts
        f = self.forward(x, begin)
        bag, h, t, g, a = (f[k] for k in ("bag", "h", "t", "g", "a"))
        ds = ((f["p"] - y) / len(y)).astype(np.float32)
        dz = ds[:, None] @ score.T
        da = (h * dz[bag]).sum(axis=1)
        draw = a * (da - np.add.reduceat(a * da, begin[:-1])[bag])
        dtg = draw[:, None] @ weigh.T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (dz[bag] * a[:, None] + dt @ tanh.T + dg @ gate.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ draw[:, None], f["z"].T @ ds[:, None], ds.sum(keepdims=True)]


def fit(x: np.ndarray, begin: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 256, seed: int = 7) -> Model:
    """Adam over batches of whole documents."""
    model, random = Model.fresh(seed), np.random.default_rng(seed)
    share = np.clip(y.mean(), 0.01, 0.99)
    model.parts[-1][:] = np.log(share / (1 - share))
    mean, square, step = [0.0] * 7, [0.0] * 7, 0
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(y), batch):
            docs = order[at : at + batch]
            sizes = np.diff(begin)[docs]
            own = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.repeat(begin[docs] - own[:-1], sizes) + np.arange(own[-1])
            step += 1
            for i, g in enumerate(model.gradients(x[rows], own, y[docs])):
                g = g + DECAY * model.parts[i] * (model.parts[i].ndim > 1)
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                model.parts[i] = (model.parts[i] - rate * mean[i] / (np.sqrt(square[i]) + 1e-8)).astype(np.float32)
    return model


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> bytes | None:
    """Weights fitted on a bounded sample of (doc_id, quality); None without labels."""
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    # Twice the sample: some ids may have no document or too long a text.
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    text = F.col("text").cast("string")
    docs = documents.select("doc_id", text.alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
    rows = docs.join(F.broadcast(marked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, sizes, ys = [], [], []
        for batch in batches:
            for w in word_slices(batch.column(0), SPACED):
                x, begin = passages(w)
                xs.append(x)
                sizes.append(np.diff(begin))
            ys.append(batch.column(1).to_numpy() >= 0.5)
        if ys:
            sizes, y = np.concatenate(sizes), np.concatenate(ys).astype(np.float32)
            model = fit(np.concatenate(xs), np.concatenate([[0], np.cumsum(sizes)]), y)
            yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], names=["weights"])

    found = rows.select("text", "quality").coalesce(1).mapInArrow(train, "weights binary").first()
    return bytes(found.weights) if found else None


def quality_score(weights: bytes | None, text: Column) -> Column:
    """The score of each text, from 0 to 1."""
    if weights is None:
        return F.lit(0.5)

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model.load(weights)
        for column in columns:
            found = [np.zeros(0)]
            for w in word_slices(column, SPACED):
                found.append(model.forward(*passages(w))["p"].astype(np.float64))
            yield pa.array(np.concatenate(found))

    # The annotations are read as types, which this module keeps as text.
    score.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")(text.cast("string"))
