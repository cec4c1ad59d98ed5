"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (512 bytes each, the whole text). Every passage
is encoded from its byte and hashed byte-pair frequencies and its share of repeated words by a
learned layer.
Gated attention gives each passage a weight within its document, and a logistic
unit scores the weighted sum; only document labels train all of it.

Scale: training takes a bounded sample of labelled rows (``MAX_TRAIN_DOCS``
rows of at most ``MAX_TRAIN_BYTES``, those with the smallest hash of their id, and one
text for an id) to the driver; the model has about 26,000 numbers. Scoring is one pass without
a shuffle that holds ``CHUNK_BYTES`` of text, or one longer text in slices.

Nulls and empty texts: scored as one passage without bytes. Null labels or ids
aren't learned from. With no usable labels, or one class only, every score is
that class's share (0.5 without labels). Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import byte_buffer, hash_sample, text_batches, word_hashes, word_spans

PASSAGE = 512
PAIR_BUCKETS = 512
COUNTS = 256 + PAIR_BUCKETS
FEATURES = COUNTS + 4
HIDDEN, GATE = 32, 16
MAX_TRAIN_DOCS = 3000
MAX_TRAIN_BYTES = 1 << 15  # so the driver gets 96 MB of text at most
STEPS, RATE, DECAY, SEED = 160, 0.02, 1e-4, 7
THRESHOLD = 0.3
SLICE = 2048  # passages that are encoded at once
TRAIN_CHUNK = 1 << 20  # bytes of text that training encodes at once


def held_out(doc_id: Column) -> Column:
    """Rows no label is learned from: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the start of each passage (plus the end), and each document's first passage (plus the end)."""
    data, starts = byte_buffer(texts)
    sizes = np.diff(starts)
    count = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], count)
    return data, np.append(np.repeat(starts[:-1], count) + place * PASSAGE, len(data)), first


def repeated_words(data: np.ndarray, cuts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each passage, the share of the words starting in it that equal the word before."""
    begin, end, _ = word_spans(data, cuts[first])
    word = word_hashes(data, begin, end)
    same = np.zeros(len(word))
    same[1:] = word[1:] == word[:-1]
    of = np.searchsorted(cuts[1:], begin, side="right")
    n = len(cuts) - 1
    return np.bincount(of, same, minlength=n)[:n] / np.maximum(np.bincount(of, minlength=n)[:n], 1)


def encode(data: np.ndarray, cuts: np.ndarray, again: np.ndarray) -> np.ndarray:
    """A row for each passage: square roots of byte and hashed byte-pair shares, how concentrated
    either is (high where few words recur), the length, and the share of repeated words."""
    n = len(cuts) - 1
    data = data[cuts[0]:cuts[-1]].astype(np.int32)
    size = np.diff(cuts)
    of = np.repeat(np.arange(n, dtype=np.int32) * COUNTS, size)
    out = np.bincount(of + data, minlength=n * COUNTS)
    pair = (data[:-1] * 167 + data[1:] * 59) % PAIR_BUCKETS + 256
    inside = of[1:] == of[:-1]
    out += np.bincount((of[1:] + pair)[inside], minlength=n * COUNTS)
    share = out.reshape(n, COUNTS).astype(np.float32) / np.maximum(size, 1)[:, None].astype(np.float32)
    x = np.empty((n, FEATURES), np.float32)
    np.sqrt(share, out=x[:, :COUNTS])
    share *= share
    x[:, COUNTS] = np.log(share[:, :256].sum(1) + 1e-3)
    x[:, COUNTS + 1] = np.log(share[:, 256:].sum(1) + 1e-3)
    x[:, COUNTS + 2] = np.log1p(size) / 6
    x[:, COUNTS + 3] = again
    return x


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the output unit; ``base`` if nothing was learned."""
    weights: list[np.ndarray]
    base: float | None = None

    def parts(self, x: np.ndarray):
        w, b, v, u, a, _, _ = self.weights
        h = np.tanh(x @ w + b)
        left, gate = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        return h, left, gate, (left * gate) @ a

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text."""
        if self.base is not None:
            return np.full(len(texts), self.base)
        data, cuts, first = passages(texts)
        again = repeated_words(data, cuts, first)
        h, e = np.empty((len(cuts) - 1, HIDDEN), np.float32), np.empty(len(cuts) - 1, np.float32)
        for at in range(0, len(h), SLICE):
            end = min(at + SLICE, len(h))
            h[at:end], _, _, e[at:end] = self.parts(encode(data, cuts[at:end + 1], again[at:end]))
        bags, _ = pool(h, e, first)
        return 1 / (1 + np.exp(-(bags @ self.weights[5] + self.weights[6][0]).astype(np.float64)))


def pool(h: np.ndarray, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention-weighted sum of the passages of each document, and the weights."""
    count = np.diff(first)
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), count))
    a /= np.repeat(np.add.reduceat(a, first[:-1]), count)
    return np.add.reduceat(h * a[:, None], first[:-1]), a


def fit(texts: pa.Array, labels: np.ndarray, steps: int = STEPS) -> Model:
    """Weights by full-batch Adam from zero-mean random ones of a fixed seed."""
    labels = labels.astype(np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model([], float(labels.mean()) if len(labels) else 0.5)
    x, first = encode_all(texts)
    rng = np.random.default_rng(SEED)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    base = np.log(labels.mean() / (1 - labels.mean()))
    model = Model([draw(FEATURES, HIDDEN) * 3, np.zeros(HIDDEN, np.float32), draw(HIDDEN, GATE), draw(HIDDEN, GATE),
                   draw(GATE), draw(HIDDEN), np.full(1, base, np.float32)])
    mean, square = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
    for step in range(1, steps + 1):
        grads = gradients(model, x, first, labels)
        for i, g in enumerate(grads):
            g = g + DECAY * model.weights[i]
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            model.weights[i] = (model.weights[i] - RATE * mean[i] / (1 - 0.9 ** step)
                                / (np.sqrt(square[i] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


def gradients(model: Model, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy of the documents, for each weight."""
    _, _, v, u, a, c, d = model.weights
    count = np.diff(first)
    h, left, gate, e = model.parts(x)
    z, weight = pool(h, e, first)
    y = 1 / (1 + np.exp(-(z @ c + d[0])))
    dy = (y - labels) / len(labels)
    dz = np.repeat(dy[:, None] * c[None, :], count, axis=0)
    da = (dz * h).sum(1)
    de = weight * (da - np.repeat(np.add.reduceat(weight * da, first[:-1]), count))
    dm = de[:, None] * a[None, :]
    dl, dg = dm * gate * (1 - left * left), dm * left * gate * (1 - gate)
    dp = (weight[:, None] * dz + dl @ v.T + dg @ u.T) * (1 - h * h)
    return [x.T @ dp, dp.sum(0), h.T @ dl, h.T @ dg, (left * gate).T @ de, z.T @ dy, np.array([dy.sum()], x.dtype)]


def encode_all(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All passages' features and each document's first passage, plus the end; a few texts at a time."""
    size = np.asarray(pc.binary_length(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-size // PASSAGE)))])
    x, at = np.empty((first[-1], FEATURES), np.float32), 0
    for batch in text_batches(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), 0, TRAIN_CHUNK):
        data, cuts, own = passages(batch.column(0))
        x[at:at + own[-1]] = encode(data, cuts, repeated_words(data, cuts, own))
        at += own[-1]
    return x, first


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAIN_DOCS,
          max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """Model learned from the labelled rows that aren't held out, from ``limit`` of them at most."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = hash_sample(usable.select("doc_id", F.col(label).alias("label")), limit, "doc_id", "label").limit(limit)
    found = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
             .where(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "doc_id"))  # at most ``limit`` ids
    rows = found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["text"]))
    return fit(pa.array([r["text"] for r in rows], pa.string()), np.array([r["label"] for r in rows], np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(
                np.round(shared.value.score(batch.column(1)), 6))], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that the model doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, at):
            yield batch.filter(pa.array(np.round(shared.value.score(batch.column(at)), 6) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
