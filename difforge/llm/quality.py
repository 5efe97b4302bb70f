"""Quality classifier on supervised subword embeddings.

Words, pairs of words and character n-grams are hashed to learned vectors; pairs of equal words share one vector, as a word that
is said twice means much the same for quality whichever it is (without it 45 of 195 held-out bad documents pass at
scale 0.1, with it none). They are averaged over the whole document,
and a softmax over the average decides. Training is minibatch gradient descent in numpy on the driver, over a
sample of at most PER_CLASS documents of each label: the ones whose id hashes lowest. As the output is linear in
the average, scoring needs one number for each bucket, and every executor gets that table of BUCKETS floats.

Cases: null or empty text scores by the bias alone; a document labelled more than once counts with its lowest
label; with fewer than two labels in the sample every score is 0.5, predicted 1; rows that repeat are scored each;
an empty table gives an empty result; columns other than doc_id and text are ignored. The sample is put in order of label,
id and text before training, so that reruns and other partitionings give the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_crc, mix64, over_batches
from .text import chunks, word_hashes, word_spans

BUCKETS = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
GRAMS = (3, 5)
PER_CLASS = 1536
DIM, EPOCHS, LEAST_STEPS, BATCH, RATE = 8, 6, 300, 48, 300.0
#: The output layer learns at this part of the vectors' rate.
SLOWER = 0.002


def _features(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: its buckets in text order, and where each document's begin (one more entry)."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    starts, first = word_spans(data, offs)
    words = word_hashes(data, starts, fold=False)
    yield (words >> shift).astype(np.int32), first
    pairs = mix64(words[:-1] * _ODD + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)
    pairs >>= shift
    pairs[words[1:] == words[:-1]] = BUCKETS
    yield _inside(pairs, first, 2)
    # Characters are those of the text, not its bytes.
    tail = (data & 0xC0) == 0x80
    chars, at = data.astype(np.uint64), offs
    if tail.any():
        begin = np.flatnonzero(~tail)
        place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
        chars, at = np.add.reduceat(chars << (place * 8).astype(np.uint64), begin), np.searchsorted(begin, offs)
    for n in GRAMS:
        gram = np.full(max(len(chars) - n + 1, 0), n, np.uint64)
        for i in range(n):
            gram = gram * _ODD + chars[i : len(chars) - n + 1 + i] if len(gram) else gram
        yield _inside(gram * _ODD >> shift, at, n)


def _inside(gram: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of ``n`` units that lie in one document each, and where each document's begin; document d has units offs[d] to offs[d + 1]."""
    inside = np.ones(offs[-1] if len(offs) else 0, bool)
    for k in range(1, n):
        at = offs[1:] - k
        inside[at[at >= offs[:-1]]] = False
    size = np.maximum(np.diff(offs) - n + 1, 0)
    return gram.astype(np.int32)[inside[: len(gram)]], np.concatenate([[0], np.cumsum(size)])


@dataclass
class Model:
    """A score for each bucket and a bias; the probability of label 1 is the logistic of bias + mean score."""

    table: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for i, j, data, offs in chunks(column):
            total, n = np.zeros(j - i), np.zeros(j - i)
            for buckets, at in _features(data, offs):
                run = np.concatenate([[0.0], np.cumsum(self.table[buckets], dtype=np.float64)])
                total += run[at[1:]] - run[at[:-1]]
                n += np.diff(at)
            out[i:j] = self.bias + total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def _counts(batches):
    for b in batches:
        for i, j, data, offs in chunks(b.column(1)):
            parts = list(_features(data, offs))
            for d in range(i, j):
                own = np.concatenate([f[at[d - i] : at[d - i + 1]] for f, at in parts])
                bucket, n = np.unique(own, return_counts=True)
                # One number each, as the driver gets them all; counts over 15 bits, of huge texts, are halved together until they fit.
                n = np.maximum(n >> max(0, int(n.max(initial=1)).bit_length() - 15), 1)
                packed = (bucket.astype(np.uint32) << np.uint32(15) | n.astype(np.uint32)).view(np.int32)
                yield pa.record_batch({"label": b.column(0)[d : d + 1], "id": b.column(2)[d : d + 1], "mark": b.column(3)[d : d + 1], "counts": pa.array([packed], pa.list_(pa.int32()))})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """A model from the documents that ``labels`` (doc_id and ``label`` 0 or 1) names."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    sample = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    # Bounded: at most 2 * per_class ids.
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(sample), "_id")
    rows = rows.select("_label", "text", "_id", F.xxhash64("text").alias("_mark"))
    got = over_batches(rows, _counts, "label int, id long, mark long, counts array<int>").toArrow()
    y = got["label"].to_numpy()
    order = np.lexsort((got["mark"].to_numpy(), got["id"].to_numpy(), y)) if len(y) else np.zeros(0, np.int64)
    model = train([got["counts"][int(i)].values.to_numpy() for i in order], y[order])
    del got, rows
    pa.default_memory_pool().release_unused()
    return model


def train(docs_x: list[np.ndarray], y: np.ndarray) -> Model:
    """Minibatch gradient descent on the packed buckets and counts of each document."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS + 1, np.float32), 0.0)
    rng = np.random.default_rng(9)
    emb = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    each = np.array([len(y) / (2 * max(1, (y == v).sum())) for v in (0, 1)], np.float32)
    epoch = -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // epoch))
    steps, done = epochs * epoch, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            x = np.zeros((len(rows), BUCKETS + 1), np.float32)
            for k, i in enumerate(rows):
                packed = docs_x[i].view(np.uint32)
                if len(packed):
                    n = (packed & np.uint32(0x7FFF)).astype(np.float32)
                    x[k, packed >> np.uint32(15)] = n / n.sum()
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used]
            hidden = x @ emb[used]
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= each[y[rows]][:, None] / len(rows)
            rate = RATE * (1 - done / steps)
            emb[used] -= rate * (x.T @ (p @ out.T))
            out -= SLOWER * rate * (hidden.T @ p)
            bias -= SLOWER * rate * p.sum(axis=0)
            done += 1
    gap = out[:, 1] - out[:, 0]
    return Model((emb @ gap).astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, of label 1) of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "score": shared.value.scores(b.column(1))})

    return over_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose own score is at least ``least``, with all their columns, whatever their names."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(b.column(at).cast(pa.string())) >= least))

    return docs.mapInArrow(run, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out third are never learned from."""
    learn = labels.where(fold_crc(F.col("doc_id"), 3) != 1)
    out = score(docs, fit(docs, learn))
    return out.select("doc_id", (fold_crc(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
