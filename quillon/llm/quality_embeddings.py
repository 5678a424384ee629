"""Quality classifier: learned hashed word and character n-gram vectors, averaged per document, softmax output.

Features of a text: each word (case kept), each pair of neighbouring words (a word said twice in a row is the same
feature whatever the word) and each run of ``GRAMS`` bytes inside a word with one blank on either side, hashed to
2**``BITS`` vectors of ``DIM`` numbers. A document's vector is the mean over all its features
with repeats; two softmax outputs follow. Numpy stochastic gradient descent fits both layers on at most
``per_class`` labelled rows of either class (the driver gets each one's feature counts, at most 2**``BITS`` a row).

As the output is linear in the mean, scoring adds one number for each feature. Every whole text is scored.

Defined cases: null and empty texts have no features and get the score of the output's bias; labels other than
0 and 1, or null, are not used; with labels of fewer than two classes every score is 0.5; rows with a null id
are scored; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from . import kernel, labelled
from .workspace import bound_batches, forget, settled, table

BITS = 14
DIM = 16
GRAMS = (3, 4)


def features(t: kernel.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte position, bucket) of the features, a kind at a time."""
    if not len(t.data):
        return
    shift = kernel.U64(64 - BITS)
    word, start, _, first = t.word_hashes()
    yield start, (word >> shift).astype(np.int64)
    pair = kernel.within(first, 2)
    twice = word[pair] == word[pair + 1]
    yield start[pair], np.where(twice, 0, (kernel.run_hash(kernel.prefix_sums(word), pair, pair + 2) >> shift).astype(np.int64))
    inside = kernel.WORDS[t.data]
    blanked = np.where(inside, t.data, np.uint8(32))
    sums = kernel.prefix_sums(kernel.SYMBOL[blanked])
    gaps = np.r_[0, np.cumsum(~inside)]
    row = np.repeat(np.arange(len(t), dtype=np.int32), np.diff(t.offsets))
    for n in GRAMS:
        p = np.arange(max(0, len(t.data) - n + 1))
        p = p[(gaps[p + n - 1] == gaps[p + 1]) & (row[p] == row[p + n - 1])]
        yield p, (kernel.run_hash(sums, p, p + n) >> shift).astype(np.int64)


def counts_of(t: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count), ordered."""
    keys = [(np.searchsorted(t.offsets, p, "right") - 1 << BITS) + b for p, b in features(t)]
    found, n = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_counts=True)
    return found >> BITS, found & (1 << BITS) - 1, n


@dataclass
class Classifier:
    """gain: for each bucket, how far a feature moves the difference of the two outputs."""

    gain: np.ndarray
    bias: float

    def logits(self, t: kernel.Texts) -> np.ndarray:
        total, n = np.zeros(len(t)), np.zeros(len(t))
        for p, bucket in features(t):
            at = np.searchsorted(p, t.offsets)
            run = np.r_[0.0, np.cumsum(self.gain[bucket])]
            total += run[at[1:]] - run[at[:-1]]
            n += np.diff(at)
        return self.bias + total / np.maximum(n, 1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.5, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, output weights and output biases from each row's (buckets, counts); softmax cross-entropy, SGD."""
    rng = np.random.default_rng(seed)
    vectors, out, bias = rng.uniform(-1, 1, (1 << BITS, DIM)) / DIM, np.zeros((DIM, 2)), np.zeros(2)
    out += rng.normal(0, 0.1, out.shape)
    weights = [n / n.sum() if len(n) else n.astype(float) for _, n in rows]
    for epoch in range(epochs):
        step, order = rate * (1 - epoch / epochs), rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            b, x = np.concatenate([rows[i][0] for i in docs]), np.concatenate([weights[i] for i in docs])
            doc = np.repeat(np.arange(len(docs)), [len(rows[i][0]) for i in docs])
            v = vectors[b]
            mean = np.stack([np.bincount(doc, v[:, k] * x, len(docs)) for k in range(DIM)], 1)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            p /= len(docs)
            back = p @ out.T
            out -= step * mean.T @ p
            bias -= step * p.sum(0)
            # A bucket is a small share of a document's mean; the step for vectors is scaled up by the vectors' number.
            for k in range(DIM):
                vectors[:, k] -= step * 64 * np.bincount(b, back[doc, k] * x, 1 << BITS)
    return vectors, out, bias


def train(documents: DataFrame, labels: DataFrame, held_out: Column, per_class: int = 2000) -> Classifier:
    bound_batches(documents.sparkSession)
    sample, counts = labelled.training_sample(documents, labels, "quality", held_out, per_class)
    sample = settled(sample, "quality-sample")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in kernel.texts(batch.column(1)):
                row, bucket, n = counts_of(t)
                at = np.searchsorted(row, np.arange(len(t) + 1))
                lists = [(bucket[at[i] : at[i + 1]].astype("<u4").tobytes(), n[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in range(len(t))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, len(t)), pa.array([x[0] for x in lists], pa.binary()), pa.array([x[1] for x in lists], pa.binary())], ["label", "buckets", "counts"])

    got = sorted((bytes(r["buckets"]), bytes(r["counts"]), int(r["label"])) for r in sample.mapInArrow(listed, "label int, buckets binary, counts binary").collect())
    forget(sample)
    y = np.array([x[2] for x in got], int)
    if len(set(y.tolist())) < 2:
        return Classifier(np.zeros(1 << BITS), 0.0)
    vectors, out, bias = fit([(np.frombuffer(x[0], "<u4").astype(np.int64), np.frombuffer(x[1], "<u4").astype(float)) for x in got], y)
    return Classifier(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]) + labelled.prior_shift(counts, y))


def score(documents: DataFrame, classifier: Classifier, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``documents``."""
    bound_batches(documents.sparkSession)
    return labelled.scored(documents, classifier.logits, held_out)


def op3_quality_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held_out = table(spark, sf_dir, "documents"), labelled.bucket_of(3) == 1
    return score(documents, train(documents, table(spark, sf_dir, "labels"), held_out), held_out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_quality_embeddings": op3_quality_embeddings}
