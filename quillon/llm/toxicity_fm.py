"""Toxicity: a factorization machine over hashed terms.

A document's terms are its lower-case words (letters, digits and bytes beyond ASCII) and the first 4, 5 and 6
bytes of longer words, hashed to 2**``BITS`` buckets and taken once each. With weights w and vectors v of
``FACTORS`` numbers, the logit is w0 + sum(w_i) + c * sum over pairs i < j of <v_i, v_j>, so that a pair such as an
insult beside a group's name can count for more than both alone, or for all of it. c is one over the number of the text's
terms, so that the sum over pairs of a long text stays in proportion.

Training: at most ``per_class`` labelled rows of either class, with all their terms; none is screened out beforehand, since
the terms of a telling pair may each say nothing alone. The machine is fitted on the driver by numpy (AdaGrad) from each
sampled row's list of terms; rows are bounded by ``per_class`` whatever the input, but their texts are not, so the lists
come a partition at a time and lie in files of the driver: its memory holds the distinct terms and one batch of rows. A
penalty on the size of weights and vectors makes most of them zero while the model is learned. A fifth of the rows, when there are ``CALIBRATED`` or more, is
kept out to fit a slope and shift of the logit, since a penalised model is too careful. Scoring looks at every word of
every whole text.

Defined cases: null and empty texts have no terms and get the score of w0; labels other than 0 and 1, or null,
are not used; with no labelled rows, every score is 0.5's prior, sigmoid(0); rows with a null id are scored;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, labelled
from .workspace import bound_batches, table

BITS = 32
FACTORS = 8
PREFIXES = (4, 5, 6)
#: Rows from which on a fifth of them calibrates.
CALIBRATED = 200
#: Terms that the driver works on at once, and when it gathers distinct ones.
PIECE, LARGE = 1 << 16, 1 << 20


def terms(t: kernel.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the terms of a piece, once each, in order."""
    start, end, first = t.words(kernel.LETTERS)
    sums, row = t.sums(kernel.LOWER), kernel.rows_of(first)
    hashes, rows = [kernel.run_hash(sums, start, end)], [row]
    for n in PREFIXES:
        longer = end - start > n
        hashes.append(kernel.run_hash(sums, start[longer], start[longer] + n) + kernel.U64(n))
        rows.append(row[longer])
    both = np.unique(np.concatenate(rows).astype(np.uint64) << kernel.U64(BITS) | np.concatenate(hashes) >> kernel.U64(64 - BITS))
    return (both >> kernel.U64(BITS)).astype(np.int64), both & kernel.U64((1 << BITS) - 1)


@dataclass
class Machine:
    """buckets: sorted; weights and vectors in their order."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def __post_init__(self) -> None:
        self._maybe = np.zeros(1 << 16, bool)
        self._maybe[(self.buckets & kernel.U64(0xFFFF)).astype(np.int64)] = True

    def slots(self, t: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, slot) of the known terms, and the share of each row's pairs."""
        row, bucket = terms(t)
        share = 1 / np.maximum(np.bincount(row, minlength=len(t)), 1)
        if not len(self.buckets):
            return row[:0], row[:0], share
        near = self._maybe[(bucket & kernel.U64(0xFFFF)).astype(np.int64)]
        row, bucket = row[near], bucket[near]
        at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        hit = self.buckets[at] == bucket
        return row[hit], at[hit], share

    def logits(self, t: kernel.Texts) -> np.ndarray:
        return self.bias + summed(*self.slots(t), self.weights, self.vectors)


def summed(row: np.ndarray, slot: np.ndarray, share: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Weights and pairs of each row, added up."""
    v = vectors[slot]
    pairs = sum(np.bincount(row, v[:, k], len(share)) ** 2 - np.bincount(row, v[:, k] ** 2, len(share)) for k in range(v.shape[1]))
    return np.bincount(row, weights[slot], len(share)) + 0.5 * share * pairs


def fit(begin: np.ndarray, size_of: np.ndarray, slots: np.ndarray, labels: np.ndarray, n_slots: int, share: np.ndarray, factors: int = FACTORS, epochs: int = 30, batch: int = 64, rate: float = 0.1, sparse: float = 0.05, sparse_pairs: float = 0.02, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights from the terms of labelled rows: row i has ``size_of[i]`` slots from ``begin[i]`` on; share: of a row's pairs.

    Log-loss by AdaGrad, a rate a slot. After each step every weight is moved towards zero by ``sparse`` and every vector
    by ``sparse_pairs``, times its rate and over the root of the number of rows, and stays there when it gets there; a slot
    catches up with the steps that it was not in when it is next used.
    """
    sparse, sparse_pairs = sparse / np.sqrt(max(len(labels), 1)), sparse_pairs / np.sqrt(max(len(labels), 1))
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(n_slots), rng.normal(0, 0.1, (n_slots, factors))
    g0, gw, gv, seen, step = 1e-8, np.full(n_slots, 1e-6), np.full(n_slots, 1e-6), np.zeros(n_slots, np.int64), 0
    used, place = np.zeros(n_slots, bool), np.zeros(n_slots, np.int32)

    def shrink(u: np.ndarray) -> None:
        steps = step - seen[u]
        w[u] = np.sign(w[u]) * np.maximum(np.abs(w[u]) - rate / np.sqrt(gw[u]) * sparse * steps, 0)
        length = np.sqrt((v[u] ** 2).sum(1))
        v[u] *= (np.maximum(length - rate / np.sqrt(gv[u]) * sparse_pairs * steps, 0) / np.maximum(length, 1e-12))[:, None]
        seen[u] = step

    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            size = size_of[docs]
            doc = np.repeat(np.arange(len(docs)), size)
            own = np.concatenate([slots[begin[d] : begin[d] + size_of[d]] for d in docs.tolist()])
            used[own] = True
            u = np.flatnonzero(used)
            used[u] = False
            place[u] = np.arange(len(u))
            s = place[own]
            shrink(u)
            wu, vu, c = w[u], v[u], share[docs]
            total = np.stack([np.bincount(doc, vu[:, k][s], len(docs)) for k in range(factors)], 1)
            square = np.bincount(doc, (vu**2).sum(1)[s], len(docs))
            z = w0 + np.bincount(doc, wu[s], len(docs)) + 0.5 * c * ((total**2).sum(1) - square)
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[docs]) / len(docs)
            paired = (error * c)[doc]
            dw = np.bincount(s, error[doc], len(u))
            dv = np.stack([np.bincount(s, paired * total[doc, k], len(u)) for k in range(factors)], 1) - vu * np.bincount(s, paired, len(u))[:, None]
            g0 += error.sum() ** 2
            w0 -= rate * error.sum() / np.sqrt(g0)
            gw[u] += dw**2
            gv[u] += (dv**2).sum(1)
            w[u] = wu - rate / np.sqrt(gw[u]) * dw
            v[u] = vu - (rate / np.sqrt(gv[u]))[:, None] * dv
            step += 1
    for lo in range(0, n_slots, PIECE):
        shrink(np.arange(lo, min(lo + PIECE, n_slots)))
    return w0, w, v


def calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit the logits of rows not trained on to their labels; (1, 0) without both classes."""
    a, b = 1.0, 0.0
    if len(set(labels.tolist())) < 2:
        return a, b
    x = np.stack([logits, np.ones(len(logits))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        # Newton's step, with a pull towards (1, 0) that keeps it finite where the classes are apart.
        slope = x.T @ (p - labels) + 0.1 * np.array([a - 1, b])
        da, db = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), slope)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return max(float(a), 0.1), float(b)


def on_disk(lists: Iterator[bytes], kind: str) -> np.ndarray:
    """All lists, one after another, as an array in a file of the driver that goes with it."""
    with tempfile.TemporaryFile() as file:
        n = sum(file.write(x) for x in lists)
        file.flush()
        return np.memmap(file, kind, "r") if n else np.zeros(0, kind)


def in_order(flat: np.ndarray, at: np.ndarray, marks: list[int]) -> np.ndarray:
    """Rows in the order of their lists' bytes, then labels, so that the fit does not depend on how rows are split."""
    heads = [flat[lo : min(lo + 16, hi)].tobytes() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def compare(i: int, j: int) -> int:
        x, y = ((heads[i], marks[i]), (heads[j], marks[j])) if heads[i] != heads[j] else ((flat[at[k] : at[k + 1]].tobytes(), marks[k]) for k in (i, j))
        return (x > y) - (x < y)

    return np.array(sorted(range(len(marks)), key=cmp_to_key(compare)), np.int64)


def train(documents: DataFrame, labels: DataFrame, held_out: Column, per_class: int = 4000) -> Machine:
    bound_batches(documents.sparkSession)
    sample, counts = labelled.training_sample(documents, labels, "toxic", held_out, per_class)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in kernel.texts(batch.column(1)):
                row, bucket = terms(t)
                at = np.searchsorted(row, np.arange(len(t) + 1))
                lists = [bucket[at[i] : at[i + 1]].astype("<u4").tobytes() for i in range(len(t))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, len(t)), pa.array(lists, pa.binary())], ["label", "buckets"])

    # A job a partition, so that the driver never holds all lists.
    found = sample.mapInArrow(listed, "label int, buckets binary").toLocalIterator(prefetchPartitions=True)
    sizes, marks = [], []

    def bodies() -> Iterator[bytes]:
        for r in found:
            sizes.append(len(r["buckets"]) // 4)
            marks.append(r["label"])
            yield r["buckets"]

    flat = on_disk(bodies(), "<u4")
    at = np.cumsum([0, *sizes])
    order = in_order(flat, at, marks)
    begin, size, y = at[order], np.array(sizes, np.int64)[order], np.array(marks, float)[order]
    if len(set(y.tolist())) < 2:
        return Machine(0.0, np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, FACTORS)))
    buckets = np.zeros(0, "<u4")
    for lo in range(0, len(flat), LARGE):
        buckets = np.union1d(buckets, flat[lo : lo + LARGE])
    slots = on_disk((np.searchsorted(buckets, flat[lo : lo + PIECE]).astype(np.int32).tobytes() for lo in range(0, len(flat), PIECE)), "=i4")
    del flat
    share = 1 / np.maximum(size, 1)
    aside = np.random.default_rng(5).random(len(y)) < (0.2 if len(y) >= CALIBRATED else 0.0)
    own = np.flatnonzero(~aside)
    w0, w, v = fit(begin[own], size[own], slots, y[own], len(buckets), share[own])
    z = [summed(np.zeros(size[i], np.int64), slots[begin[i] : begin[i] + size[i]], share[i : i + 1], w, v) for i in np.flatnonzero(aside)]
    slope, shift = calibrated(w0 + np.concatenate([*z, np.zeros(0)]), y[aside])
    told = (w != 0) | (v != 0).any(1)
    bias = slope * w0 + shift + labelled.prior_shift(counts, y)
    return Machine(bias, buckets[told].astype(np.uint64), slope * w[told], np.sqrt(slope) * v[told])


def score(documents: DataFrame, machine: Machine, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``documents``."""
    bound_batches(documents.sparkSession)
    return labelled.scored(documents, machine.logits, held_out)


def kept(documents: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents``, all columns, whose score is below the threshold."""
    bound_batches(documents.sparkSession)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = np.concatenate([machine.logits(t) for t in kernel.texts(batch.column(at))])
                yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) < threshold))

    return documents.mapInArrow(run, documents.schema)


def op9_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held_out = table(spark, sf_dir, "documents"), labelled.bucket_of(5) == 0
    return score(documents, train(documents, table(spark, sf_dir, "labels"), held_out), held_out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_toxicity_fm": op9_toxicity_fm}
