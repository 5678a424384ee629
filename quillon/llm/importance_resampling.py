"""Resampling documents toward a target distribution, over packed streams of hashed features.

Features are words and pairs of words; each has a bucket of ``BUCKETS``. A first pass writes, for each piece of the table, the
buckets of its documents' features as one stream of uint16 with the documents' offsets in it. These streams are what all
later work reads: sorted and run-length encoded a piece at a time they give the counts (a task adds up the runs and hands
on at most one row a bucket), and gathered through a table of gains and added up between offsets they give the weights
(``np.add.reduceat``). The target's counts come from its texts in the same way. Two tables of ``BUCKETS`` numbers come to the
driver, and one of gains goes to tasks, whatever the input.

A document's score is its weight and a Gumbel number made from its id, so the highest scores are a sample without
replacement. Ranks come from a sort by ranges of (score, id): a document's rank is its place in its range and the number of
documents in the ranges before.

Defined cases: null texts are empty; null and repeated ids are documents of their own, a null id hashed as an empty text and
first among ties; equal rows rank side by side; an empty table gives an empty result, and without a target its counts are
zero; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .workspace import bound_batches, settled, table

BUCKETS, SEED = 10_000, 7
LEAST_WORDS, PERCENT = 20, 25
#: A text beyond so many bytes is read in slices; words beyond LONG bytes one at a time.
SLICE, LONG = 4 << 20, 256
STREAM = "doc_ids array<long>, n_words array<long>, offsets array<long>, stream binary"


def crc_table() -> np.ndarray:
    """crc32's step for each byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> 1) ^ np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0))
    return out


CRC = crc_table()
FULL = np.uint32(0xFFFFFFFF)


def stepped(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 states after the bytes of the runs [start, start + length), byte by byte for all runs at once."""
    order = np.argsort(-length, kind="stable")
    state, start, length = state[order], start[order], length[order]
    far = int(np.searchsorted(-length, -LONG, "left"))
    for i in range(far):
        state[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(state[i] ^ FULL)) ^ int(FULL)
    # active[k]: runs that have a byte k.
    active = np.searchsorted(-length, -np.arange(min(LONG, int(length.max(initial=0)) + 1)), "left")
    for k, m in enumerate(active.tolist()):
        if m <= far:
            break
        some = slice(far, m)
        state[some] = CRC[(state[some] ^ data[start[some] + k]) & np.uint32(0xFF)] ^ (state[some] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, paired: np.ndarray, before: np.uint32 | None = None) -> tuple[np.ndarray, np.ndarray, np.uint32 | None]:
    """Buckets of the words and of the pairs, and the last word's state.

    paired: which words have one before them in their document; before: the state of the word before the first.
    """
    state = stepped(np.full(len(start), FULL), data, start, end - start)
    last = np.roll(state, 1)
    if before is not None and len(state):
        last[0] = before
    last = last[paired]
    last = CRC[(last ^ np.uint32(32)) & np.uint32(0xFF)] ^ (last >> np.uint32(8))
    pairs = stepped(last, data, start[paired], (end - start)[paired])
    return (state ^ FULL) % np.uint32(BUCKETS), (pairs ^ FULL) % np.uint32(BUCKETS), state[-1] if len(state) else before


def piece_stream(t: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each row, offsets of each row's features, stream) of a piece of texts."""
    data = kernel.LOWER[t.data]
    start, end, first = t.words(kernel.LETTERS)
    n = np.diff(first)
    paired = np.ones(len(start), bool)
    paired[first[:-1][n > 0]] = False
    words, pairs, _ = features(data, start, end, paired)
    size = n + np.maximum(n - 1, 0)
    offsets = np.r_[0, np.cumsum(size)]
    row = kernel.rows_of(first)
    stream = np.empty(offsets[-1], np.uint16)
    place = np.arange(len(start)) - first[row]
    stream[offsets[row] + place] = words
    stream[(offsets[row] + n[row] + place - 1)[paired]] = pairs
    return n, offsets, stream


def long_stream(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one long text, slice by slice: the state of a slice's last word goes to the next."""
    held: list[np.ndarray] = []
    n, before, lo = 0, None, 0
    while lo < len(data):
        hi = min(lo + SLICE, len(data))
        # A slice ends after a byte that is of no word; only a longer word makes it longer.
        while hi < len(data) and kernel.LETTERS[data[hi - 1]]:
            gap = np.flatnonzero(~kernel.LETTERS[data[lo:hi]])
            hi = lo + int(gap[-1]) + 1 if len(gap) else min(hi + SLICE, len(data))
        t = kernel.Texts(data[lo:hi], np.array([0, hi - lo]), 0)
        start, end, _ = t.words(kernel.LETTERS)
        paired = np.ones(len(start), bool)
        paired[:1] = before is not None
        words, pairs, before = features(kernel.LOWER[t.data], start, end, paired, before)
        held += [words.astype(np.uint16), pairs.astype(np.uint16)]
        n += len(words)
        lo = hi
    stream = np.concatenate(held) if held else np.zeros(0, np.uint16)
    return np.array([n]), np.array([0, len(stream)]), stream


def streams(texts: DataFrame, key: str) -> DataFrame:
    """A row of ``STREAM`` for each piece of the table: about 1 MB of texts, or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in kernel.texts(batch.column(1)):
                n, offsets, stream = long_stream(t.data) if len(t.data) > SLICE else piece_stream(t)
                lists = [batch.column(0).slice(t.first, len(t)), pa.array(n, pa.int64()), pa.array(offsets, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(pa.array([x.to_pylist()], pa.list_(pa.int64())) for x in lists), pa.array([stream.astype("<u2").tobytes()], pa.binary())], ["doc_ids", "n_words", "offsets", "stream"])

    return texts.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(run, STREAM)


def counted(packed: DataFrame) -> np.ndarray:
    """How often each bucket is in the streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                run_ = np.sort(np.frombuffer(raw.as_py(), "<u2"), kind="stable")
                edge = np.flatnonzero(np.r_[True, run_[1:] != run_[:-1]]) if len(run_) else np.zeros(0, int)
                total[run_[edge]] += np.diff(np.r_[edge, len(run_)])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    # At most BUCKETS rows.
    for r in packed.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: 1000 times the logarithm of how much more likely the target makes it, floored."""
    s_all, t_all = float(raw.sum()), float(target.sum())
    ratio = ((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)) for s, t in zip(raw.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n, offsets = (batch.column(k)[i].values for k in range(3))
                offsets = offsets.to_numpy()
                size = np.diff(offsets)
                some = size > 0
                weight = np.zeros(len(size), np.int64)
                if some.any():
                    # Empty documents begin where the next one does, so they must not be among the places.
                    got = gain[np.frombuffer(batch.column(3)[i].as_py(), "<u2")]
                    weight[some] = np.add.reduceat(got, offsets[:-1][some]) // size[some]
                yield pa.RecordBatch.from_arrays([ids, n, pa.array(size, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: F.Column, seed: int = SEED) -> F.Column:
    """floor(1000 times a Gumbel number) of an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(documents: DataFrame, target: DataFrame, target_key: str = "item_id", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document; rank: of those drawn."""
    bound_batches(documents.sparkSession)
    packed = settled(streams(documents, "doc_id"), "streams")
    gain = gains(counted(packed), counted(streams(target, target_key)))
    scored = weighed(packed, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    fit = F.col("n_words") >= LEAST_WORDS
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight"), F.col("read")]
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows are told apart by where they were read, so that ranges are of like size whatever repeats.
    dealt = scored.withColumn("fit", fit).withColumn("read", F.spark_partition_id()).repartitionByRange(partitions, *order).sortWithinPartitions(*order[:-1])
    # This number is the range's, shifted by 33 bits, and the place in it.
    ranges = settled(dealt.select("doc_id", "n_features", "weight", "score", "fit", F.monotonically_increasing_id().alias("at")), "ranges")
    part = F.shiftright("at", 33).cast("int")
    # One row a range; those that fit come before all others.
    held = sorted((r["part"], r["n"], r["fitting"]) for r in ranges.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fit").alias("fitting")).collect())
    drawn = percent * sum(x[2] for x in held) // 100
    before = np.cumsum([0, *(x[1] for x in held)]).tolist()
    begins = documents.sparkSession.createDataFrame([(x[0], before[k]) for k, x in enumerate(held)], "part int, before long")
    found = ranges.withColumn("part", part).join(F.broadcast(begins), "part")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return found.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_importance_resampling": op11_importance_resampling}
