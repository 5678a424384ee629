"""The bounded sample of labelled rows that a classifier is fitted on, and the score column's frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel


def bucket_of(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def training_sample(documents: DataFrame, labels: DataFrame, column: str, held_out: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most ``per_class`` rows of either class, and the counts of both classes in all training rows.

    Rows are taken in the order of a hash of their id, so that the sample does not depend on how files are split.
    Several labels of one id count as the largest, several texts of one id as the smallest: the rows are bounded, too.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    counts = {int(r["label"]): int(r["count"]) for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("label = 1").orderBy(*order).limit(per_class).unionAll(known.where("label = 0").orderBy(*order).limit(per_class))
    # At most 2 * per_class ids, each of two numbers: small whatever the input.
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text"), counts


def prior_shift(counts: dict[int, int], taken: np.ndarray) -> float:
    """What to add to a logit that was learned on a sample with other shares of the classes."""
    n1, n0, s1, s0 = counts.get(1, 0), counts.get(0, 0), int((taken == 1).sum()), int((taken == 0).sum())
    return float(np.log(n1 / n0) - np.log(s1 / s0)) if min(n1, n0, s1, s0) else 0.0


def scored(documents: DataFrame, logits: Callable[[kernel.Texts], np.ndarray], held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; ``logits`` gives a value for each text of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = np.concatenate([logits(t) for t in kernel.texts(batch.column(2))])
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
