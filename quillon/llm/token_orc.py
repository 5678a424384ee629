"""Token ids as ORC: stripes of run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of their id and sorted inside each range, so files follow one another in the order of ids;
their texts become ids in that order and go straight into ORC files. A row is a piece of up to ``PIECE`` ids, so that a
writer's batch of rows stays small however long a text is. Columns: part (the range), doc_id, at (ids in the range before
the document), n_tokens and pieces (of the whole document), piece, ids. ORC encodes integers as runs and deltas, keeps the
least and greatest doc_id of each ``STRIDE`` rows and a Bloom filter beside them: a search for some ids reads little else
than the rows that may hold them, and Spark splits files at stripes, so large files are read by many tasks.

A document's place among all ids is what is in the ranges before (one number a range, from the files) and ``at``.
Checksums of pieces are put together without their ids, so nothing is shuffled on reading but the checksums of texts of
several pieces.

Defined cases: a null or empty text is the end id alone; null ids come first; rows that share an id are documents of their
own, in the order of a hash of their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .packing import word_ids
from .workspace import bound_batches, shared_dir, table

END_ID = 2
#: Ids of a row at most; rows of an entry of the row index (and of a Bloom filter); bytes of a stripe.
PIECE, STRIDE, STRIPE = 4096, 2000, 8 << 20
#: Share of absent ids that a Bloom filter lets through.
FPP = 0.01
ROW = "part int, doc_id long, at long, n_tokens long, pieces int, piece int, ids array<int>"


def encoded(documents: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Rows of ``ROW`` in ascending order of doc_id, range by range."""
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Repeated ids are told apart by their texts' hash, equal rows by where they were read: no id makes a range of its own too large.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("read", F.spark_partition_id())
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id", "tie", "read").sortWithinPartitions("doc_id", "tie").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = word_ids(tokenizer), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part, names = batch.column(0)[0].as_py(), batch.column(1)
            for t in kernel.texts(batch.column(2)):
                ids, at = words.ids(t, end_id)
                size = np.diff(at)
                pieces = -(-size // PIECE)
                row = np.repeat(np.arange(len(t)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = at[row] + piece * PIECE
                # Arrow batches of few pieces, and so is what the writer holds at a time.
                for lo in range(0, len(row), 512):
                    some = slice(lo, min(lo + 512, len(row)))
                    begin = start[some]
                    end = min(int(at[-1]), int(begin[-1]) + PIECE, int(at[row[some][-1] + 1]))
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, end] - begin[0], pa.int32()), pa.array(ids[begin[0] : end].view(np.int32)))
                    own = row[some]
                    columns = [pa.array(np.full(len(own), part, np.int32)), names.take(pa.array(own + t.first)), pa.array(at[own] + done), pa.array(size[own]), pa.array(pieces[own].astype(np.int32)), pa.array(piece[some].astype(np.int32)), lists]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ROW.split(", ")])
                done += int(at[-1])

    return dealt.mapInArrow(run, ROW)


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Ids of all documents as ORC files at ``path``."""
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FPP), "orc.create.index": "true", "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE), "compression": "zstd"}
    encoded(documents, tokenizer, end_id).write.options(**options).orc(path)


def read(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """Rows of ``ROW``; doc_ids: only these documents', found by way of the files' indexes and Bloom filters."""
    rows = spark.read.schema(ROW).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def advanced(crc: int, n: int) -> int:
    """What a crc32 becomes by ``n`` zero bytes after it: multiplied by x**(8 n), modulo the polynomial, bits mirrored."""

    def times(a: int, b: int) -> int:
        out = 0
        while a:
            if a & 0x80000000:
                out ^= b
            a = (a << 1) & 0xFFFFFFFF
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, step = 0x80000000, 0x00800000  # 1 and x**8
    while n:
        if n & 1:
            power = times(power, step)
        step = times(step, step)
        n >>= 1
    return times(power, crc)


def joined(parts: Iterable[tuple[int, int]]) -> int:
    """The crc32 of bytes from (bytes, crc32) of their parts in order."""
    out = 0
    for n, crc in parts:
        out = advanced(out, n) ^ crc
    return out


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files at ``path``."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *head, lists = batch.columns
            at, view = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy().astype("<i4", copy=False))).cast("B")
            crc = [zlib.crc32(view[4 * lo : 4 * hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*head, pa.array(np.diff(at), pa.int32()), pa.array(crc, pa.int64())], [*names, "size", "crc"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [joined((4 * x["size"], x["crc"]) for x in sorted(of, key=lambda x: x["piece"])) for of in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "crc"])

    names = ["part", "doc_id", "at", "n_tokens", "pieces", "piece"]
    rows = read(spark, path)
    # One row a range; ids of a range are what its last document ends at.
    ends = {r["part"]: r["ids"] for r in rows.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("ids")).collect()}
    order = sorted(ends)
    before = dict(zip(order, np.cumsum([0, *(ends[k] for k in order)]).tolist(), strict=False))
    starts = spark.createDataFrame(list(before.items()), "part int, before long")
    pieces = rows.mapInArrow(summed, "part int, doc_id long, at long, n_tokens long, pieces int, piece int, size int, crc long")
    columns = ["part", "doc_id", "at", "n_tokens", "crc"]
    # Of a document of several pieces come a few numbers each, 1 for 4096 ids.
    long = pieces.where("pieces > 1").groupBy("part", "doc_id", "at", "n_tokens").agg(F.collect_list(F.struct("piece", "size", "crc")).alias("of"))
    long = long.mapInArrow(whole, "part int, doc_id long, at long, n_tokens long, crc long")
    found = pieces.where("pieces = 1").select(columns).unionAll(long.select(columns)).join(F.broadcast(starts), "part")
    return found.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def op13_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, str(public_tokenizers.path("word_bpe_49k.json")))
    return digests(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_token_orc": op13_token_orc}
