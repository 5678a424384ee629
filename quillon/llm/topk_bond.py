"""Exact top-k search by columnar branch-and-bound.

Candidates are kept in blocks in vertical layout, one row of numbers a dimension, the dimensions that hold most of the
block's mass first; the lengths of what follows each ``STEP`` dimensions are computed once a block. A batch of queries
meets a block step by step: products are added up for ``STEP`` dimensions at a time, and what the remaining ones can add
or take is at most the product of both remainders' lengths (Cauchy-Schwarz), so each candidate has a lower and an upper
bound. Those whose upper bound is below the k-th best score so far, or the k-th best lower bound, are dropped: as long as
many are left for a query it stays in the batch's matrix product; then its columns are compacted.

Queries are the small side: they are dealt into blocks of up to ``QUERY_BYTES``, so that the candidates are sent once for
each such block, once in all if the queries fit. Both sides are dealt by query block and salt, and neither is broadcast; a
task keeps k rows for each query of the block at hand, and a window over these takes the best.

Components become integers, floor(1024 * x), in the smallest of 16 and 32-bit integers and doubles that holds a block's.
Scores are exact: where sums of products may reach 2**53, the double's error is added to the bounds and what is left is
scored in Python integers.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do those with a component
of 2**1014 or more, whose 1024-fold is no finite double; a shorter vector counts as ending in zeros; null ids take no part; rows that share an id are each a
candidate and each a query, never of one another; equal scores rank by smaller id; a score beyond a long's range counts as
the nearest long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import bound_batches, table

STEP = 8
#: Vectors of a candidate block, bytes of a query block (as doubles), queries that meet a block at a time.
BLOCK, QUERY_BYTES, BATCH = 4096, 16 << 20, 128
#: A query's columns are compacted when no more than one in so many candidates is left.
SPARSE = 8
SCALE = 1024
LONG = (1 << 63) - 1
PACKED = "dims int, kind string, ids binary, columns binary"
BEST = "block long, place long, query_id long, vec_id long, score long"


class Block:
    """Candidates: ids, and columns (dimensions by vectors) in the order of their mass."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray):
        self.ids, self.most = ids, float(np.abs(columns.astype(float)).max(initial=0))
        self.scale = 1.0 if self.most < 2**26 else self.most
        scaled = columns.astype(float) / self.scale
        squares = scaled**2
        self.order = np.argsort(-squares.sum(1), kind="stable")
        self.exact, self.columns = columns[self.order], scaled[self.order]
        steps = range(0, len(columns), STEP)
        parts = np.array([squares[self.order[lo : lo + STEP]].sum(0) for lo in steps]).reshape(len(steps), len(ids))
        # left[s]: lengths of what follows s steps.
        self.left = np.sqrt(np.r_[np.cumsum(parts[::-1], 0)[::-1], np.zeros((1, len(ids)))])
        self.by_id = np.argsort(ids, kind="stable")

    def named(self, query_id: int) -> np.ndarray:
        """Places of the candidates with this id."""
        ids = self.ids[self.by_id]
        return self.by_id[np.searchsorted(ids, query_id, "left") : np.searchsorted(ids, query_id, "right")]


class Queries:
    """A block of queries, and the best k (score, id) of each so far."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, columns.T.astype(float), k
        self.most = float(np.abs(self.rows).max(initial=0))
        self.scale = 1.0 if self.most < 2**26 else self.most
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def meet(self, block: Block) -> None:
        d = len(block.columns)
        rows = np.zeros((len(self.rows), d))
        rows[:, : min(d, self.rows.shape[1])] = self.rows[:, :d]
        rows = rows[:, block.order]
        for lo in range(0, len(rows), BATCH):
            self.batch(np.arange(lo, min(lo + BATCH, len(rows))), rows[lo : lo + BATCH], block)

    def batch(self, places: np.ndarray, rows: np.ndarray, block: Block) -> None:
        k, scaled, n, d = self.k, rows / self.scale, len(block.ids), len(block.columns)
        unit = self.scale * block.scale
        certain = d * self.most * block.most < 2.0**53
        steps = -(-d // STEP)
        parts = np.array([(scaled[:, s * STEP : (s + 1) * STEP] ** 2).sum(1) for s in range(steps)]).reshape(steps, len(rows))
        left = np.sqrt(np.r_[np.cumsum(parts[::-1], 0)[::-1], np.zeros((1, len(rows)))])
        error = 0.0 if certain else d * 2.0**-50
        floor = np.array([self.known(p) / unit for p in places.tolist()])
        score = np.zeros((len(rows), n))
        open_ = np.arange(len(rows))  # queries in the matrix product, in the order of score's rows
        own = [block.named(int(self.ids[p])) for p in places.tolist()]
        sparse: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # query, steps done, candidates left, their scores
        for s in range(steps):
            at = slice(s * STEP, (s + 1) * STEP)
            score += scaled[open_, at] @ block.columns[at]
            slack = left[s + 1, open_, None] * block.left[s + 1] * (1 + 1e-9) + error * left[0, open_, None] * block.left[0]
            for i, q in enumerate(open_.tolist()):
                score[i, own[q]] = -np.inf
                floor[q] = self.raised(floor[q], score[i] - slack[i], unit)
            keep = score + slack >= floor[open_, None]
            keep &= score > -np.inf
            few = keep.sum(1) * SPARSE <= n
            for i in np.flatnonzero(few).tolist():
                alive = np.flatnonzero(keep[i])
                if len(alive):
                    sparse.append((int(open_[i]), s + 1, alive, score[i, alive]))
            if few.any():
                open_, score = open_[~few], score[~few]
            if not len(open_):
                break
        sparse += [(int(q), steps, np.flatnonzero(score[i] > -np.inf), score[i][score[i] > -np.inf]) for i, q in enumerate(open_.tolist())]
        for q, done, alive, got in sparse:
            for s in range(done, steps + 1):
                slack = left[s, q] * block.left[s, alive] * (1 + 1e-9) + error * left[0, q] * block.left[0, alive]
                floor[q] = self.raised(floor[q], got - slack, unit)
                keep = got + slack >= floor[q]
                if not keep.all():
                    alive, got = alive[keep], got[keep]
                if s == steps or not len(alive):
                    break
                at = slice(s * STEP, (s + 1) * STEP)
                got = got + scaled[q, at] @ block.columns[at, alive]
            self.take(int(places[q]), block.ids[alive], got if certain and unit == 1 else self.whole(rows[q], block.exact[:, alive]))

    def known(self, place: int) -> float:
        """The k-th best score so far, or what is below any."""
        return float(self.best[place][-1][0]) if len(self.best[place]) == self.k else -np.inf

    def raised(self, floor: float, lower: np.ndarray, unit: float) -> float:
        """The floor, or the k-th best lower bound where that is higher; scores beyond a long are alike."""
        if len(lower) > self.k:
            floor = max(floor, min(float(np.partition(lower, len(lower) - self.k)[len(lower) - self.k]), LONG / unit))
        return floor if floor > -LONG / unit else -np.inf

    @staticmethod
    def whole(row: np.ndarray, columns: np.ndarray) -> list[int]:
        """Scores in Python integers."""
        q = [int(x) for x in row]
        return [max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(q, column, strict=True)))) for column in columns.T]

    def take(self, place: int, ids: np.ndarray, scores: np.ndarray | list[int]) -> None:
        if len(ids) > self.k and isinstance(scores, np.ndarray):
            top = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[top], scores[top]
        if len(ids):
            both = self.best[place] + [(int(s), int(i)) for s, i in zip(scores, ids, strict=True)]
            self.best[place] = sorted(both, key=lambda x: (-x[0], x[1]))[: self.k]


def packed(ids: np.ndarray, vectors: pa.Array) -> tuple[int, str, bytes, bytes]:
    """A block's dimensions, kind of number, ids and columns of floor(SCALE * x); shorter vectors end in zeros."""
    size = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(float))
    dims, most = int(size.max(initial=0)), np.abs(flat).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    rows = np.zeros((len(ids), dims), kind)
    rows[np.arange(dims) < size[:, None]] = flat
    return dims, kind, ids.astype("<i8").tobytes(), np.ascontiguousarray(rows.T).tobytes()


def unpacked(dims: int, kind: str, ids: bytes, columns: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(columns, kind).reshape(dims, len(ids))


def blocks(vectors: DataFrame, most: int) -> DataFrame:
    """The rows of each task in packed blocks of about ``most``."""

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks()
        row = packed(part["vec_id"].to_numpy(), part["embedding"].chunk(0))
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["dims", "kind", "ids", "columns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= most:
                yield made(held)
                held = []
        if held:
            yield made(held)

    return vectors.mapInArrow(run, PACKED)


def grouped(key: tuple, part: pa.Table) -> pa.Table:
    """A query block, in the order of ids and vectors: a block that is made again has each query at the same place."""
    part = part.combine_chunks()
    dims, kind, ids, columns = packed(part["vec_id"].to_numpy(), part["embedding"].chunk(0))
    ids, columns = unpacked(dims, kind, ids, columns)
    order = np.lexsort((*columns[::-1], ids))
    ids, columns = ids[order].tobytes(), np.ascontiguousarray(columns[:, order]).tobytes()
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "q_dims": pa.array([dims], pa.int32()), "q_kind": [kind], "q_ids": [ids], "q_columns": [columns]})


def nearest(embeddings: DataFrame, is_query: F.Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query."""
    spark = embeddings.sparkSession
    bound_batches(spark)
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < 2.0**1014))
    vectors = embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    queries = vectors.where("asks").select("vec_id", "embedding")
    count = vectors.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("asks"), 8 * F.size("embedding") + 8)).alias("bytes")).first()
    n_blocks = 1 + (count["bytes"] or 0) // QUERY_BYTES
    salts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count["rows"] // BLOCK)))

    # Groups of about QUERY_BYTES, whatever the number of queries.
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("long")).groupBy("block").applyInArrow(grouped, "block long, q_dims int, q_kind string, q_ids binary, q_columns binary")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = blocks(vectors.select("vec_id", "embedding"), BLOCK).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, queries = None, None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(block, place, int(queries.ids[place]), v, s) for place, best in enumerate(queries.best) for s, v in best] if queries else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["block", "place", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                of, *rest = (c[i].as_py() for c in batch.columns)
                if of != block:
                    yield from flush()
                    block, queries = of, Queries(*unpacked(*rest[:4]), k)
                queries.meet(Block(*unpacked(*rest[4:])))
        yield from flush()

    met = asked.join(held, ["block", "salt"]).select("block", "q_dims", "q_kind", "q_ids", "q_columns", "dims", "kind", "ids", "columns").sortWithinPartitions("block")
    found = met.mapInArrow(search, BEST)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk_bond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_topk_bond": op6_topk_bond}
ORACLE_SQL = {
    "op6_topk_bond": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}
