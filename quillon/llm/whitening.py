"""Embedding whitening by cyclic Jacobi rotations.

Three passes over the vectors. The first adds up each dimension: tasks give a row a dimension, so no more comes out of the
whole table than dimensions. The second gives the centred scatter: a task multiplies its own centred vectors, and the rows
of these matrices are added up row by row, as a shuffle deals them. The driver gets the sums and one dims x dims matrix,
whatever the number of vectors, applies symmetric Jacobi rotations until each off-diagonal entry is nothing beside its two
diagonal ones (which keeps small eigenvalues accurate), sorts, and broadcasts the whitening matrix (dims x 8). The third
pass projects; the covariance of what it wrote is then taken to tell how far from the identity it is.

Components become integers x = floor(1024 * c) + 100000, so that sums and deviations are exact.

Defined cases: vectors that are null or hold a null or non-finite component take no part and give no row; a shorter vector
counts as ending in zeros; products beyond 2**62 count as the nearest such, deviations beyond a long as the largest one;
directions in which the vectors do not vary (eigenvalue below that of rounding) are no components, so vectors that are all
alike or empty give no rows; null and repeated ids are rows like others; no vectors at all give no rows; other columns are
ignored. More than ``MOST`` dimensions are refused: the driver holds their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import bound_batches, settled, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Dimensions at most.
MOST = 4096
FAR, LONG = float(1 << 62), (1 << 63) - 1
SWEEPS = 60


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return embeddings.where(whole).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def whole_numbers(vectors: pa.Array, dims: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """x of a column of vectors, padded to ``dims`` or the longest, and which entries are of the vectors themselves."""
    size = np.diff(vectors.offsets.to_numpy())
    dims = max(dims, int(size.max(initial=0)))
    own = np.arange(dims) < size[:, None]
    with np.errstate(over="ignore"):
        flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(float))
    x = np.full(own.shape, SHIFT, np.int64)
    x[own] = np.clip(flat, -FAR, FAR).astype(np.int64) + SHIFT
    return x, own


def safe(most: int | float, n: int) -> bool:
    """Whether ``n`` numbers of up to ``most`` add up in 64 bits."""
    return float(most) * max(n, 1) < FAR


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the sum of x in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, total = 0, np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = whole_numbers(batch.column(0))
            grow = x.shape[1] - len(total)
            if grow > 0:
                held, total = np.r_[held, np.zeros(grow, np.int64)], np.concatenate([total, np.zeros(grow, object)])
            n += batch.num_rows
            held[: x.shape[1]] += own.sum(0)
            x = np.where(own, x, 0)
            total[: x.shape[1]] += (x if safe(np.abs(x.astype(float)).max(initial=0), len(x)) else x.astype(object)).sum(0)
        # Dimension -1 stands for the vectors themselves.
        rows = [(-1, n, 0), *((j, int(held[j]), int(total[j])) for j in range(len(total)))] if n else []
        if rows:
            j, held_, total_ = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(held_, pa.int64()), pa.array([Decimal(v) for v in total_], pa.decimal128(38, 0))], ["dim", "held", "total"])

    parts = vectors.select("embedding").mapInArrow(run, "dim int, held long, total decimal(38,0)")
    # One row a dimension, of which there are few.
    found = {r["dim"]: r for r in parts.groupBy("dim").agg(F.sum("held").alias("held"), F.sum("total").alias("total")).limit(MOST + 2).collect()}
    n = found[-1]["held"] if found else 0
    dims = max(found, default=-1) + 1
    if dims > MOST:
        raise ValueError(f"vectors have up to {dims} dimensions, more than {MOST}")
    # What a vector lacks counts as zero, so as SHIFT.
    return n, [int(found[j]["total"]) + (n - found[j]["held"]) * SHIFT for j in range(dims)]


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit where they fit, Python integers where not."""
    most = max([float(np.abs(x.astype(float)).max(initial=0)), *(abs(s) / n for s in total)]) if total else 0.0
    if safe(2 * most, n):
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def squares(d: np.ndarray) -> np.ndarray:
    """The sum of squares of each row, exact, at most the largest long."""
    if safe(float(np.abs(d.astype(float)).max(initial=0)) ** 2, d.shape[1]):
        return (d * d).sum(1)
    return np.array([min(LONG, sum(int(v) ** 2 for v in row)) for row in d.tolist()], np.int64)


def covariance(vectors: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """V: the mean product of centred components."""
    dims = len(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter, any_ = np.zeros((dims, dims)), False
        for batch in batches:
            if batch.num_rows:
                y = deviations(whole_numbers(batch.column(0), dims)[0], n, total).astype(float) / n
                scatter += y.T @ y
                any_ = True
        for lo in range(0, dims if any_ else 0, 64):
            part = scatter[lo : lo + 64]
            yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + len(part)), pa.int32()), pa.array(list(part), pa.list_(pa.float64()))], ["dim", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, dims) if batch.num_rows else ()
            for j, row in zip(batch.column(0).to_pylist(), rows, strict=True):
                held[j] = held[j] + row if j in held else row.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["dim", "row"])

    kind = "dim int, row array<double>"
    rows = vectors.select("embedding").mapInArrow(run, kind).repartition("dim").mapInArrow(added, kind).collect()
    matrix = np.zeros((dims, dims))
    for r in rows:
        matrix[r["dim"]] = r["row"]
    return (matrix + matrix.T) / (2 * n)


def rounds(dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each pair of dimensions once, in rounds of pairs that share none (a round robin)."""
    circle = list(range(dims + dims % 2))
    for _ in range(len(circle) - 1):
        pairs = sorted({(min(a, b), max(a, b)) for a, b in zip(circle, reversed(circle), strict=True) if a < dims and b < dims})
        yield np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)
        circle = [circle[0], circle[-1], *circle[1:-1]]


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by cyclic Jacobi rotations.

    The pairs of a round share no dimension, so their rotations are applied together; a sweep of rounds meets each pair once.
    """
    a, vectors = np.array(matrix, float), np.eye(len(matrix))
    order = list(rounds(len(a)))
    eps = np.finfo(float).eps
    for _ in range(SWEEPS):
        rotated = False
        for p, q in order:
            apq, app, aqq = a[p, q], a[p, p], a[q, q]
            turn = np.abs(apq) > eps * np.sqrt(np.abs(app * aqq))
            turn &= np.abs(apq) > np.finfo(float).tiny
            if not turn.any():
                continue
            rotated = True
            p, q, apq, app, aqq = p[turn], q[turn], apq[turn], app[turn], aqq[turn]
            with np.errstate(over="ignore"):
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.sqrt(theta * theta + 1))
            c = 1 / np.sqrt(t * t + 1)
            s = t * c
            for m in (a, vectors):
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            up, down = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * up - s[:, None] * down, s[:, None] * up + c[:, None] * down
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            a[p, q] = a[q, p] = 0
        if not rotated:
            break
    values = np.diag(a).copy()
    by_value = np.argsort(-values, kind="stable")
    return values[by_value], vectors[:, by_value] / np.linalg.norm(vectors[:, by_value], axis=0)


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and leading component."""
    spark = embeddings.sparkSession
    bound_batches(spark)
    vectors = usable(embeddings)
    n, total = sums(vectors)
    found = covariance(vectors, n, total) if n and total else np.zeros((0, 0))
    values, axes = jacobi(found)
    trace = float(np.trace(found))
    count = int((values[:components] > len(values) * np.finfo(float).eps * max(values[0], 0)).sum()) if len(values) else 0
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not count:
        return spark.createDataFrame([], out)
    # dims x 8 numbers.
    matrix = spark.sparkContext.broadcast(axes[:, :count] / np.sqrt(values[:count]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = deviations(whole_numbers(batch.column(1), len(total))[0], n, total)
                w = (d.astype(float) / n) @ matrix.value
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares(d), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    projected = settled(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, deviation long, w array<double>"), "whitened")
    entry = [F.get("w", F.lit(i)) for i in range(count)]
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    of = projected.agg(*(F.covar_pop(entry[i], entry[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(of[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*(F.lit(float(v / trace)) for v in values[:count]))
    rows = projected.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_whitening": op12_whitening}
