"""Suffix-array dedup with a logarithmic index family, over bytes.

Removes each byte covered by a string of ``SIZE`` bytes that also starts anywhere else, in the same text or another.
``repeats`` finds the anchors that occur again and deals the regions around them into shards of bounded size. In a
shard, regions arrive in batches of about ``BATCH`` bytes. A batch gets a suffix array of its own: ranks of 5, 10, 20, ...
``SIZE`` bytes are made by prefix doubling, so that suffixes stand in the order of their bytes, and neighbours with one
rank share ``SIZE`` bytes. This array is merge-scanned against the array of every level of the shard's index, byte for
byte and not by a hash. The strings that no level has become a level, an array still in order; while the last level is
at least half as large as the one before it, these two arrays are merged in one pass. So bytes are sorted once, in their
batch, each string is merged about log2(batches) times, and each distinct string is in one level.

A hot anchor's salts are small indexes of their own; strings that its first text lacks are counted over all texts by hash.

Texts that equal another one are removed whole if they have ``SIZE`` bytes; one of them stays in the index.

Defined cases: null and empty texts have no bytes; doc_id only names rows, so null and repeated ids are no special
case and repeated rows are equal texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, repeats
from .workspace import table

SIZE, GRAM = 200, 48
UNIT = repeats.Unit(words=False, size=SIZE, gram=GRAM, step=16)
BATCH = 1 << 19
#: Strings that a scan holds of each of two arrays, of SIZE bytes each.
BLOCK = 1 << 14
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of numbers of at most ``bits`` bits in their order, and whether each equals its predecessor."""
    n = len(key)
    place = max(1, (n - 1).bit_length())
    if bits + place <= 64:
        # Sorting numbers that carry their places is much faster than sorting places.
        packed = np.sort(key << np.uint64(place) | np.arange(n, dtype=np.uint64))
        order, value = (packed & np.uint64((1 << place) - 1)).astype(np.int64), packed >> np.uint64(place)
    else:
        order = np.argsort(key, kind="stable")
        value = key[order]
    return order, np.r_[False, value[1:] == value[:-1]][:n]


def ranked(key: np.ndarray, bits: int) -> np.ndarray:
    """The rank of each number among all, equal ones alike."""
    order, same = ordered(key, bits)
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(~same).astype(np.uint64) - np.uint64(1)
    return out


def suffix_array(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` (their places) in the order of the SIZE bytes that begin there, and whether each has those of its predecessor."""
    n, bits = len(data), max(1, (len(data) - 1).bit_length())

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        return np.r_[x[by:], np.zeros(min(by, n), x.dtype)]

    head, size = np.zeros(n, np.uint64), 5
    for k in range(size):
        head = head << np.uint64(8) | ahead(data, k)
    rank = ranked(head, 8 * size)
    while 2 * size <= SIZE:
        rank, size = ranked(rank << np.uint64(bits) | ahead(rank, size), 2 * bits), 2 * size
    return ordered((rank << np.uint64(bits) | ahead(rank, SIZE - size))[starts], 2 * bits)


def strings(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The SIZE bytes at each start, as fixed-width byte strings, which numpy orders as ``suffix_array`` does."""
    return np.ascontiguousarray(sliding_window_view(data, SIZE)[starts]).view(f"S{SIZE}").ravel()


@dataclass
class Level:
    """A suffix array: ``order`` holds where distinct strings of ``SIZE`` bytes start in ``data``, in the order of their bytes.

    arrivals: when each string first arrived. edges: of the regions that ``data`` is made of.
    """

    data: np.ndarray
    edges: np.ndarray
    order: np.ndarray
    arrivals: np.ndarray

    def with_only(self, kept: np.ndarray) -> Level:
        """Some of the strings, in their order, and the bytes of the regions that they lie in."""
        order, size = self.order[kept], np.diff(self.edges)
        of = np.searchsorted(self.edges, order, "right") - 1
        size = np.where(np.bincount(of, minlength=len(size)) > 0, size, 0)
        moved = np.r_[0, np.cumsum(size)[:-1]] - self.edges[:-1]
        inside = np.repeat(size > 0, np.diff(self.edges))
        return Level(self.data[self.edges[0] : self.edges[-1]][inside], np.r_[0, np.cumsum(size[size > 0])], order + moved[of], self.arrivals[kept])

    def places(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """Before which string of this array each of ``other`` comes, and whether the two are equal.

        Both arrays are read once, front to back, in blocks of ``BLOCK`` strings, which are compared byte for byte.
        """
        place, equal = np.zeros(len(other.order), np.int64), np.zeros(len(other.order), bool)
        if not len(self.order):
            return place, equal
        heads = strings(self.data, self.order[::BLOCK])
        block = np.concatenate([np.searchsorted(heads, strings(other.data, other.order[i : i + BLOCK]), "right") for i in range(0, len(place), BLOCK)] or [place])
        edge = np.searchsorted(block, np.arange(len(heads) + 2))
        for k in range(1, len(heads) + 1):
            lo, hi = int(edge[k]), int(edge[k + 1])
            own = strings(self.data, self.order[(k - 1) * BLOCK : k * BLOCK]) if lo < hi else heads
            for i in range(lo, hi, BLOCK):
                wanted = strings(other.data, other.order[i : min(i + BLOCK, hi)])
                at = np.searchsorted(own, wanted)
                place[i : i + len(at)] = (k - 1) * BLOCK + at
                equal[i : i + len(at)] = own[np.minimum(at, len(own) - 1)] == wanted
        return place, equal

    def merged(self, other: Level) -> Level:
        """One array of both; no string is in both."""
        place, _ = self.places(other)
        n = len(self.data)
        return Level(np.r_[self.data, other.data], np.r_[self.edges, other.edges[1:] + n], np.insert(self.order, place, other.order + n), np.insert(self.arrivals, place, other.arrivals))


class Family:
    """Levels of geometric sizes. Each distinct string is in one level; ``first_of`` each string that arrived is its first equal."""

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.first_of, self.is_first = np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, data: np.ndarray, edges: np.ndarray, starts: np.ndarray, is_first: np.ndarray) -> None:
        """A batch of regions [edges[i], edges[i + 1]) of ``data``; is_first: of each start."""
        known = len(self.first_of)
        order, same = suffix_array(data, starts)
        edge = np.flatnonzero(~same)
        # Equal strings stand in the order of their places: the first one stands for all.
        batch = Level(data, edges, starts[order[edge]], known + order[edge])
        first = batch.arrivals.copy()
        left = np.arange(len(edge))
        for level in self.levels:
            place, equal = level.places(Level(data, edges, batch.order[left], batch.arrivals[left]))
            first[left[equal]] = level.arrivals[place[equal]]
            left = left[~equal]
        firsts = np.empty(len(starts), np.int64)
        firsts[order] = np.repeat(first, np.diff(np.r_[edge, len(order)]))
        self.first_of, self.is_first = np.r_[self.first_of, firsts], np.r_[self.is_first, is_first]
        if len(left):
            self.levels.append(batch.with_only(left))
        while len(self.levels) > 1 and len(self.levels[-2].order) <= 2 * len(self.levels[-1].order):
            self.levels[-2:] = [self.levels[-2].merged(self.levels[-1])]

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each string by its order of arrival: whether it has an equal, and whether one of its equals is of a first text."""
        n = len(self.first_of)
        return np.bincount(self.first_of, minlength=n)[self.first_of] > 1, np.bincount(self.first_of[self.is_first], minlength=n)[self.first_of] > 0


class Shard:
    """The index of one shard, the batch that is being gathered, and what is needed of its regions when all have been added."""

    def __init__(self) -> None:
        self.family, self.rows, self.held = Family(), [], []

    def add(self, t: kernel.Texts, columns: list[list]) -> None:
        starts = kernel.within(t.offsets, SIZE)
        size = np.diff(np.searchsorted(starts, t.offsets))
        own = list(zip(*columns, strict=True))
        # A hot region is needed again for the windows that its first text lacks.
        self.rows += [(*x, int(size[i]), t.bytes_of(i) if x[0] and not x[1] else None) for i, x in enumerate(own)]
        self.held.append((t.data, t.offsets, starts, np.repeat([x[1] for x in own], size)))
        if sum(len(x[0]) for x in self.held) >= BATCH:
            self.flush()

    def flush(self) -> None:
        if self.held:
            data, offsets, starts, first = zip(*self.held, strict=True)
            before = np.cumsum([0, *map(len, data)])
            self.family.add(np.concatenate(data), np.r_[0, np.concatenate([x[1:] + b for x, b in zip(offsets, before, strict=False)])], np.concatenate([x + b for x, b in zip(starts, before, strict=False)]), np.concatenate(first).astype(bool))
            self.held = []

    def finished(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        repeated, with_first = self.family.told()
        done = 0
        for _, _, doc_id, digest, start, n, region in self.rows:
            own = slice(done, done + n)
            done += n
            spans = repeats.merged(np.flatnonzero(repeated[own]) + start, SIZE)
            if spans:
                yield repeats.found_spans(doc_id, digest, spans)
            if region is not None and len(left := np.flatnonzero(~with_first[own])):
                symbols = kernel.SYMBOL[np.frombuffer(region, np.uint8)]
                sums, (_, place, _) = kernel.prefix_sums(symbols), UNIT.anchors(symbols, np.array([0, len(symbols)]))
                yield repeats.left_over(doc_id, digest, UNIT, sums, left, place[left], kernel.run_hash(sums, left, left + SIZE), 0, start)


def meet(regions: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, Shard()
        for batch in batches:
            first, salt, hot, number = (batch.column(k).to_pylist() for k in (0, 1, 2, 8))
            keys = [(n, f, s) if h else (n,) for f, s, h, n in zip(first, salt, hot, number, strict=True)]
            edge = [i for i, x in enumerate(keys) if not i or keys[i - 1] != x]
            for lo, hi in zip(edge, [*edge[1:], len(keys)], strict=True):
                if key != keys[lo]:
                    yield from shard.finished()
                    key, shard = keys[lo], Shard()
                part = batch.slice(lo, hi - lo)
                columns = [part.column(i).to_pylist() for i in range(2, 7)]
                for t in kernel.texts(part.column(7), BATCH):
                    shard.add(t, [x[t.first : t.first + len(t)] for x in columns])
        yield from shard.finished()

    return regions.mapInArrow(repeats.gathered(run), repeats.FOUND)


def finished(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, spans = batch.column(2).to_pylist(), batch.column(3)
            out = []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                removed = repeats.union_of(spans[i]) if not copies[i] else [(0, len(text))] if len(text) >= SIZE else []
                edges = [0, *(x for span in removed for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(removed), hashlib.sha256(kept).hexdigest()))
            if out:
                n, gone, runs, sha = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", "text", "copies", "spans").mapInArrow(run, RESULT)


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    rows = repeats.prepared(documents)
    # A hot anchor's salts one after another, behind what the shard has else.
    order = ["hot", F.when(F.col("hot"), F.col("first")), F.when(F.col("hot"), F.col("salt")), F.desc("is_first"), "first", "doc_id", "digest"]
    spans = repeats.covered(rows, UNIT, F.col("n_places") > 1, order, meet, F.lit(True))
    return finished(repeats.with_spans(rows, spans))


def op10_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_suffix_levels": op10_suffix_levels}
