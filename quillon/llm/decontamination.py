"""Benchmark decontamination by spaced-seed hashing.

Words are lower-case runs of letters, digits and bytes beyond ASCII. Each mask takes some of the words in a span
and ignores the others, so a hit survives substituted words at the ignored places. Hashes of the masked words of
every test item meet those of every position of every training text; each hit is then verified on its diagonal:
words of item and text are compared over the item's whole length, and a segment of which two thirds at least are equal
must hold at least ``LEAST`` equal words, or 80 % of a shorter item's. The segment is the best one where a match counts
1 and a mismatch -2 if that suffices, else the one with most equal words.

The masks are those of four words in a span of five. Cut into pieces of five words, a stretch with up to a fifth of its
words substituted has a piece with one such word at most, which a mask ignores: items of which 80 % are left, and passages
of ``LEAST`` words or more that are 80 % equal, are always found. Items of fewer words than a mask takes are hashed whole, and
are found where all their words are.

The test side goes to the tasks in blocks of about ``BLOCK_WORDS`` words, one pass over the texts for each block, so
that what a task holds does not grow with the test set. Only hits leave a task.

Segments of one item that overlap in a text, as those of repeated words do, are one stretch and one row, with their
common extent and the most equal words that one of them has.

Defined cases: null and empty texts have no hits; items that are null or without words are not searched for; repeated items count once; repeated rows of texts give repeated rows; an empty table
on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .workspace import bound_batches, table

#: Which words of a span count.
MASKS = ("1111", "10111", "11011", "11101")
#: The masks of items that have just so many words.
WHOLE = ("111", "11", "1")
LEAST = 13
BLOCK_WORDS = 500_000
#: Words of items that hits are compared with at a time.
COMPARED = 1 << 20
HITS = "doc_id long, item_id long, start_word long, n_words long, n_equal long"


def seeds(words: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of a mask at all places of each row."""
    at = kernel.within(first, len(mask))
    total = np.zeros(len(at), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += words[at + k] * kernel.SYMBOL[k]
    return at, kernel.mix(total + np.uint64(int(mask, 2)))


class Items:
    """A block of test items and the table of its seeds."""

    def __init__(self, ids: list[int], texts: list[str]):
        parts = list(kernel.texts(pa.array(texts, pa.string()), 1 << 62))
        t = parts[0] if parts else kernel.Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64), 0)
        self.ids = np.array(ids, np.int64)
        self.words, _, _, self.first = t.word_hashes(kernel.LETTERS, kernel.LOWER)
        row, size = kernel.rows_of(self.first), np.diff(self.first)
        self.tables = []
        for mask in (*MASKS, *WHOLE):
            at, key = seeds(self.words, self.first, mask)
            if mask in WHOLE:
                own = size[row[at]] == len(mask)
                at, key = at[own], key[own]
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[(key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables.append((key[order], row[at[order]], at[order], maybe))

    def hits(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (row, item, first word of the item's diagonal) where seeds meet and enough words are equal."""
        found = [np.zeros((0, 3), np.int64)]
        row = kernel.rows_of(first)
        for mask, (keys, item, place, maybe) in zip((*MASKS, *WHOLE), self.tables, strict=True):
            if not len(keys):
                continue
            at, key = seeds(words, first, mask)
            near = maybe[(key & np.uint64((1 << 20) - 1)).astype(np.int64)]
            at, key = at[near], key[near]
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            # All hits of a seed that many items have need not be held at once.
            done = np.r_[0, np.cumsum(n)]
            for a in range(0, int(done[-1]), COMPARED // 32):
                hit = np.arange(a, min(a + COMPARED // 32, int(done[-1])))
                of = np.searchsorted(done, hit, "right") - 1
                k, p = lo[of] + hit - done[of], at[of]
                found.append(self.enough(words, first, row[p], item[k], p - (place[k] - self.first[item[k]])))
        return np.unique(np.concatenate(found), axis=0)

    def enough(self, words: np.ndarray, first: np.ndarray, row: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The distinct diagonals on which as many words are equal as a segment needs."""
        order = np.lexsort((start, item, row))
        row, item, start = row[order], item[order], start[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])][: len(row)]
        row, item, start = row[new], item[new], start[new]
        size = np.diff(self.first)[item]
        lo, hi = np.maximum(start, first[row]), np.minimum(start + size, first[row + 1])
        done, equal = np.r_[0, np.cumsum(hi - lo)], np.zeros(len(row), np.int64)
        a = 0
        while a < len(row):
            b = max(a + 1, int(np.searchsorted(done, done[a] + COMPARED, "right")) - 1)
            which = np.repeat(np.arange(a, b), (hi - lo)[a:b])
            at = lo[which] + np.arange(done[a], done[b]) - done[which]
            same = words[at] == self.words[self.first[item[which]] + at - start[which]]
            equal[a:b] = np.bincount(which[same] - a, minlength=b - a)
            a = b
        ok = equal >= least(size)
        return np.stack([row[ok], item[ok], start[ok]], 1)

    def verified(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, start word in the row, words, most equal words on a diagonal) of each stretch of overlapping segments."""
        stretch: list[int] | None = None
        for row, item, start, n, equal in sorted(self.segments(words, first)):
            if stretch and stretch[:2] == [row, item] and start < stretch[2] + stretch[3]:
                stretch[3:] = [max(stretch[3], start + n - stretch[2]), max(stretch[4], equal)]
                continue
            if stretch:
                yield tuple(stretch)
            stretch = [row, item, start, n, equal]
        if stretch:
            yield tuple(stretch)

    def segments(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, start word in the row, words, equal words) of the diagonals on which a segment suffices."""
        for row, item, start in self.hits(words, first).tolist():
            base, n = int(self.first[item]), int(self.first[item + 1] - self.first[item])
            lo, hi = max(start, int(first[row])), min(start + n, int(first[row + 1]))
            same = words[lo:hi] == self.words[base + lo - start : base + hi - start]
            for segment in (best, fullest):
                begin, end = segment(same)
                equal = int(same[begin:end].sum())
                if equal >= least(n):
                    yield row, item, lo + begin - int(first[row]), end - begin, equal
                    break


def least(n):
    """Equal words that a segment of an item of n words must hold."""
    return np.minimum(LEAST, -(-4 * n // 5))


def best(same: np.ndarray) -> tuple[int, int]:
    """The segment with the highest score."""
    run = np.r_[0, np.cumsum(np.where(same, 1, -2))]
    floor = np.minimum.accumulate(run)
    end = int(np.argmax(run - floor))
    return int(np.flatnonzero(run[: end + 1] == floor[end])[-1]), end


def fullest(same: np.ndarray) -> tuple[int, int]:
    """Of the segments with two thirds of equal words, that is a score of 0 or more, the one with most equal words."""
    run, equal = np.r_[0, np.cumsum(np.where(same, 1, -2))], np.r_[0, np.cumsum(same)]
    later = np.maximum.accumulate(run[::-1])
    # From each place, the last end that still has its score.
    end = len(run) - 1 - np.searchsorted(later, run, "left")
    begin = int(np.lexsort((end - np.arange(len(run)), equal[np.arange(len(run))] - equal[end]))[0])
    inside = np.flatnonzero(same[begin : end[begin]])
    return (begin + int(inside[0]), begin + int(inside[-1]) + 1) if len(inside) else (begin, begin)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each stretch of a text that overlaps with a test item."""
    spark = documents.sparkSession
    bound_batches(spark)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // (6 * BLOCK_WORDS)
    out = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        block = Items([r["item_id"] for r in rows], [r["text"] for r in rows])

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for t in kernel.texts(batch.column(1)):
                    words, _, _, first = t.word_hashes(kernel.LETTERS, kernel.LOWER)
                    rows = [(ids[t.first + row], int(block.ids[item]), *rest) for row, item, *rest in block.verified(words, first)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "n_equal"])

        out.append(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, HITS))
    result = out[0]
    for more in out[1:]:
        result = result.unionAll(more)
    return result


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_spaced_seeds": op5_spaced_seeds}
