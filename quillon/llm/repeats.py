"""Where runs of ``size`` symbols (words or bytes) of one text occur again: what both substring operators share.

Every window of ``size`` symbols has an anchor: among its grams of ``gram`` symbols the one with the smallest hash,
the leftmost of equals. Equal windows have equal anchors, so only windows whose anchor occurs more than once can
repeat. A text's anchors are a few hundredths of its symbols, and only they are counted over all texts.

1. Texts that are equal are grouped by digest; one of each group goes on.
2. Anchors are counted; those seen again keep the smallest doc_id that has them (``first``).
3. Each text with such anchors is cut into regions: runs of windows whose anchors share a ``first``.
4. Regions are dealt into shards of about ``SHARD`` bytes by ``first`` and meet there in the operator's own way
   (``meet``). Windows that are equal have one anchor, hence one ``first``, so they meet. An anchor of more than ``HOT``
   texts is hot: its regions are dealt over salts, about ``PER_SALT`` texts each, every salt with a copy of the region of
   ``first``; windows that the copy lacks are left over.
5. Left-over windows are counted over all texts, with partial sums before the shuffle: first, for up to ``step``
   neighbours at once, the run of symbols that they have in common (equal windows have equal ones), then, where
   that occurs again, each window.
6. Intervals come back to the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .workspace import bound_batches, forget, settled

HOT = 256
PER_SALT = 8
#: Groups of equal texts, and hashes, are broadcast up to this many (a digest and two numbers at most), joined by shuffle beyond.
FEW_GROUPS = 20_000
#: A place in a text: as many bits as the longest text of a JVM needs.
INDEX_BITS = 31
PIECE = 1 << 19
SHARD = 2 << 20
#: Stands for the smallest doc_id where no text has one.
NO_ID = -(1 << 63)
REGIONS = "first long, salt long, hot boolean, is_first boolean, doc_id long, digest long, start long, region binary"
#: kind 0: an interval [a, b) to remove. kind 1: left-over windows, b of them, whose common run has hash a; hashes
#: and starts of the windows are 64-bit numbers, all hashes first.
FOUND = "kind int, doc_id long, digest long, a long, b long, windows binary"


@dataclass(frozen=True)
class Unit:
    """What a symbol is, and the sizes of windows and grams."""

    words: bool
    size: int
    gram: int
    step: int

    def symbols(self, t: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, byte starts, byte ends, and the index of each row's first symbol."""
        if self.words:
            return t.word_hashes()
        at = np.arange(len(t.data))
        return kernel.SYMBOL[t.data], at, at + 1, t.offsets

    def windows(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of all windows."""
        at = kernel.within(first, self.size)
        return at, kernel.run_hash(kernel.prefix_sums(symbols), at, at + self.size)

    def anchors(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of all windows, the place of each one's anchor, and the hashes of all grams."""
        at = kernel.within(first, self.size)
        n = len(symbols) - self.gram + 1
        if not len(at):
            return at, at, np.zeros(0, np.uint64)
        p = np.arange(n)
        grams = kernel.run_hash(kernel.prefix_sums(symbols), p, p + self.gram)
        low = np.uint64((1 << INDEX_BITS) - 1)
        key = (grams & ~low) | p.astype(np.uint64)
        w = self.size - self.gram + 1
        blocks = np.full(-(-n // w) * w, ~np.uint64(0))
        blocks[:n] = key
        blocks = blocks.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        return at, (np.minimum(back[at], ahead[at + w - 1]) & low).astype(np.int64), grams


def merged(start: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Union of the windows with these ascending starts, as intervals."""
    if not len(start):
        return []
    cut = np.flatnonzero(np.diff(start) > size)
    return list(zip(start[np.r_[0, cut + 1]].tolist(), (start[np.r_[cut, len(start) - 1]] + size).tolist(), strict=True))


def prepared(documents: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), digest, copies (of the text, null: one) and leads (the copy that goes on)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    groups = few_or_not(rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("lead")).where("copies > 1"), "copies")
    return rows.join(groups, "sha", "left").select("doc_id", "text", "digest", "copies", (F.col("copies").isNull() | F.col("lead").eqNullSafe(F.col("doc_id"))).alias("leads"))


def few_or_not(df: DataFrame, name: str) -> DataFrame:
    """``df``, written, and marked for broadcast if its rows are few."""
    df = settled(df, name)
    return F.broadcast(df) if df.count() <= FEW_GROUPS else df


def searched(rows: DataFrame) -> DataFrame:
    """One row of each text and id that leads: rows that repeat, with an id or without, are searched once."""
    return rows.where("copies IS NULL").unionAll(rows.where("copies IS NOT NULL AND leads").dropDuplicates(["doc_id", "digest"]))


def anchors_of(rows: DataFrame, unit: Unit) -> DataFrame:
    """anchor, doc_id, digest, n: each distinct anchor of each text, and at how many places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in kernel.texts(batch.column(2), PIECE):
                symbols, _, _, first = unit.symbols(t)
                _, place, grams = unit.anchors(symbols, first)
                place = place[np.flatnonzero(np.diff(place, prepend=-1))]
                row = np.searchsorted(first, place, "right") - 1
                order = np.lexsort((grams[place], row))
                row, anchor = row[order], grams[place][order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])]) if len(row) else row
                own = pa.array(row[new] + t.first)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(np.diff(np.r_[new, len(row)]).astype(np.int32))], ["anchor", "doc_id", "digest", "n"])

    return rows.select("doc_id", "digest", "text").mapInArrow(run, "anchor long, doc_id long, digest long, n int")


def regions_of(rows: DataFrame, unit: Unit) -> DataFrame:
    """Regions of texts; rows: doc_id, digest, text and again (anchors that occur again, with first and salts, 0 unless hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, again = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for t in kernel.texts(batch.column(2), PIECE):
                symbols, begin, end, first = unit.symbols(t)
                at, place, grams = unit.anchors(symbols, first)
                window_row = np.searchsorted(at, first)
                out = []
                for i in range(len(t)):
                    own = slice(window_row[i], window_row[i + 1])
                    known = again[t.first + i].values
                    keys = known.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
                    order = np.argsort(keys)
                    keys = keys[order]
                    found = grams[place[own]]
                    k = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    hit = np.flatnonzero(keys[k] == found)
                    if not len(hit):
                        continue
                    firsts = known.field(1).to_numpy(zero_copy_only=False)[order][k[hit]]
                    salts_of = known.field(2).to_numpy(zero_copy_only=False)[order][k[hit]]
                    start = at[own][hit]
                    turns = np.flatnonzero((np.diff(start) > 1) | (np.diff(firsts) != 0) | (np.diff(salts_of) != 0)) + 1
                    for lo, hi in zip(np.r_[0, turns].tolist(), np.r_[turns, len(start)].tolist(), strict=True):
                        a, b, n_salts, lead = int(start[lo]), int(start[hi - 1]) + unit.size, int(salts_of[lo]), int(firsts[lo])
                        is_hot, is_first = n_salts > 0, ids[t.first + i] == lead
                        salts = (0,) if not is_hot else range(n_salts) if is_first else (digests[t.first + i] % n_salts,)
                        region = t.data[begin[a] : end[b - 1]].tobytes()
                        out += [(lead, s, is_hot, is_first, ids[t.first + i], digests[t.first + i], a - int(first[i]), region) for s in salts]
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, x, strict=True)) for x in out], SCHEMA)

    return rows.select("doc_id", "digest", "text", "again").mapInArrow(run, REGIONS)


SCHEMA = pa.schema([("first", pa.int64()), ("salt", pa.int64()), ("hot", pa.bool_()), ("is_first", pa.bool_()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("start", pa.int64()), ("region", pa.binary())])
FOUND_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("windows", pa.binary())])


def found_spans(doc_id: int | None, digest: int, spans: list[tuple[int, int]]) -> pa.RecordBatch:
    rows = [(0, doc_id, digest, a, b, None) for a, b in spans]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), FOUND_SCHEMA, strict=True)], schema=FOUND_SCHEMA)


def left_over(doc_id: int | None, digest: int, unit: Unit, sums: np.ndarray, left: np.ndarray, place: np.ndarray, hashes: np.ndarray, base: int, row_start: int) -> pa.RecordBatch:
    """Windows that start at ``left`` and have anchors at ``place`` (places in ``sums``), by their neighbourhoods.

    base: where the region starts in ``sums``; row_start: where it starts in its text.
    """
    near = (left - place) // unit.step
    turn = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(near) != 0)])
    begin = place[turn] + near[turn] * unit.step + unit.step - 1
    probe = kernel.run_hash(sums, begin, begin + unit.size - unit.step + 1)
    rows = []
    for p, lo, hi in zip(probe.view(np.int64).tolist(), turn.tolist(), [*turn[1:].tolist(), len(left)], strict=True):
        packed = hashes[lo:hi].astype("<u8").tobytes() + (left[lo:hi] - base + row_start).astype("<i8").tobytes()
        rows.append((1, doc_id, digest, p, hi - lo, packed))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), FOUND_SCHEMA, strict=True)], schema=FOUND_SCHEMA)


def windows_of(found: DataFrame) -> DataFrame:
    """window, doc_id, digest, a: hash and start of each left-over window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column(2).to_numpy()
                packed = [np.frombuffer(x, "<i8") for x in batch.column(3).to_pylist()]
                own = pa.array(np.repeat(np.arange(len(n)), n))
                halves = [np.concatenate([x[h * len(x) // 2 : (h + 1) * len(x) // 2] for x in packed]) for h in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(halves[0]), batch.column(0).take(own), batch.column(1).take(own), pa.array(halves[1])], ["window", "doc_id", "digest", "a"])

    return found.select("doc_id", "digest", "b", "windows").mapInArrow(run, "window long, doc_id long, digest long, a long")


def gathered(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts small batches of one schema together."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def covered(rows: DataFrame, unit: Unit, again: Column, order: list[Column], meet: Callable[[DataFrame], DataFrame], repeated: Column) -> DataFrame:
    """doc_id, digest, spans: intervals of symbols to remove. rows: as ``prepared`` gives them.

    again: over first, n_texts and n_places of an anchor, whether it can make a repeat. meet: from regions, dealt into
    shards and put in ``order`` in each, to rows like ``FOUND``. repeated: over lead, doc_id and n of a left-over window.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    rows = searched(rows)
    anchors = settled(anchors_of(rows, unit), "anchors")
    seen = anchors.groupBy("anchor").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first"), F.count("*").alias("n_texts"), F.sum("n").alias("n_places")).where(again).select("anchor", "first", F.when(F.col("n_texts") > HOT, F.ceil(F.col("n_texts") / PER_SALT)).otherwise(0).cast("long").alias("salts"))
    lists = settled(anchors.join(seen, "anchor").groupBy("doc_id", "digest").agg(F.collect_list(F.struct("anchor", "first", "salts")).alias("again")), "again")
    forget(anchors)
    size = (lists.agg(F.sum(F.size("again"))).first()[0] or 0) * unit.size * (6 if unit.words else 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (4 << 20))
    named = lists.select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "again").hint("merge")
    cut = regions_of(rows.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))), unit)
    shard = F.pmod(F.xxhash64("first", "salt"), F.lit(max(parts, size // SHARD)))
    dealt = cut.withColumn("shard", shard).repartition(parts, "shard").sortWithinPartitions("shard", *order)
    found = settled(meet(dealt), "found")
    forget(lists)
    left = found.where("kind = 1")
    common = few_or_not(left.groupBy("a").count().where("count > 1").select("a"), "common")
    windows = settled(windows_of(left.join(common, "a")), "left-over")
    twice = few_or_not(windows.groupBy("window").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1"), "twice")
    late = windows.join(twice, "window").where(repeated).select("doc_id", "digest", "a", (F.col("a") + unit.size).alias("b"))
    spans = found.where("kind = 0").select("doc_id", "digest", "a", "b").unionAll(late)
    return spans.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` and each one's spans (null: none)."""
    named = spans.select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "spans").hint("merge")
    return rows.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left").drop("id", "of")


def union_of(spans: pa.Scalar) -> list[tuple[int, int]]:
    """Disjoint, ascending, maximal intervals of a row's spans."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans.as_py() or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
