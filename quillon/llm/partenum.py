"""N-gram Jaccard join with PartEnum signatures, exact.

A text's set: its distinct shingles of ``SHINGLE`` words. Sets are compared in families of sizes [low, 2 * low], which
overlap so that any two sets with a Jaccard similarity of 0.8 share one. In a family such sets differ in at most k
shingles. The domain of shingles is split into n1 parts at the first level, each into ``SECOND`` at the second. Two sets
that differ in at most k < 2 * n1 shingles differ in at most one of them in some first-level part, hence agree on all
second-level parts of it but one. So the subsets of SECOND - 1 second-level parts of each first-level part are
enumerated, and what a set has in one is a signature: similar sets share one at least. Families whose sets may not differ
at all have one signature, the whole set.

A signature says little if all its shingles (or none) are such that many sets of a bounded sample of texts have them. The
first level has more parts than needed, so similar sets agree but for one second-level part in G of them or more, G being
n1 less half the shingles in which a set of this size and a similar one may differ. A set with fewer than G parts that
have a signature that says little does not emit those: one of its other parts has a signature that both sets emit.

Sets that share a signature meet through its leader (the smallest id that has it; of a signature that many of the sample
have, the smallest of the sample), and only (leader, set) rows leave the grouping of signatures, one each:

1. Each set is compared with the leader that it shares most of its ``FIRST`` smallest signatures with; links make
   components. So copies of one text are joined by one comparison each.
2. All signatures are grouped, with their sets' components. A signature whose sets are in one component, or are two that
   step 1 compared, gives no rows: a pair would else come once from each task that has one of its signatures. Each set
   of the others is compared with the leader that it shares most of them with.
3. Leaders whose sets are still in several components are dealt over cells: sets outside the leader's largest component
   meet all others, in blocks of ``BLOCK`` sets. In a cell, sketches (how many shingles fall into each of ``CELLS``;
   sets differ in as many shingles as the counts differ by, at least) leave the sets that may have a partner.
4. The texts of those come to their cell once each; pairs of different components are compared shingle by shingle, and
   a union-find in the task drops what is joined already: a cell gives fewer links than it has sets, never pairs.

Signatures travel as 32 bits and the partition's number, in binary columns; equal ones by chance only cost a comparison.
Shingles are compared as 64-bit hashes.

Defined cases: null, empty or blank texts have no shingles and link with nothing; texts of fewer than ``SHINGLE``
words have one shingle; a null doc_id links with nothing and has a null component_id; rows with one doc_id are
one document whose links add up; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .components import components
from .workspace import bound_batches, forget, settled, table

SHINGLE = 5
#: Similarity as a fraction.
NEAR = (4, 5)
#: Second-level parts of a first-level part.
SECOND = 4
#: One more first-level part for so many shingles that sets of a family may differ in.
SPARE = 8
#: Texts that are looked at for frequent shingles and hot signatures; one in RARE of these, and LEAST of them, must have it.
#: So at most RARE times the mean number of shingles of a text come to the driver, whatever the table's size.
SAMPLE, RARE, LEAST = 16_384, 512, 24
CELLS = 128
#: Smallest signatures of a set by which it meets its first leader; they only steer.
FIRST = 4
#: Sets, and shingles, of a leader that meet in one task; groups up to SMALL are looked at together.
BLOCK, BLOCK_SHINGLES, SMALL = 2048, 2 << 20, 48
#: Digests of texts with copies, and ids, are broadcast up to this many (32 bytes each at most), joined by shuffle beyond.
FEW_IDS = 100_000


def shingle_sets(t: kernel.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending in each, and the rows' offsets in them."""
    words, _, _, first = t.word_hashes(kernel.WORDS, kernel.LOWER)
    at = kernel.within(first, SHINGLE)
    size = np.diff(first)
    few = np.flatnonzero((size > 0) & (size < SHINGLE))
    start, end = np.r_[at, first[few]], np.r_[at + SHINGLE, first[few + 1]]
    row = np.r_[np.searchsorted(first, at, "right") - 1, few]
    hashes = kernel.run_hash(kernel.prefix_sums(words), start, end)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])][: len(row)]
    row, hashes = row[new], hashes[new]
    return hashes, np.searchsorted(row, np.arange(len(t) + 1))


def families(most: int) -> list[tuple[int, int]]:
    """(low, high) sizes: all that a size up to ``most`` is in, so that it meets similar sets of any size in one of them.

    ``most`` may be of any piece of a table: what a set's families are does not depend on it.
    """
    out, low = [], 1
    while low <= most:
        out.append((low, 2 * low))
        # The next must hold the smallest size whose similar sizes go beyond this one.
        low = 2 * low * NEAR[0] // NEAR[1] + 1
    return out


def parts_of(high: int) -> tuple[int, int]:
    """(n1, k) of the family whose sets have at most ``high`` shingles."""
    a, b = NEAR
    k = 2 * high * (b - a) // (a + b)
    return k // 2 + 1 + k // SPARE, k


def signatures(hashes: np.ndarray, offsets: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all rows; frequent: ascending shingles that say little."""
    size = np.diff(offsets)
    p, q = NEAR
    rare = ~is_in(hashes, frequent)
    rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for f, (low, high) in enumerate(families(int(size.max(initial=0)))):
        members = np.flatnonzero((size >= low) & (size <= high))
        if not len(members):
            continue
        n1, k = parts_of(high)
        n, slots = size[members], n1 * SECOND
        which = np.repeat(offsets[members] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        value = hashes[which]
        # Slots are ranges of hashes, and a row's hashes ascend, so what a slot has is a run.
        slot = ((value >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        edge = np.r_[0, np.cumsum(np.bincount(np.repeat(np.arange(len(members)) * slots, n) + slot.astype(np.int64), minlength=len(members) * slots))]
        sums, rares = np.zeros(len(value) + 1, np.uint64), np.r_[0, np.cumsum(rare[which])]
        np.cumsum(kernel.mix(value), out=sums[1:])
        content, n_rare = (np.diff(x[edge]).reshape(len(members), n1, SECOND) for x in (sums, rares))
        if k:
            # All second-level parts but one, for each one.
            content, n_rare = (x.sum(2, keepdims=True) - x for x in (content, n_rare))
        else:
            content, n_rare = (x.sum((1, 2)).reshape(-1, 1, 1) for x in (content, n_rare))
        little = n_rare == 0
        weak = little.any(2).sum(1)
        # The most shingles in which a similar set of this family can differ from one of n.
        differ = np.minimum((n + n * q // p) * (q - p) // (p + q), k)
        keep = ~little | (weak >= content.shape[1] - differ // 2)[:, None, None]
        place = np.arange(content[0].size, dtype=np.uint64).reshape(content.shape[1:]) + np.uint64(f << 40)
        rows.append(np.broadcast_to(members[:, None, None], keep.shape)[keep])
        out.append(kernel.mix(content + kernel.mix(place))[keep])
    return np.concatenate(rows), np.concatenate(out)


def is_in(key: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(key), bool)
    return ascending[np.minimum(np.searchsorted(ascending, key), len(ascending) - 1)] == key


def leading(documents: DataFrame) -> DataFrame:
    """doc_id, text, lead: the smallest id with the same text (its own where no other has it, or the text has no words)."""
    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    groups = settled(rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least"), "equal-texts")
    if groups.count() <= FEW_IDS:
        groups = F.broadcast(groups)
    return rows.join(groups, "digest", "left").select("doc_id", "text", F.coalesce("least", "doc_id").alias("lead"))


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many shingles of each row are in each cell, 255 at most."""
    n = np.diff(offsets)
    cell = np.repeat(np.arange(len(n)) * CELLS, n) + (hashes % np.uint64(CELLS)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=len(n) * CELLS), 255).astype(np.uint8).reshape(-1, CELLS)


def smallest(hashes: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """The ``FIRST`` smallest signatures of each wanted row, whatever is frequent."""
    row, key = signatures(hashes, offsets, np.zeros(0, np.uint64))
    # Signatures are spread evenly, so the smallest are below a share of the range; a row that has fewer there lists fewer.
    share = np.minimum(4 * FIRST / np.maximum(np.bincount(row, minlength=len(wanted)), 1), 1)
    low = wanted[row] & (key.astype(float) <= share[row] * 2.0**64)
    row, key = row[low], key[low]
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    few = np.arange(len(row)) - np.searchsorted(row, row) < FIRST
    row, key = row[few], key[few]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(wanted) + 1)), pa.int32()), pa.array(key.view(np.int64)))


def sizes(rows: DataFrame, leads: Column) -> DataFrame:
    """doc_id, n_shingles, sketch of each row, and the smallest signatures of those that lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leading = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for t in kernel.texts(batch.column(1)):
                hashes, offsets = shingle_sets(t)
                least = smallest(hashes, offsets, leading[t.first : t.first + len(t)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, len(t)), pa.array(np.diff(offsets), pa.int64()), pa.array([x.tobytes() for x in sketches(hashes, offsets)], pa.binary()), least], ["doc_id", "n_shingles", "sketch", "least"])

    return rows.select("doc_id", "text", leads.alias("leads")).mapInArrow(run, "doc_id long, n_shingles long, sketch binary, least array<long>")


def best(shared: DataFrame) -> DataFrame:
    """leader, doc_id: the leader that each set shares most signatures with, the smaller of equals."""
    return shared.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("leader")).alias("less"))).alias("best")).select((-F.col("best.less")).alias("leader"), "doc_id")


def first_met(n_of: DataFrame) -> DataFrame:
    """leader, doc_id: the best leader of each set by smallest signatures; none for sets that share none or lead all."""
    each = n_of.select("doc_id", F.explode("least").alias("sig"))
    heads = each.groupBy("sig").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").select("sig", "leader")
    return best(each.join(heads, "sig").where("leader <> doc_id").groupBy("leader", "doc_id").agg(F.count("*").alias("n")))


def placed_in(leads: DataFrame, groups: DataFrame, first: DataFrame) -> DataFrame:
    """doc_id, text, component, first: what ``buckets`` must know of each set; the id itself where there is none."""
    known = settled(groups.select(F.col("node").alias("doc_id"), "component").join(first.select("doc_id", F.col("leader").alias("first")), "doc_id", "full"), "known")
    known = F.broadcast(known) if known.count() <= FEW_IDS else known
    return leads.select("doc_id", "text").join(known, "doc_id", "left").select("doc_id", "text", F.coalesce("component", "doc_id").alias("component"), F.coalesce("first", "doc_id").alias("first"))


def sampled(leads: DataFrame, n: int, of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys that many of about ``SAMPLE`` texts have, ascending, and the smallest id of each; bounded as ``RARE`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in kernel.texts(batch.column(1)):
                row, key = of(*shingle_sets(t))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(row + t.first))], ["key", "doc_id"])

    every = max(1, n // SAMPLE)
    sample = leads.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("doc_id", "text")
    found = sample.mapInArrow(run, "key long, doc_id long").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).where(F.col("n") >= max(LEAST, n // every // RARE)).select("key", "leader").toPandas()
    key = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], found["leader"].to_numpy(np.int64)[order]


def buckets(placed: DataFrame, frequent: np.ndarray, hot: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """leader, doc_id, n: how many signatures each text shares with a leader; none with itself.

    ``placed``: doc_id, text, component and first leader. Left out are signatures whose sets are all in one component or
    are two of which one had the other as its first leader; not the hot ones, whose sets are in many tasks, once each.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, component, first = (batch.column(k).to_numpy() for k in (0, 2, 3))
            told = (component != ids) | (first != ids)
            for t in kernel.texts(batch.column(1), 2 << 20):
                row, key = signatures(*shingle_sets(t), frequent)
                row = row + t.first
                doc, warm = ids[row], is_in(key, hot[0])
                part = (key >> np.uint64(32)) % np.uint64(parts)
                part[warm] = doc[warm].astype(np.uint64) % np.uint64(parts)
                order = np.lexsort((part, warm))
                part, key, doc, warm, row = part[order], key[order], doc[order], warm[order], row[order]
                edge = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (warm[1:] != warm[:-1])][: len(part)])
                out = []
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True):
                    short = key[a:b] if warm[a] else (key[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4")
                    some = np.unique(row[a:b][told[row[a:b]] & ~warm[a]])
                    out.append((int(part[a]), bool(warm[a]), short.tobytes(), doc[a:b].tobytes(), np.stack([ids[some], component[some], first[some]], 1).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "warm", "sigs", "docs", "told"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, docs, known = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
        for batch in batches:
            for part, warm, sig, doc, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(doc, np.int64)
                if warm:
                    yield from met(hot[1][np.searchsorted(hot[0], np.frombuffer(sig, np.uint64))], ids)
                else:
                    sigs.append(np.frombuffer(sig, "<u4").astype(np.uint64) | np.uint64(part << 32))
                    docs.append(ids)
                    known.append(np.frombuffer(told, np.int64).reshape(-1, 3))
        sig, doc = np.concatenate(sigs), np.concatenate(docs)
        sigs, docs = [], []
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        # Most signatures have one set.
        both = sig[1:] == sig[:-1]
        several = (np.r_[False, both] | np.r_[both, False])[: len(sig)]
        sig, doc = sig[several], doc[several]
        if not len(sig):
            return
        told = np.concatenate(known)
        told = told[np.unique(told[:, 0], return_index=True)[1]]
        component, first = doc.copy(), doc.copy()
        hit = is_in(doc, told[:, 0])
        at = np.searchsorted(told[:, 0], doc[hit])
        component[hit], first[hit] = told[at, 1], told[at, 2]
        begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        end = np.r_[begin[1:], len(sig)] - 1
        n_ids = np.add.reduceat(np.r_[1, doc[1:] != doc[:-1]], begin)
        # A group that begins with the id that the one before ends with counts one less.
        n_ids[1:] += doc[begin[1:]] == doc[begin[1:] - 1]
        compared = (n_ids == 2) & ((first[end] == doc[begin]) | (first[begin] == doc[end]))
        keep = np.repeat((np.minimum.reduceat(component, begin) != np.maximum.reduceat(component, begin)) & ~compared, end - begin + 1)
        yield from met(np.repeat(doc[begin], end - begin + 1)[keep], doc[keep])

    def met(leader: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        other = leader != doc
        leader, doc = leader[other], doc[other]
        order = np.lexsort((doc, leader))
        leader, doc = leader[order], doc[order]
        new = np.flatnonzero(np.r_[True, (leader[1:] != leader[:-1]) | (doc[1:] != doc[:-1])][: len(doc)])
        n = np.diff(np.r_[new, len(doc)])
        for lo in range(0, len(new), 1 << 16):
            some = new[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(leader[some]), pa.array(doc[some]), pa.array(n[lo : lo + (1 << 16)], pa.int64())], ["leader", "doc_id", "n"])

    packed = placed.select("doc_id", "text", "component", "first").mapInArrow(spread, "part int, warm boolean, sigs binary, docs binary, told binary")
    return packed.repartition(parts, "part").mapInArrow(gather, "leader long, doc_id long, n long").groupBy("leader", "doc_id").agg(F.sum("n").alias("n"))


def near(n_x: np.ndarray, n_y: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with so many shingles in common are similar."""
    p, q = NEAR
    return (common > 0) & (q * common >= p * (n_x + n_y - common))


def each_set(column: pa.Array) -> Iterator[np.ndarray]:
    for t in kernel.texts(column):
        hashes, offsets = shingle_sets(t)
        for i in range(len(t)):
            yield hashes[offsets[i] : offsets[i + 1]]


def linked_to_leaders(met: DataFrame, leads: DataFrame, parts: int) -> DataFrame:
    """a, b: the pairs (leader, doc_id) of ``met`` whose texts are similar. A leader's text comes once for ``BLOCK`` others."""
    sized = met.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
    rows = met.join(sized, "leader").select("leader", "doc_id", F.pmod(F.xxhash64("doc_id"), "salts").alias("salt"), F.lit(False).alias("heads"))
    rows = rows.unionAll(sized.select("leader", F.col("leader").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("heads")))
    dealt = rows.join(leads.select("doc_id", "text"), "doc_id").select("leader", "salt", "heads", "doc_id", "text").repartition(parts, "leader", "salt").sortWithinPartitions("leader", "salt", F.desc("heads"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            links = []
            for leader, salt, is_head, doc, own in zip(*(batch.column(k).to_pylist() for k in range(4)), each_set(batch.column(4)), strict=True):
                if key != (leader, salt):
                    key, heads = (leader, salt), []
                if is_head:
                    heads.append(own.copy())
                elif any(near(len(x), len(own), len(np.intersect1d(x, own, assume_unique=True))) for x in heads):
                    links.append((min(leader, doc), max(leader, doc)))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def cells(found: DataFrame, groups: DataFrame, n_of: DataFrame) -> DataFrame:
    """leader, kind, i, j, doc_id, component, minor, n_shingles, sketch: where sets of several components of a leader meet.

    minor: outside the leader's largest component. Up to ``BLOCK`` sets are one cell (kind 0); beyond, blocks of minor
    ones meet blocks of the others (1) and of minor ones (2), so that copies in one component never meet each other.
    """
    members = found.select("leader", "doc_id").unionAll(found.select("leader", F.col("leader").alias("doc_id")).distinct())
    named = groups.select(F.col("node").alias("doc_id"), "component")
    placed = members.join(n_of, "doc_id").join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = settled(placed, "placed")
    each = placed.groupBy("leader", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    load = F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_SHINGLES)
    most = F.max(F.struct(load.alias("load"), (-F.col("component")).alias("less")))
    split = each.groupBy("leader").agg(F.count("*").alias("several"), most.alias("most"), F.sum(load).alias("all")).where("several > 1")
    split = split.select("leader", (-F.col("most.less")).alias("main"), F.col("all"), F.ceil("most.load").alias("main_blocks"), F.greatest(F.ceil(F.col("all") - F.col("most.load")), F.lit(1)).alias("minor_blocks"))
    rows = placed.join(split, "leader").withColumn("minor", F.col("component") != F.col("main"))
    block = F.pmod(F.xxhash64("doc_id"), F.when(F.col("minor"), F.col("minor_blocks")).otherwise(F.col("main_blocks")))
    zero = F.lit(0).cast("long")

    def cell(kind: int, i: F.Column, j: F.Column) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    every_main, every_minor = F.sequence(zero, F.col("main_blocks") - 1), F.sequence(zero, F.col("minor_blocks") - 1)
    own = (
        F.when(F.col("all") <= 1, F.array(cell(0, zero, zero)))
        .when(F.col("minor"), F.concat(F.transform(every_main, lambda j: cell(1, F.col("block"), j)), F.transform(every_minor, lambda o: cell(2, F.least("block", o), F.greatest("block", o)))))
        .otherwise(F.transform(every_minor, lambda i: cell(1, i, F.col("block"))))
    )
    return rows.withColumn("block", block).withColumn("cell", F.explode(own)).select("leader", "cell.kind", "cell.i", "cell.j", "doc_id", "component", "minor", "n_shingles", "sketch")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole cells, and where each begins; rows arrive in the order of their cells (the first four columns)."""
    rest = None
    for batch in batches:
        held = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        key = [held.column(k).to_numpy() for k in range(4)]
        edge = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in key], 0)])
        if len(edge) > 1:
            yield held.slice(0, int(edge[-1])), edge[:-1]
            held = held.slice(int(edge[-1]))
        rest = held
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(1, np.int64)


def candidates(edge: np.ndarray, component: np.ndarray, minor: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell and two components whose sketches may be those of similar sets, a piece at a time."""
    p, q = NEAR
    size = np.diff(np.r_[edge, len(n)])

    def passing(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (component[x] != component[y]) & ((p + q) * np.abs(n[x] - n[y]) <= (q - p) * (n[x] + n[y]))
        x, y = x[ok], y[ok]
        ok = (p + q) * np.abs(sketch[x].astype(np.int16) - sketch[y]).sum(1, dtype=np.int64) <= (q - p) * (n[x] + n[y])
        return x[ok], y[ok]

    # Small cells shift by shift over all rows at once, large ones row by row.
    group, small = np.repeat(np.arange(len(edge)), size), np.repeat(size <= SMALL, size)
    for shift in range(1, int(size[size <= SMALL].max(initial=1))):
        x = np.flatnonzero((group[shift:] == group[:-shift]) & small[shift:])
        yield passing(x, x + shift)
    for lo, m in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        rows = np.arange(lo, lo + m)
        for r in rows[minor[rows]].tolist():
            others = rows[~minor[rows] | (rows > r)]
            yield passing(np.full(len(others), r), others)


def hopeful(dealt: DataFrame) -> DataFrame:
    """The rows of cells that have a candidate; at most as many as there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, edge in whole_cells(batches):
            component, minor, n = (held.column(k).to_numpy(zero_copy_only=False) for k in (5, 6, 7))
            sketch = np.frombuffer(b"".join(held.column(8).to_pylist()), np.uint8).reshape(-1, CELLS)
            alive = np.zeros(held.num_rows, bool)
            for x, y in candidates(edge, component, minor, n, sketch):
                alive[x] = alive[y] = True
            if alive.any():
                yield held.select(list(range(7))).filter(pa.array(alive))

    return dealt.mapInArrow(run, "leader long, kind int, i long, j long, doc_id long, component long, minor boolean")


def top(root: dict[int, int], x: int) -> int:
    while root.get(x, x) != x:
        root[x] = root.get(root[x], root[x])
        x = root[x]
    return x


def links_of(doc: list[int], component: np.ndarray, minor: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (a, b) that join the components of a cell's similar sets, each of which joins two that were apart."""
    n = np.array([len(x) for x in sets], np.int64)
    hashes, offsets = np.concatenate(sets), np.r_[0, np.cumsum(n)]
    partners: dict[int, list[np.ndarray]] = {}
    for x, y in candidates(np.zeros(1, np.int64), component, minor, n, sketches(hashes, offsets)):
        for r in np.unique(x).tolist():
            partners.setdefault(r, []).append(y[x == r])
    # Who has a shingle: rows by shingle.
    shingle, of = np.unique(hashes, return_inverse=True)
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(of, kind="stable")
    holder, at = row[order], np.r_[0, np.cumsum(np.bincount(of, minlength=len(shingle)))]
    root: dict[int, int] = {}
    out = []
    for r, found in partners.items():
        y = np.concatenate(found)
        y = y[[top(root, int(component[k])) != top(root, int(component[r])) for k in y.tolist()]]
        if not len(y):
            continue
        own = of[offsets[r] : offsets[r + 1]]
        count = at[own + 1] - at[own]
        everyone = holder[np.repeat(at[own] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
        common = np.bincount(everyone, minlength=len(n))[y]
        for k in y[near(n[r], n[y], common)].tolist():
            a, b = top(root, int(component[r])), top(root, int(component[k]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((min(doc[r], doc[k]), max(doc[r], doc[k])))
    return out


def linked_in_cells(alive: DataFrame, leads: DataFrame, parts: int) -> DataFrame:
    """a, b: links between components, found from the texts of the cells' hopeful rows."""
    ids = settled(alive.select("doc_id").distinct(), "ids")
    texts = leads.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "doc_id")
    dealt = alive.join(texts, "doc_id").select("leader", "kind", "i", "j", "doc_id", "component", "minor", "text").repartition(parts, "leader", "kind", "i", "j").sortWithinPartitions("leader", "kind", "i", "j", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, edge in whole_cells(batches):
            sets = [x.copy() for x in each_set(held.column(7))]
            doc = held.column(4).to_pylist()
            component, minor = (held.column(k).to_numpy(zero_copy_only=False) for k in (5, 6))
            links = [x for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), held.num_rows], strict=True) for x in links_of(doc[lo:hi], component[lo:hi], minor[lo:hi], sets[lo:hi])]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def joined(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    spark = documents.sparkSession
    bound_batches(spark)
    rows = leading(documents)
    n_of = settled(sizes(rows, F.col("doc_id") == F.col("lead")), "shingles")
    total = n_of.agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("n")).first()
    leads = rows.where("doc_id = lead")
    # About one signature a shingle, and a million of them a partition.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total["n"] or 0) >> 20)
    frequent = sampled(leads, total["rows"], lambda hashes, offsets: (np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), hashes))[0]
    hot = sampled(leads, total["rows"], lambda hashes, offsets: signatures(hashes, offsets, frequent))
    # An id of several rows holds its rows' components together.
    known = settled(rows.select("doc_id", "lead"), "leads")
    several = known.groupBy("doc_id").agg(F.min("lead").alias("x"), F.max("lead").alias("y")).where("x < y").select("doc_id")
    links = known.join(several, "doc_id").where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    # Each text meets its first leader, then of all signatures between components the leader that it shares most with.
    first = settled(first_met(n_of), "first")
    links = settled(links.unionAll(linked_to_leaders(first, leads, parts)), "links")
    groups = components(links)
    found = settled(buckets(placed_in(leads, groups, first), frequent, hot, parts), "buckets")
    more = settled(linked_to_leaders(best(found), leads, parts), "links")
    if not more.isEmpty():
        links = settled(links.unionAll(more), "links")
        groups = components(links)
    # Then all that share a leader and are in different components.
    dealt = cells(found, groups, n_of.select("doc_id", "n_shingles", "sketch")).repartition(parts, "leader", "kind", "i", "j").sortWithinPartitions("leader", "kind", "i", "j")
    alive = settled(hopeful(dealt), "hopeful")
    more = settled(linked_in_cells(alive, leads, parts), "links")
    if not more.isEmpty():
        groups = components(links.unionAll(more))
    least = groups.select(F.col("node").alias("lead"), "component")
    by_id = known.join(least, "lead", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "lead")).alias("component_id"))
    forget(found, alive)
    nulls = sizes(documents.where("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), F.lit(False)).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return n_of.join(by_id, "doc_id").select("doc_id", "n_shingles", "component_id").unionAll(nulls)


def op4_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_partenum": op4_partenum}
