"""Packing: shortest-pack-first over the length histogram.

Each document becomes token ids and an end id, cut into full sequences and a rest (see ``cuts``); the pieces'
lengths, longest first, are placed on patterns: all copies of a length go to the open packs that are filled least,
a whole group of packs of one pattern at a time, and to new packs where none has room. Only the histogram (at most
2048 lengths) comes to the driver, whatever the input: each length starts one group and splits one at most, so there are
no more than 4096 patterns, however many sequences follow each.

Each place in a pattern owns a range of ranks of its length, and pieces find their sequence by their rank among the
pieces of that length. Ranks are counted in (length, salt), with more salts for a length the more pieces have it, so a
length that a third of all pieces share is split. Places are cut at the salts' borders and laid between the pieces of
their (length, salt) in the order of ranks; each piece takes the last place before it. Nothing is broadcast but the
lengths' numbers of salts.

Words are told apart by 64-bit hashes while their ids are remembered.

Defined cases: a null or empty text is the end id alone; null ids are kept and rank first; repeated rows are
packed each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .workspace import bound_batches, settled, table

SIZE = 2048
END_ID = 1
#: A (length, salt) has about one in so many of all pieces, or LEAST pieces.
SHARES, LEAST = 4096, 64
#: The most distinct words whose ids a worker remembers.
REMEMBERED = 700_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Ids of texts by way of their parts: this tokenizer drops blanks, lowers case and never joins parts.

    Parts are blank-separated words, and inside plain words runs of letters, single digits and runs of other
    characters, as the tokenizer splits them itself. A word is plain if it has only printable ASCII and Latin-1
    letters, no apostrophe (contractions) and no ``<`` (special tokens); others stay whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for word, i in words.items() if word.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encoded(self, words: list[str], plain: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some words, how many each has)."""
        if plain:
            # One part has one token that ends a word.
            for lo in range(0, len(words), 2048):
                some = words[lo : lo + 2048]
                ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
                end = np.flatnonzero(self.ends[ids]) + 1
                if len(end) == len(some) and end[-1] == len(ids):
                    yield ids, np.diff(end, prepend=0)
                else:
                    yield from self.encoded(some, plain=False)
        else:
            for word in words:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32)
                yield ids, np.array([len(ids)])

    def learn(self, keys: list[int], words: list[str], plain: bool) -> None:
        ids, counts = zip(*self.encoded(words, plain), strict=True)
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.at = np.concatenate([self.at, self.used + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.used += len(ids)

    @staticmethod
    def parts(t: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-case bytes, starts and ends of the parts, the index of each row's first, and which are of plain words."""
        low = kernel.LOWER[t.data]
        lead = np.zeros(len(low) + 1, bool)
        lead[1:] = low == 0xC3
        tail = lead[:-1] & (low >= 0x80) & (low != 0x97) & (low != 0xB7)
        low[tail & (low < 0x9F)] += 0x20
        latin = tail.copy()
        latin[:-1] |= tail[1:]
        kind = np.where(latin, 1, KIND[low])
        start, end, first = t.words()
        odd = np.r_[0, np.cumsum(kind == 4)]
        plain = odd[end] == odd[start]
        word = np.repeat(np.arange(len(start)), end - start)
        inside = np.repeat(start - np.r_[0, np.cumsum(end - start)[:-1]], end - start) + np.arange(len(word))
        before = np.r_[0, kind][inside]
        opens = (inside == start[word]) | (plain[word] & ((kind[inside] != before) | (kind[inside] == 2)))
        at = np.flatnonzero(opens)
        of = word[at]
        begin = inside[at]
        finish = np.minimum(np.r_[begin[1:], len(low)], end[of])
        return low, begin, finish, np.searchsorted(of, first), plain[of]

    def ids(self, t: kernel.Texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a piece, each row's followed by ``end_id``, and the rows' offsets in them."""
        low, start, end, first, plain = self.parts(t)
        # Words that stay whole keep their case here: the tokenizer's own rules lower them.
        sums = [kernel.prefix_sums(kernel.SYMBOL[x]) for x in (t.data, low)]
        hashes = np.where(plain, kernel.run_hash(sums[1], start, end), kernel.run_hash(sums[0], start, end) ^ np.uint64(1))
        found, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(found) > REMEMBERED:
            self.forget()
        keys = found.tolist()
        slots = list(map(self.known.get, keys))
        new = np.array([k for k, slot in enumerate(slots) if slot is None], np.int64)
        for whole, raw in ((False, low.tobytes()), (True, t.data.tobytes())):
            some = new[plain[where[new]] != whole]
            if len(some):
                begin, finish = start[where[some]].tolist(), end[where[some]].tolist()
                self.learn(found[some].tolist(), [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin, finish, strict=True)], plain=not whole)
        if len(new):
            slots = list(map(self.known.__getitem__, keys))
        slot = np.array(slots, np.int64)[back]
        size = self.count[slot]
        before = np.r_[0, np.cumsum(size)]
        row = kernel.rows_of(first)
        offsets = before[first] + np.arange(len(t) + 1)
        out = np.full(offsets[-1], end_id, "<u4")
        spread = np.arange(before[-1])
        out[spread + np.repeat(row, size)] = self.flat[np.repeat(self.at[slot] - before[:-1], size) + spread]
        return out, offsets


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(path)


#: Of a byte in lower case: 1 a letter, 2 a digit, 3 other printable ASCII, 4 what makes a word be kept whole, 0 a blank.
KIND = np.full(256, 4, np.int8)
KIND[33:127] = 3
KIND[48:58] = 2
KIND[97:123] = 1
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[ord("'"), ord("<")]] = 4


def cuts(n: int, size: int = SIZE) -> list[int]:
    """Lengths of the pieces of a document of n ids: full sequences, then what is left in one piece."""
    return [size] * (n // size) + [n % size] * (n % size > 0)


def pieces(documents: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for t in kernel.texts(batch.column(1)):
                ids, at = words.ids(t, end_id)
                rows, view = [], memoryview(ids).cast("B")
                for i in range(len(t)):
                    n, done = int(at[i + 1] - at[i]), 0
                    for length in cuts(n, size):
                        lo = 4 * (int(at[i]) + done)
                        rows.append((names[t.first + i], done, length, zlib.crc32(view[lo : lo + 4 * length]), n))
                        done += length
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    bound_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, offset): where the pieces of a length go, by rank.

    Longest lengths are placed first, each on the shortest packs. A group is a pattern's sequences: they are numbered one
    after another and have the same lengths at the same offsets.
    """
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: first sequence, how many
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, room = 0, size
        while rank < histogram[length]:
            while room >= length and not groups[room]:
                room -= 1
            left = histogram[length] - rank
            if room < length:
                first, n, room = sequences, left, size
                sequences += n
            else:
                first, n = groups[room].pop()
            used = min(n, left)
            if used < n:
                groups[room].append((first + used, n - used))
            groups[room - length].append((first, used))
            out.append((length, rank, rank + used, first, size - room))
            rank += used
    return out


def places(slots: list[tuple[int, int, int, int, int]], counts: dict[int, list[tuple[int, int]]]) -> pa.Table:
    """length, salt, at (rank in the salt), sequence and offset of where each place begins in each salt that it reaches.

    counts: for each length, (salt, pieces) in the order of salts.
    """
    edges = {length: (np.array([salt for salt, _ in of]), np.cumsum([0, *(n for _, n in of)])) for length, of in counts.items()}
    rows = []
    for length, lo, hi, first, offset in slots:
        salts, edge = edges[length]
        for k in range(int(np.searchsorted(edge, lo, "right")) - 1, int(np.searchsorted(edge, hi, "left"))):
            begin = max(lo, int(edge[k]))
            rows.append((length, int(salts[k]), begin - int(edge[k]), first + begin - lo, offset))
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return pa.table({name: pa.array(x) for name, x in zip(("length", "salt", "at", "sequence", "place"), columns, strict=True)})


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` (with doc_id, start, length, ids_crc32) and sequence_id, offset for each piece."""
    spark = cut.sparkSession
    histogram = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}
    share = max(LEAST, sum(histogram.values()) // SHARES)
    # One row for each of at most 2048 lengths.
    salts = spark.createDataFrame([(length, 1 + n // share) for length, n in histogram.items()], "length long, salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), "salts")).drop("salts")
    counts: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for r in sorted(salted.groupBy("length", "salt").count().collect()):
        counts[r["length"]].append((r["salt"], r["count"]))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("at", own.cast("long")).withColumn("placed", F.lit(None).cast("struct<sequence:long,place:long,at:long>"))
    begins = spark.createDataFrame(places(patterns(histogram, size), counts)).select(*(F.lit(None).cast(cut.schema[c].dataType).alias(c) if c != "length" else "length" for c in cut.columns), "salt", "at", F.struct("sequence", "place", "at").alias("placed"))
    last = F.last("placed", ignorenulls=True).over(Window.partitionBy("length", "salt").orderBy("at", F.col("placed").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = ranked.unionByName(begins).withColumn("last", last).where("placed IS NULL")
    return found.select(*cut.columns, (F.col("last.sequence") + F.col("at") - F.col("last.at")).alias("sequence_id"), F.col("last.place").alias("offset"))


def packed(documents: DataFrame, tokenizer: str) -> DataFrame:
    return pack(settled(pieces(documents, tokenizer), "pieces"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_packing": op7_packing}
