"""Substring dedup by repeated-phrase automata, over words.

Removes each word covered by a window of ``SIZE`` words whose sequence also starts in a text with a smaller doc_id.
``repeats`` finds the phrases (anchors of ``GRAM`` words) that recur in several texts, by hash and over the whole table,
and deals what the texts have around them into shards of bounded size. Each shard is compiled, once, into one
Aho-Corasick automaton of all its phrases, which confirms them word for word; then the texts are streamed through it in
the order of their ids. A window is known by the phrase that the automaton locates first in it, how far into the window
that is, and the hash of its words; it goes if a text with a smaller id has shown the same. What the automaton does not
locate is not looked at.

Texts equal to one with a smaller id lose all words if they have a window at all; they need no search.

Defined cases: null and empty texts have no words; a null doc_id is larger than any other and than no null; rows
with one doc_id are one document as sources and never remove each other's words; repeated rows give the same
result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, repeats
from .workspace import table

SIZE, GRAM = 50, 16
UNIT = repeats.Unit(words=True, size=SIZE, gram=GRAM, step=8)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Shard:
    """Phrases, their automaton, and the windows that texts with smaller ids have around them."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.first: list[tuple[list[bytes], np.ndarray]] = []
        self.automaton = None
        self.seen: set[int] = set()
        self.last: int | None = None
        self.waiting: list[int] = []

    def learn(self, words: list[bytes], places: np.ndarray, hashes: np.ndarray) -> None:
        """Takes what a phrase's first text has around it; all of these come before other texts."""
        for p in places.tolist():
            self.numbers.setdefault(f" {b' '.join(words[p : p + GRAM]).decode('latin-1')} ", len(self.numbers))
        self.first.append((words, hashes))

    def compiled(self):
        if self.automaton is None and self.numbers:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for phrase, k in self.numbers.items():
                self.automaton.add_word(phrase, (k, len(phrase)))
            self.automaton.make_automaton()
            for words, hashes in self.first:
                self.seen.update(self.located(words, hashes)[1].tolist())
            self.first = []
        return self.automaton

    def located(self, words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows in which the automaton locates a phrase, and what each is known by."""
        automaton = self.compiled()
        if automaton is None:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        begins = np.cumsum([1, *(len(w) + 1 for w in words)])
        found = [(end - n + 2, k) for end, (k, n) in automaton.iter(f" {b' '.join(words).decode('latin-1')} ")]
        char, phrase = np.array(found, np.int64).reshape(-1, 2).T
        at = np.r_[np.searchsorted(begins, char), len(words) + SIZE]
        starts = np.arange(len(hashes))
        first = np.searchsorted(at, starts)
        starts = starts[at[first] + GRAM <= starts + SIZE]
        hit = first[starts]
        return starts, kernel.mix(hashes[starts] + kernel.mix((phrase[hit] << 8 | at[hit] - starts).astype(np.uint64)))

    def known(self, doc_id: int | None, keys: list[int], keep: bool) -> np.ndarray:
        """Which of the located windows a text with a smaller id has; keep: larger ids are compared with these too."""
        if doc_id != self.last:
            self.seen.update(self.waiting)
            self.last, self.waiting = doc_id, []
        if keep:
            self.waiting += keys
        return np.array([key in self.seen for key in keys], bool)


def meet(regions: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, Shard()
        for batch in batches:
            rows = [batch.column(i).to_pylist() for i in (2, 3, 4, 5, 6, 8)]
            for t in kernel.texts(batch.column(7), repeats.PIECE):
                symbols, _, _, first = UNIT.symbols(t)
                at, place, _ = UNIT.anchors(symbols, first)
                sums = kernel.prefix_sums(symbols)
                hashes = kernel.run_hash(sums, at, at + SIZE)
                cut = np.searchsorted(at, first)
                for i in range(len(t)):
                    hot, is_first, doc_id, digest, start, number = (x[t.first + i] for x in rows)
                    if key != number:
                        key, shard = number, Shard()
                    own = slice(cut[i], cut[i + 1])
                    words = t.bytes_of(i).split()
                    if is_first:
                        shard.learn(words, np.unique(place[own] - first[i]), hashes[own])
                        continue
                    starts, keys = shard.located(words, hashes[own])
                    known = shard.known(doc_id, keys.tolist(), keep=not hot)
                    spans = repeats.merged(starts[known] + start, SIZE)
                    if spans:
                        yield repeats.found_spans(doc_id, digest, spans)
                    if hot and len(left := starts[~known] + cut[i]):
                        yield repeats.left_over(doc_id, digest, UNIT, sums, at[left], place[left], hashes[left], int(first[i]), start)

    return regions.mapInArrow(repeats.gathered(run), repeats.FOUND)


def finished(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads, spans = batch.column(2).to_pylist(), batch.column(3)
            out = []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = text.split()
                removed = repeats.union_of(spans[i]) if leads[i] else [(0, len(words))] if len(words) >= SIZE else []
                kept, done = [], 0
                for a, b in removed:
                    kept += words[done:a]
                    done = b
                kept += words[done:]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                n, gone, sha = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", "leads", "spans").mapInArrow(run, RESULT)


def word_spans(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prepared rows, and the spans of words of each that texts with smaller ids have."""
    rows = repeats.prepared(documents)
    order = [F.desc("is_first"), F.asc_nulls_last("doc_id"), "digest", "start"]
    later = F.col("lead").isNotNull() & (F.col("doc_id").isNull() | (F.col("lead") < F.col("doc_id")))
    return rows, repeats.covered(rows, UNIT, (F.col("n_texts") > 1) & (F.col("first") != repeats.NO_ID), order, meet, later)


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    rows, spans = word_spans(documents)
    return finished(repeats.with_spans(rows, spans))


def op8_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_phrase_automata": op8_phrase_automata}
