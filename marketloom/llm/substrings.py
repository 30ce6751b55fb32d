"""Substring dedup by a relative Lempel-Ziv parse against content-defined blocks of the whole corpus.

The reference is the corpus itself. Every text is cut in blocks at places that its content alone
decides, so that equal passages fall into equal blocks wherever they stand: each window of
``window`` words has an anchor, the least of its word grams, and a block is the run of windows
with one anchor. The index holds every block under its anchor. A document is then parsed from left
to right: a factor starts at the first window that the index holds elsewhere and is lengthened
greedily, by whole blocks where all blocks of an anchor are alike, and else, at its boundary, word
by word while the next window is found; what lies between factors is literal. A factor is at least
one window long and is a duplicate span. Equal windows have equal anchors, so that no other window
can be equal.

A block is known by its anchor and its content, a window by 96 bits, so that even 10 ** 13 windows
are mistaken for each other with probability below 0.001.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.lines import NO_ID
from marketloom.llm.shared import id_and_text, slices, words_of

#: Words of an anchor.
GRAM = 10
#: Odd bases of the two polynomial hashes modulo 2**64.
BASE, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Blocks:
    """Blocks of several texts: document, first and last window's place, anchor and content hash."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


class Corpus:
    """Words of several texts with hashes of any of their spans."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        self.window = window
        self.words, self.counts = words_of(texts)
        coded = self.words.dictionary_encode()
        own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], dtype=np.uint64)
        n = len(self.words)
        self.hashes = own[np.asarray(coded.indices)] if n else np.zeros(0, dtype=np.uint64)
        self.sums, self.inverse = self._sums(self.hashes, BASE)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        ends = np.cumsum(self.counts)
        place = np.arange(n)
        self.starts = place[: max(0, n - window + 1)]
        if len(self.starts):
            self.starts = self.starts[self.starts + window <= ends[self.doc[self.starts]]]

    @staticmethod
    def _sums(hashes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the hashes times powers of an odd base, and the inverse powers: a span's difference times one of these is its hash."""
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * _powers(base, len(hashes))[: len(hashes)], out=sums[1:])
        return sums, _powers(pow(base, -1, 1 << 64), len(hashes))

    @cached_property
    def second(self) -> tuple[np.ndarray, np.ndarray]:
        return self._sums(_mix(self.hashes ^ np.uint64(SECOND)), SECOND)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def blocks(self) -> Blocks:
        starts = self.starts
        if not len(starts):
            none = np.zeros(0, dtype=np.int64)
            return Blocks(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
        gram = min(GRAM, self.window)
        n = len(self.words) - gram + 1
        grams = self.span(np.arange(n), np.arange(n) + gram)
        # sliding minimum and its leftmost place, over 1, 2, 4, ... grams and at last all of a window's
        wide, size = self.window - gram + 1, 1
        least, at = grams, np.arange(n)
        while size < wide:
            step = min(size, wide - size)
            left, right = least[:-step], least[step:]
            keep = left <= right
            least, at = np.where(keep, left, right), np.where(keep, at[:-step], at[step:])
            size += step
        anchors = at[starts]
        fresh = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (np.diff(starts) != 1)])
        head = np.flatnonzero(fresh)
        tail = np.concatenate([head[1:], [len(starts)]]) - 1
        first, last = starts[head], starts[tail]
        content = self.span(first, last + self.window) ^ _mix((last - first).astype(np.uint64))
        return Blocks(self.doc[first], first, last, grams[anchors[head]], content)


def _windows(corpus: Corpus, blocks: Blocks, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, place, key) of every window of the chosen blocks."""
    sizes = (blocks.last - blocks.first + 1)[chosen]
    block = np.repeat(chosen, sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + blocks.first[block]
    return block, place, _mix(corpus.span(place, place + corpus.window) ^ blocks.anchor[block])


def checks(corpus: Corpus, place: np.ndarray) -> np.ndarray:
    """32 further bits of the windows that start at the places."""
    sums, inverse = corpus.second
    return (_mix((sums[place + corpus.window] - sums[place]) * inverse[place]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def factors(corpus: Corpus, blocks: Blocks, alike: np.ndarray, singles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, word behind the last) of the greedy parse's factors.

    alike: anchors whose blocks are found elsewhere as a whole; singles: keys of single windows found
    elsewhere. A factor goes on while the window that starts at its next word is found.
    """
    whole = np.isin(blocks.anchor, alike)
    sizes = (blocks.last - blocks.first + 1)[whole]
    places = np.repeat(blocks.first[whole], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if len(singles):
        _, place, key = _windows(corpus, blocks, np.flatnonzero(~whole))
        places = np.sort(np.concatenate([places, place[np.isin(key, singles)]]))
    doc = corpus.doc[places]
    # a window found right behind another lengthens its factor by a word
    new = np.append(True, (np.diff(places) > 1) | (doc[1:] != doc[:-1])) if len(places) else np.zeros(0, dtype=bool)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(places))[: len(heads)] - 1
    return doc[heads], places[heads], places[tails] + corpus.window


def _tally(doc: np.ndarray, key: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (doc, key) with their counts and, of each further column, the least and greatest."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([head, [len(doc)]]))
    spread = [f(c[order], head) if len(head) else c[:0] for c in more for f in (np.minimum.reduceat, np.maximum.reduceat)]
    return doc[head], key[head], counts, *spread


def _lists(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).view(np.uint64)


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(k, whole, single) for each document: anchors whose blocks are all alike and found again, and keys of single windows found again."""
    rows = id_and_text(docs, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(NO_ID)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = Corpus(part.column(1), window).blocks()
                doc, anchor, n, least, most = _tally(found.doc, found.anchor, found.content)
                columns = [part.column(0).take(pa.array(doc)), *(pa.array(c.view(np.int64)) for c in (anchor, n, least, most))]
                yield pa.RecordBatch.from_arrays(columns, ["k", "anchor", "n", "least", "most"])

    entries = rows.mapInArrow(index, "k long, anchor long, n long, least long, most long")
    again = entries.groupBy("anchor").agg(F.sum("n").alias("n"), (F.min("least") == F.max("most")).alias("alike")).where("n > 1")
    matched = entries.select("k", "anchor").join(again.select("anchor", "alike"), "anchor")
    matched = matched.groupBy("k").agg(
        F.collect_set(F.when(F.col("alike"), F.col("anchor"))).alias("whole"),
        F.collect_set(F.when(~F.col("alike"), F.col("anchor"))).alias("edge"),
    )
    parsed = rows.select(F.col("id").alias("k"), "text").join(matched, "k", "left")

    def boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                corpus = Corpus(part.column(1), window)
                found = corpus.blocks()
                chosen = np.flatnonzero(np.isin(found.anchor, _lists(part.column(2))))
                block, place, key = _windows(corpus, found, chosen)
                # equal keys of one document are taken for one window
                doc, key, n, check, _ = _tally(found.doc[block], key, checks(corpus, place))
                columns = [part.column(0).take(pa.array(doc)), pa.array(key.view(np.int64)), pa.array(check), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["k", "key", "check", "n"])

    edges = parsed.where(F.size("edge") > 0).select("k", "text", "edge").mapInArrow(boundary, "k long, key long, check int, n long")
    twice = edges.groupBy("key", "check").agg(F.sum("n").alias("n")).where("n > 1").select("key", "check")
    single = edges.select("k", "key", "check").join(twice, ["key", "check"]).groupBy("k").agg(F.collect_set("key").alias("single"))
    return matched.select("k", "whole").join(single, "k", "left")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, stats_col: str = "substring_dedup") -> DataFrame:
    """The table with its text cut, and a struct stats_col (n_words, n_removed).

    Words are runs of anything but ASCII white space. Every word that some window of so many
    words of one row covers is removed if the window's words also start anywhere else, in the same
    row or another; windows are judged on the input. The words left are joined by one space. Null
    and empty texts have no words; repeated rows and rows with equal or null ids count as so many
    places. Texts of any length are taken whole. An empty table stays empty; all other columns are passed on,
    but a column named as stats_col is replaced.
    """
    matched = repeated_windows(docs, id_col, text_col, window)

    @F.arrow_udf("text string, n_words long, n_removed long")
    def cut(text: pa.Array, whole: pa.Array, single: pa.Array) -> pa.Array:
        texts, totals, removed = [], [], []
        batch = pa.RecordBatch.from_arrays([whole, text.fill_null(""), single], ["whole", "text", "single"])
        for part in slices(batch):
            corpus = Corpus(part.column(1), window)
            found = corpus.blocks()
            n = len(corpus.words)
            depth = np.zeros(n + 1, dtype=np.int32)
            _, first, behind = factors(corpus, found, _lists(part.column(0)), _lists(part.column(2)))
            np.add.at(depth, first, 1)
            np.add.at(depth, behind, -1)
            keep = np.cumsum(depth[:n]) == 0
            kept = np.bincount(corpus.doc[keep], minlength=len(corpus.counts))
            offsets = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            words = corpus.words.filter(pa.array(keep)) if n else corpus.words
            texts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), " "))
            totals.append(corpus.counts)
            removed.append(corpus.counts - kept)
        if not texts:
            return pa.array([], pa.struct([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())]))
        return pa.StructArray.from_arrays([pa.concat_arrays(texts), pa.array(np.concatenate(totals)), pa.array(np.concatenate(removed))], ["text", "n_words", "n_removed"])

    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"))
    done = rows.join(matched, "k", "left").select("row", cut(F.col("row")[text_col], F.col("whole"), F.col("single")).alias("cut"))
    stats = F.struct("cut.n_words", "cut.n_removed").alias(stats_col)
    columns = [c for c in docs.columns if c != stats_col]
    return done.select(*(F.col("cut.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns), stats)
