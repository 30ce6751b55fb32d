"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance."""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.shared import id_and_text, slices

#: Characters of test items that one broadcast holds; more items are matched in several passes.
BLOCK_CHARS = 8 << 20
#: Length of the grams that a window must share with an item before its distance is computed.
Q = 3
#: ASCII letters in lower case, punctuation as spaces.
PLAIN = bytes.maketrans((string.punctuation + string.ascii_uppercase).encode(), (" " * len(string.punctuation) + string.ascii_lowercase).encode())


def normalise(text: bytes) -> str:
    """A-Z in lower case, ASCII punctuation and white space as single spaces."""
    return b" ".join(text.translate(PLAIN).split()).decode()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces with their offsets: an edit spoils one of them at most."""
    edges = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def best_match(item: str, window: str) -> tuple[int, int]:
    """Least edit distance of the item to any part of the window and that part's end (Myers' bit vectors)."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    best = (score, 0)
    for end, c in enumerate(window, 1):
        equal = masks.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus = down | ~(horizontal | up)
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1, minus << 1
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical & full
        if score < best[0]:
            best = (score, end)
    return best


class Matcher:
    """Finds a block of test items in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str, int]]) -> None:
        self.items = items
        self.grams = [Counter(text[i : i + Q] for i in range(len(text) - Q + 1)) for _, text, _ in items]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, budget) in enumerate(items):
            for offset, piece in pieces(text, budget):
                where[piece].append((n, offset))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def _may_match(self, n: int, window: str) -> bool:
        """Each edit spoils Q grams of the item at most; all others stand in the window."""
        there = {window[i : i + Q] for i in range(len(window) - Q + 1)}
        missing = sum(count for gram, count in self.grams[n].items() if gram not in there)
        return missing <= Q * self.items[n][2]

    def find(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item id, least distance, places) of each item within its budget."""
        starts: dict[int, set[int]] = defaultdict(set)
        if len(self.automaton):
            for end, (length, places) in self.automaton.iter(text):
                for n, offset in places:
                    starts[n].add(end + 1 - length - offset)
        found = []
        for n, own in starts.items():
            item_id, item, budget = self.items[n]
            hits: dict[int, int] = {}
            ordered = sorted(own)
            at = 0
            while at < len(ordered):
                # a match with this start begins within the budget of it; near starts share a window
                first = last = ordered[at]
                while at < len(ordered) and ordered[at] <= first + budget:
                    last = ordered[at]
                    at += 1
                low = max(0, first - budget)
                window = text[low : last + len(item) + budget]
                if self._may_match(n, window):
                    distance, end = best_match(item, window)
                    if distance <= budget:
                        hits[low + end] = distance
            if hits:
                found.append((item_id, min(hits.values()), len(hits)))
        return found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, rate: float) -> Iterator[list[tuple[int | None, str, int]]]:
    block, size = [], 0
    for row in id_and_text(benchmark, id_col, text_col).toLocalIterator():
        text = normalise(row["text"].encode())
        if text:
            block.append((row["id"], text, int(rate * len(text))))
            size += len(text)
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = 0.08,
) -> DataFrame:
    """(id, item, distance, places) for each document and test item that it holds.

    A-Z are lower-cased, ASCII punctuation and white space become single spaces in both. An item is
    held if a part of the document is within int(error_rate * its length) edits of it; distance is
    the least found and places the number of distinct ends. Items are split in one piece more than
    they may have edits, so that one piece is found unchanged; each hit is verified. Items go to the
    executors in blocks of a bounded size, each with a pass over the documents; nothing is
    shuffled. Null and empty items are in no document, null and empty texts hold none; very long
    texts are searched whole, one at a time; repeated rows and repeated items are each matched, and
    null ids are passed on. Empty tables give none. Other columns play no part.
    """
    context = docs.sparkSession.sparkContext

    def one_pass(block: list[tuple[int | None, str, int]]) -> DataFrame:
        sent = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                for part in slices(batch):
                    rows = [
                        (doc, *hit)
                        for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)
                        for hit in matcher.find(normalise(text))
                    ]
                    columns = list(zip(*rows, strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "item", "distance", "places"])

        return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, item long, distance long, places long")

    return reduce(DataFrame.unionByName, (one_pass(b) for b in _blocks(benchmark, item_id_col, item_text_col, error_rate)))


def is_contaminated(benchmark: DataFrame, text: F.Column, item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.08) -> F.Column:
    """Whether a text holds any test item, as a column: a filter that moves no documents.

    Matches as contamination does. Null and empty texts hold none, and null and empty items are in
    no text; without items no text holds any. Very long texts are searched whole, one at a time;
    repeated rows are each judged; no column but the text plays a part.
    """
    context = benchmark.sparkSession.sparkContext

    def one_pass(block: list[tuple[int | None, str, int]]) -> F.Column:
        sent = context.broadcast(block)
        kept: list[Matcher] = []

        @F.arrow_udf("boolean")
        def holds(texts: pa.Array) -> pa.Array:
            if not kept:
                kept.append(Matcher(sent.value))
            texts = texts.fill_null("")
            parts = [
                pa.array([bool(t) and bool(kept[0].find(normalise(t))) for t in part.column(0).cast(pa.binary()).to_pylist()], pa.bool_())
                for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), text_at=0)
            ]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())

        return holds(text)

    return reduce(lambda a, b: a | b, (one_pass(b) for b in _blocks(benchmark, item_id_col, item_text_col, error_rate)))
