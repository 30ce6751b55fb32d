"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.shared import bytes_of, id_and_text, materialise, read_bounded, slices

#: ASCII white space, and the last bytes of UTF-8's other characters with the Unicode property White_Space (fixed values).
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WIDE_WHITE = ["\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
#: Chunks whose ids a Python worker remembers in each of two generations, and the longest of them.
REMEMBERED, LONGEST = 200_000, 64
#: Chunks that are looked up and joined at once.
RUN = 1 << 20
#: Text bytes that are cut in chunks at once.
WORK_BYTES = 4 << 20


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Marks of the places where white space follows something else: byte-level merges never cross them."""
    white = WHITE[data]
    marks = np.zeros(len(data), dtype=bool)
    marks[1:] = white[1:] & ~white[:-1]
    at = np.flatnonzero(marks)
    at = at[data[at - 1] >= 0x80]
    for wide in {w.encode() for w in WIDE_WHITE}:
        ends = at[at >= len(wide)]
        same = np.ones(len(ends), dtype=bool)
        for back, byte in enumerate(reversed(wide), 1):
            same &= data[ends - back] == byte
        marks[ends[same]] = False
    return marks


class ChunkTokenizer:
    """Ids of whole texts; a chunk of white space and a word is encoded once while it is remembered."""

    def __init__(self, model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks. A word's marks are encoded apart: a letter's token never takes in the mark behind it."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = list(map(known.get, chunks))
        missing = [at for at, ids in enumerate(found) if ids is None]
        stems, asked = [], {}
        for at in missing:
            chunk = chunks[at]
            stem = chunk.rstrip(b".,!")
            if len(stem) < len(chunk) and stem[-1:].isalpha():
                asked[chunk[len(stem) :]] = None
            else:
                stem = chunk
            stems.append(stem)
            asked[stem] = None
        fresh = []
        for part in asked:
            if part not in known:
                ids = older.get(part)
                if ids is None:
                    fresh.append(part)
                else:
                    known[part] = ids
        known.update(zip(fresh, self._ids([p.decode() for p in fresh]), strict=True))
        for at, stem in zip(missing, stems, strict=True):
            chunk = chunks[at]
            found[at] = known[stem] if len(stem) == len(chunk) else known[stem] + known[chunk[len(stem) :]]
        for part in fresh:
            if len(part) > LONGEST:
                del known[part]
        known.update((chunks[at], found[at]) for at in missing if len(chunks[at]) <= LONGEST)
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        first = int(offsets[0])
        data = np.frombuffer(body, dtype=np.uint8)[first : offsets[-1]] if body else np.zeros(0, dtype=np.uint8)
        offsets = offsets - first
        marks = chunk_starts(data)
        marks[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.append(np.flatnonzero(marks), len(data))
        heads = np.searchsorted(starts, offsets)
        blob, buffer = [], body.slice(first) if body else pa.py_buffer(b"")
        before = np.zeros(len(starts), dtype=np.int64)
        for lo in range(0, len(starts) - 1, RUN):
            own = starts[lo : lo + RUN + 1]
            chunks = pa.Array.from_buffers(pa.large_binary(), len(own) - 1, [None, pa.py_buffer(own.astype(np.int64)), buffer])
            coded = chunks.dictionary_encode()
            ids = self.chunks(bytes_of(coded.dictionary))
            # the ids of each chunk in turn, gathered as bytes
            taken = pa.array(ids, pa.large_binary()).take(coded.indices)
            ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(own)]
            blob.append(taken.buffers()[2].to_pybytes()[: ends[-1]])
            before[lo + 1 : lo + len(own)] = before[lo] + ends[1:]
        whole = b"".join(blob)
        cuts = before[heads].tolist()
        found = [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        # texts that name an added token are rare and are encoded whole
        for token in self.added:
            for row in np.flatnonzero(np.asarray(pc.match_substring(texts, token))):
                found[row] = self._ids([texts[int(row)].as_py().decode()])[0]
        return found


@lru_cache(maxsize=1)
def _tokenizer(model: bytes) -> ChunkTokenizer:
    return ChunkTokenizer(model)


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of the full capacity but for the first."""
    first = total % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, total, capacity)] if total > capacity else [(0, total)]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    """(part, id, piece, start, length, ids_crc32, place[, ids]): place counts the pieces of one length in one partition."""
    model = docs.sparkSession.sparkContext.broadcast(read_bounded(tokenizer_path))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(model.value)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for some in slices(batch, most=WORK_BYTES):
                rows, ids = [], []
                for doc, tokens in zip(some.column(0).to_pylist(), tokenizer.encode(some.column(1)), strict=True):
                    tokens += end
                    for piece, (start, length) in enumerate(cut_points(len(tokens) // 4, capacity)):
                        own = tokens[4 * start : 4 * (start + length)]
                        rows.append((part, doc, piece, start, length, zlib.crc32(own), int(seen[length])))
                        seen[length] += 1
                        if with_ids:
                            ids.append(np.frombuffer(own, dtype="<i4"))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, NAMES + ["ids"] * with_ids)

    schema = "part int, id long, piece int, start long, length long, ids_crc32 long, place long" + ", ids array<int>" * with_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


NAMES = ["part", "id", "piece", "start", "length", "ids_crc32", "place"]
TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): where runs of pieces of one length go.

    Best fit, longest first, over counts: sequences with equal space left are kept as runs of
    numbers, and a run of equal pieces fills the tightest runs that still hold it. The work and the
    plan depend on the capacity, not on the number of documents.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []

    def put(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in open_runs:
                open_runs[space] = []
                insort(spaces, space)
            open_runs[space].append((first, count))

    fresh = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                new = -(-left // (capacity // length))
                put(capacity, fresh, new)
                fresh += new
                continue
            space = spaces[at]
            first, count = open_runs[space].pop()
            if not open_runs[space]:
                del open_runs[space], spaces[at]
            each = space // length
            full = min(count, left // each)
            for run, pieces in ((full, each), (1, left) if full < count and left < each * (full + 1) else (0, 0)):
                if not run or not left:
                    continue
                pieces = min(pieces, left // run)
                plan += [(length, rank + i * run, run, first, capacity - space + i * length) for i in range(pieces)]
                rank += run * pieces
                left -= run * pieces
                put(space - pieces * length, first, run)
                first, count = first + run, count - run
            put(space, first, count)
    return plan


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """A row for each piece: (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    A document's ids and one end id are one piece if they fit in a sequence, else they are cut in
    full pieces, of which the first may be shorter. Lengths are counted, best-fit plans sequences
    for the counts alone, and pieces take the planned slots by their rank among the pieces of
    their length. Ranks come from the counts of each partition and length, so that no length is a
    single group. A null or empty text is just its end id; the string of a token that the
    tokenizer's file adds (as <|endoftext|>) is that token, as its own call gives it. Repeated ids and null ids are packed row by row; an empty table gives none.
    Other columns play no part.
    """
    pieces = materialise(token_pieces(docs, tokenizer_path, id_col, text_col, end_id, capacity, with_ids))
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(sorted(best_fit(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    slots = docs.sparkSession.sparkContext.broadcast(plan)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.arrow_udf("sequence_id long, offset long")
    def slot(length: pa.Array, rank: pa.Array) -> pa.Array:
        table, of_length, ranks = slots.value, np.asarray(length), np.asarray(rank)
        sequence, offset = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
        for one in np.unique(of_length):
            own = table[np.searchsorted(table[:, 0], one) : np.searchsorted(table[:, 0], one, side="right")]
            rows = np.flatnonzero(of_length == one)
            at = np.searchsorted(own[:, 1], ranks[rows], side="right") - 1
            sequence[rows] = own[at, 3] + ranks[rows] - own[at, 1]
            offset[rows] = own[at, 4]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).withColumn("slot", slot("length", F.col("before") + F.col("place")))
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset", *["ids"] * with_ids)
