"""Cross-tokenizer alignment: which tokens of two tokenizers overlap, and in how many documents a pair does."""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import tallies
from marketloom.llm.packing import chunk_starts
from marketloom.llm.shared import bytes_of, id_and_text, materialise, read_bounded, slices, written

#: Chunks that a Python worker remembers in each of two generations, and the longest of them.
REMEMBERED, LONGEST = 100_000, 64
#: Text bytes that are encoded at once.
WORK_BYTES = 2 << 20
#: Buckets by which A ids are dealt; a pair's bucket is that of its A id.
BUCKETS = 512
#: Distinct pairs that a task counts before it hands them on.
COUNTED = 4 << 20
#: Pairs whose index and counts are broadcast at once (about 16 bytes each); more are looked up in several passes.
SHARD_PAIRS = 6 << 20
#: Entries of a block of a dense vector, and into how many sums a block's vectors are brought before the last one.
BLOCK, BRANCHES = 1 << 16, 16
#: Bits of a level of the hash for each key that is left.
ROOM = 2
#: How sentencepiece writes a space, and the text before a chunk that keeps its own spaces as they are.
SPACE, LEAD = "▁", "x"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, all others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Aligned chunks of white space and a word; a chunk is encoded once while it is remembered.

    Texts may be cut where white space follows something else: tokenizer A splits words there, and no
    piece of B has that white space behind another character (what its vocabulary has is not cut at).
    Tokens of both end at each cut, so that groups and links never cross one.
    """

    def __init__(self, a_model: bytes, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        of_a = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(map(letters.__getitem__, of_a[i])) if set(of_a.get(i, " ")) <= letters.keys() else of_a.get(i, "").encode() for i in range(max(of_a) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.a_size = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        pieces = [self.b.id_to_piece(i).replace(SPACE, " ") for i in range(self.b.get_piece_size()) if not self.b.is_byte(i)]
        inner = {(p[i - 1], p[i]) for p in pieces for i in range(1, len(p))}
        bad = {y for x, y in inner if y in "\t\n\x0b\x0c\r " and x not in "\t\n\x0b\x0c\r "}
        if " " in bad:
            raise ValueError("pieces of B cross words")
        #: White space at which texts are not cut.
        self.uncut = np.isin(np.arange(256), [ord(c) for c in bad])
        #: A word's marks are aligned apart where no piece of B takes in both.
        self.apart = not any(x.isalpha() and y in ".,!" for x, y in inner)
        self.lead = self.b.encode(LEAD)
        self.a_text, self.b_text = pa.array(self.a_bytes, pa.large_binary()), pa.array(self.b_bytes, pa.large_binary())
        #: An id as text: of A before another A id and before B, of B before another B id and at a group's end.
        self.printed = pa.array([f"{i}{mark}".encode() for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|,;"], pa.large_binary())
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def _fresh(self, parts: list[bytes]) -> list[tuple[bytes, bytes]]:
        texts = [p.decode() for p in parts]
        skip = len(self.lead)
        a = [array("H", e.ids).tobytes() for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [array("H", ids[skip:]).tobytes() for ids in self.b.encode([LEAD + t for t in texts], num_threads=1)]
        return list(zip(a, b, strict=True))

    def chunks(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids (16 bits each) of distinct chunks by A and B."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = list(map(known.get, chunks))
        missing = [at for at, ids in enumerate(found) if ids is None]
        stems, asked = [], {}
        for at in missing:
            chunk = chunks[at]
            stem = chunk.rstrip(b".,!") if self.apart else chunk
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
        known.update(zip(fresh, self._fresh(fresh), strict=True))
        for at, stem in zip(missing, stems, strict=True):
            chunk, own = chunks[at], known[stem]
            if len(stem) < len(chunk):
                marks = known[chunk[len(stem) :]]
                own = own[0] + marks[0], own[1] + marks[1]
            found[at] = own
        for part in [p for p in fresh if len(p) > LONGEST]:
            del known[part]
        known.update((chunks[at], found[at]) for at in missing if len(chunks[at]) <= LONGEST)
        return found

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The texts, each with a space before it, as ids of both tokenizers (16 bits each); none where these do not give back the text."""
        texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string())).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first = int(offsets[0])
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first : offsets[-1]]
        offsets = offsets - first
        marks = chunk_starts(data) & ~self.uncut[data]
        marks[offsets[:-1]] = True
        starts = np.append(np.flatnonzero(marks), len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), texts.buffers()[2].slice(first)])
        coded = pieces.dictionary_encode()
        found = self.chunks(bytes_of(coded.dictionary))
        heads = np.searchsorted(starts, offsets)
        (a, a_at), (b, b_at) = (self._gathered([x[i] for x in found], coded.indices, heads) for i in (0, 1))
        valid = (np.diff(offsets) > 1) & self._given_back(a, a_at, self.a_text, data, offsets) & self._given_back(b, b_at, self.b_text, data, offsets)
        return _packed(a, a_at, valid), _packed(b, b_at, valid)

    @staticmethod
    def _gathered(ids: list[bytes], codes: pa.Array, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in turn, and where each text's begin and end."""
        taken = pa.array(ids, pa.large_binary()).take(codes)
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(codes) + 1]
        return np.frombuffer(taken.buffers()[2], dtype=np.uint16)[: ends[-1] // 2].astype(np.int64), ends[heads] // 2

    @staticmethod
    def _given_back(ids: np.ndarray, at: np.ndarray, tokens: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the tokens' bytes put together again."""
        taken = tokens.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(ids) + 1][at]
        made = np.frombuffer(taken.buffers()[2], dtype=np.uint8)[: ends[-1]]
        same = np.diff(ends) == np.diff(offsets)
        if not same.all() or not np.array_equal(made, data):
            for i in np.flatnonzero(same).tolist():
                same[i] = np.array_equal(made[ends[i] : ends[i + 1]], data[offsets[i] : offsets[i + 1]])
        return same


@lru_cache(maxsize=1)
def _aligner(a_model: bytes, b_model: bytes) -> Aligner:
    return Aligner(a_model, b_model)


def _packed(ids: np.ndarray, at: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The ids of each valid text as bytes."""
    sizes = np.diff(at)
    kept = ids if valid.all() else ids[np.repeat(valid, sizes)]
    ends = np.append(0, np.cumsum(np.where(valid, sizes, 0))) * 2
    return pa.Array.from_buffers(pa.large_binary(), len(valid), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept.astype("<u2").tobytes())]).cast(pa.binary())


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in turn, and each text's number of them."""
    sizes = np.asarray(pc.binary_length(column), dtype=np.int64) // 2
    start = int(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset])
    data = column.buffers()[2]
    return np.frombuffer(data, dtype="<u2", count=int(sizes.sum()), offset=start).astype(np.int64) if data and sizes.sum() else np.zeros(0, dtype=np.int64), sizes


class Slice:
    """Some texts' tokens side by side. a, b: all ids in turn; n_a, n_b: each text's number of them, 0 where it has none."""

    def __init__(self, aligner: Aligner, of_a: pa.Array, of_b: pa.Array) -> None:
        self.aligner = aligner
        (self.a, self.n_a), (self.b, self.n_b) = _unpacked(of_a), _unpacked(of_b)
        self.valid = self.n_a > 0
        a, b, n_a = self.a, self.b, self.n_a
        # valid texts follow each other: tokens of both end where a text does
        ends_a, ends_b = np.cumsum(aligner.a_size[a]), np.cumsum(aligner.b_size[b])
        total = int(ends_a[-1]) if len(a) else 0
        of_a, of_b = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
        of_a[ends_a], of_b[ends_b] = True, True
        self.shut_a, self.shut_b = of_b[ends_a], of_a[ends_b]
        # the first B token that ends where an A token ends or behind it, and the one in which the A token begins
        last = np.cumsum(of_b)[ends_a] - self.shut_a
        first = np.append(0, (last + self.shut_a)[:-1])[: len(a)]
        n = last - first + 1
        before = np.cumsum(n) - n
        self.pairs = np.repeat(a, n) << 16 | b[np.repeat(first - before, n) + np.arange(n.sum())]
        self.n_links = self._by_text(n, n_a)
        self.n_groups = self._by_text(self.shut_a, n_a)

    @staticmethod
    def _by_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        running = np.append(0, np.cumsum(values, dtype=np.int64))
        at = np.append(0, np.cumsum(sizes))
        return running[at[1:]] - running[at[:-1]]

    def link_sums(self, of_link: np.ndarray) -> np.ndarray:
        return self._by_text(of_link, self.n_links)

    def distinct_pairs(self) -> np.ndarray:
        """Each text's distinct pairs."""
        own = np.repeat(np.arange(len(self.valid)), self.n_links) << 32 | self.pairs
        own.sort()
        return own[np.append(True, own[1:] != own[:-1])] & 0xFFFFFFFF if len(own) else own

    def group_texts(self) -> tuple[memoryview, np.ndarray]:
        """The groups' text of all texts in turn, each group with a semicolon behind it, and where each text's begins and ends."""
        a_before, b_before = (np.cumsum(x) - x for x in (self.shut_a, self.shut_b))
        a_ends, b_ends = np.append(0, np.flatnonzero(self.shut_a) + 1), np.append(0, np.flatnonzero(self.shut_b) + 1)
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        # a group's A tokens come first: before them all earlier groups' B tokens, before its B tokens its own A tokens too
        order[np.arange(len(self.a)) + b_ends[a_before]] = 4 * self.a + self.shut_a
        order[np.arange(len(self.b)) + a_ends[b_before + 1]] = 4 * self.b + 2 + self.shut_b
        taken = self.aligner.printed.take(pa.array(order))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(order) + 1]
        return memoryview(taken.buffers()[2]) if taken.buffers()[2] else memoryview(b""), ends[np.append(0, np.cumsum(self.n_a + self.n_b))]


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of whole numbers."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def bucket_of(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs >> 16, 0) % np.uint64(BUCKETS)).astype(np.int64)


def perfect_levels(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A minimal perfect hash of distinct keys: (64-bit words, keys) of each level.

    A key has a bit in each level; those that are alone at theirs are placed there and the others go
    on to the next. A placed key's index is the number of bits set before its own.
    """
    levels = []
    while len(keys):
        size = -(-ROOM * len(keys) // 64) * 64
        at = (mixed(keys, len(levels) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, dtype=bool)
        bits[at[alone]] = True
        own = keys[alone]
        levels.append((np.packbits(bits, bitorder="little").view("<u8"), own[np.argsort(at[alone])]))
        keys = keys[~alone]
    return levels


class PairIndex:
    """The hash of all pairs of some buckets, with their keys: numbers from 0 on, -1 for what is no such pair."""

    def __init__(self, rows: list[tuple[int, int, bytes, bytes]]) -> None:
        """rows: bucket, level, words, keys."""
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        self.levels = 1 + max((r[1] for r in rows), default=-1)
        self.size = np.zeros((self.levels, BUCKETS), dtype=np.uint64)
        self.base = np.zeros((self.levels, BUCKETS), dtype=np.int64)
        at = 0
        for bucket, level, words, _ in rows:
            self.size[level, bucket], self.base[level, bucket] = 8 * len(words), at
            at += 8 * len(words)
        self.words = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u8")
        self.keys = np.frombuffer(b"".join(r[3] for r in rows), dtype="<u4")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        out, left, bucket = np.full(len(pairs), -1, dtype=np.int64), np.arange(len(pairs)), bucket_of(pairs)
        for level in range(self.levels):
            left = left[self.size[level, bucket[left]] > 0]
            own = bucket[left]
            at = self.base[level, own] + (mixed(pairs[left], level + 1) % self.size[level, own]).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            index = (self.before[at >> 6] + below)[hit]
            same = self.keys[index] == pairs[left[hit]]
            out[left[hit][same]] = index[same]
            left = left[~hit]
        return out


@dataclass
class Counts:
    """Pairs of a shard with their dense vector of counts."""

    index: PairIndex
    vector: np.ndarray

    def __post_init__(self) -> None:
        a = self.index.keys >> 16
        most = np.zeros(1 << 16, dtype=np.int64)
        np.maximum.at(most, a, self.vector)
        self.best = self.vector == most[a]

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts, and which are their A id's highest; 0 for pairs of other shards."""
        at = self.index.find(pairs)
        return np.where(at >= 0, self.vector[at], 0), (at >= 0) & self.best[at]


@lru_cache(maxsize=1)
def _counts(shared: Broadcast) -> Counts:
    rows, blocks = shared.value
    index = PairIndex(rows)
    return Counts(index, _assembled(blocks, len(index.keys)))


def _assembled(blocks: list[tuple[int, bytes]], n: int) -> np.ndarray:
    vector = np.zeros(n, dtype=np.int64)
    for block, data in blocks:
        vector[block * BLOCK : (block + 1) * BLOCK] = tallies.unpack(data)
    return vector


def encoded(docs: DataFrame, models: Broadcast) -> DataFrame:
    """(id, a, b): every text's ids by both tokenizers as bytes, empty where it has no tokens. docs: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*models.value)
        for batch in batches:
            for part in slices(batch, most=WORK_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), *aligner.encode(part.column(1))], ["id", "a", "b"])

    return docs.mapInArrow(run, "id long, a binary, b binary")


def pair_parts(coded: DataFrame, models: Broadcast) -> DataFrame:
    """(bucket, keys, counts): each task's distinct pairs with the number of its documents that hold them linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, tally = _aligner(*models.value), tallies.Tally()
        for batch in batches:
            for part in slices(batch, text_at=0):
                tally.add(Slice(aligner, part.column(0), part.column(1)).distinct_pairs())
                if len(tally.keys) > COUNTED:
                    keys, counts = tally.fold()
                    yield tallies.blocks(keys, counts, bucket_of(keys))
                    tally = tallies.Tally()
        keys, counts = tally.fold()
        yield tallies.blocks(keys, counts, bucket_of(keys))

    return coded.select("a", "b").mapInArrow(count, tallies.SCHEMA)


def hashed_pairs(parts: DataFrame) -> DataFrame:
    """(bucket, level, words, keys, n): the minimal perfect hash of each bucket's distinct pairs. A bucket has the pairs of one in 512 A ids."""

    def rows(bucket: int, keys: np.ndarray) -> pa.RecordBatch:
        levels = perfect_levels(keys)
        columns = [[bucket] * len(levels), range(len(levels)), [w.tobytes() for w, _ in levels], [k.astype("<u4").tobytes() for _, k in levels], [len(k) for _, k in levels]]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["bucket", "level", "words", "keys", "n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and now is not None:
                    yield rows(now, keys)
                    keys = keys[:0]
                now = bucket
                keys = np.union1d(keys, np.cumsum(tallies.unpack(data)))
        if now is not None:
            yield rows(now, keys)

    dealt = parts.select("bucket", "keys").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(build, "bucket int, level int, words binary, keys binary, n long")


def tree_summed(parts: DataFrame, shared: Broadcast) -> list[tuple[int, bytes]]:
    """(block, packed counts) of the dense vector of a shard's pairs: each task adds up one of its own, and these are summed block by block in two steps."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PairIndex(shared.value)
        vector = np.zeros(len(index.keys), dtype=np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keys, counts = tallies.opened(keys, counts)
                at = index.find(keys)
                vector[at[at >= 0]] += counts[at >= 0]
        branch = TaskContext.get().partitionId() % BRANCHES
        for block in range(-(-len(vector) // BLOCK)):
            values = vector[block * BLOCK : (block + 1) * BLOCK]
            if values.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([branch], pa.int32()), pa.array([tallies.pack(values)], pa.binary())], ["block", "branch", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([tallies.pack(total)], pa.binary())], ["block", "branch", "counts"])

        for batch in batches:
            for block, branch, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, branch) == now:
                    total = total + tallies.unpack(data)
                    continue
                if now is not None:
                    yield row()
                now, total = (block, branch), tallies.unpack(data)
        if now is not None:
            yield row()

    schema = "block long, branch int, counts binary"
    first = parts.mapInArrow(own, schema).repartition("block", "branch").sortWithinPartitions("block", "branch").mapInArrow(add, schema)
    last = first.withColumn("branch", F.lit(0)).repartition("block").sortWithinPartitions("block").mapInArrow(add, schema)
    return [(r["block"], bytes(r["counts"])) for r in last.select("block", "counts").collect()]


RESULT = "row long, id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"


def looked_up(coded: DataFrame, models: Broadcast, shared: Broadcast | None, with_groups: bool, more: bool = False) -> DataFrame:
    """The rows of RESULT: texts aligned anew, with the counts of a shard's pairs. coded: id, a, b and the row's number. more: sums alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*models.value)
        counts = _counts(shared) if shared is not None else None
        for batch in batches:
            for part in slices(batch):
                own = Slice(aligner, part.column(1), part.column(2))
                pairs, at = np.unique(own.pairs, return_inverse=True)
                n, best = counts.of(pairs) if counts else (pairs * 0, pairs < 0)
                sums = [own.n_a, own.n_b, own.n_groups, own.n_links, own.link_sums(best[at]), own.link_sums(n[at])]
                if more:
                    sums[:4] = [x * 0 for x in sums[:4]]
                groups, shas = _group_texts(own, with_groups) if not more else ([None] * len(own.valid), [None] * len(own.valid))
                columns = [part.column(3), part.column(0), *map(pa.array, sums), pa.array(groups, pa.string()), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return coded.mapInArrow(run, RESULT)


def _group_texts(own: Slice, with_groups: bool) -> tuple[list[str | None], list[str]]:
    body, cuts = own.group_texts()
    cuts = cuts.tolist()
    texts, shas = [], []
    for ok, a, b in zip(own.valid.tolist(), cuts, cuts[1:], strict=False):
        text = body[a : b - 1] if ok else b""
        shas.append(hashlib.sha256(text).hexdigest() if ok else "")
        texts.append(bytes(text).decode() if with_groups else None)
    return texts, shas


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256) for every row.

    Each text is encoded with a space before it by the byte-level tokenizer A (a tokenizers file) and as it
    is by the sentencepiece model B, which adds that space; strings of special tokens are plain text.
    Byte offsets at which tokens of both end cut them into groups; an A and a B token whose bytes overlap
    are linked. A pair of ids counts in how many documents it is linked; n_best is the number of links whose
    count is the highest of their A id, count_sum the sum over all links. groups (with_groups) is
    `a1,a2|b1;a3|b2,b3`, groups_sha256 its digest.

    Texts are encoded once and their ids written. The first pass over them counts pairs in tasks. Distinct pairs get a minimal perfect hash, bucket by bucket; the
    tasks' counts become dense vectors indexed by it, which are summed in a tree. The second pass aligns the
    texts anew and looks their pairs up, each key verified. Index and vector are broadcast for 6 million pairs
    at most; where there are more, buckets are taken in several passes and a document's sums are added up.

    A text that is null, empty or that the tokens of A or B do not give back (as U+2581, which B reads as a
    space) has no tokens: zeros, and '' for groups and digest. Repeated rows each count as a document and each have a row; ids may be
    null; other columns play no part; an empty table gives none. Texts are taken whole; one text is aligned in one task.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    models = context.broadcast((read_bounded(a_path), read_bounded(b_path)))
    coded = written(encoded(id_and_text(docs, id_col, text_col), models))
    parts = written(pair_parts(coded, models))
    hashed = materialise(hashed_pairs(parts))
    sizes = sorted((r["bucket"], r["n"]) for r in hashed.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    shards: list[list[int]] = []
    room = 0
    for bucket, n in sizes:
        if n > room or not shards:
            shards.append([])
            room = SHARD_PAIRS
        shards[-1].append(bucket)
        room -= n
    numbered = coded.withColumn("row", F.monotonically_increasing_id())
    found = None
    for at, buckets in enumerate(shards or [None]):
        shared = None
        if buckets:
            own = F.col("bucket").isin(buckets)
            index = [(r["bucket"], r["level"], bytes(r["words"]), bytes(r["keys"])) for r in hashed.where(own).collect()]
            shared = context.broadcast((index, tree_summed(parts.where(own), context.broadcast(index))))
        one = looked_up(numbered, models, shared, with_groups, more=at > 0)
        found = one if found is None else found.unionByName(one)
    if len(shards) > 1:
        sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        found = found.groupBy("row").agg(F.first("id", ignorenulls=True).alias("id"), *sums, F.max("groups").alias("groups"), F.max("groups_sha256").alias("groups_sha256"))
    return found.drop("row")
