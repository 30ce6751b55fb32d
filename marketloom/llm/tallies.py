"""Sums by whole-number key that tasks fold in bounded memory and ship as packed blocks, one row a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from marketloom.llm.shared import slices

#: Entries that wait before they are folded into the sums.
FOLD = 1 << 20
#: Buckets by which keys are dealt, at most as many tasks as that.
BUCKETS = 128
SCHEMA = "bucket int, keys binary, counts binary"


class Tally:
    """Counts by key; what waits is folded in when it outgrows the sums."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Without counts every key counts once."""
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(FOLD, len(self.keys)):
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct keys and their counts."""
        if self.waiting:
            keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
            counts = np.concatenate([self.counts, *(n for _, n in self.waiting)])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
            self.keys = keys[heads]
            self.counts = np.add.reduceat(counts[order], heads) if len(heads) else heads
            self.waiting, self.size = [], 0
        return self.keys, self.counts


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i8").tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<i8")


def blocks(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket; keys must be sorted and are kept as their differences."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, dtype=np.int64)
    cuts = list(zip(heads, np.append(heads[1:], len(bucket)), strict=False))
    columns = [
        pa.array(bucket[heads], pa.int32()),
        pa.array([pack(np.diff(keys[a:b], prepend=0)) for a, b in cuts], pa.binary()),
        pa.array([pack(counts[a:b]) for a, b in cuts], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "counts"])


def opened(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unpack(keys)), unpack(counts)


def tallied(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bucket_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Blocks of each task's own counts of the keys that keys_of finds in some rows, whose first column is binary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in slices(batch, text_at=0):
                tally.add(keys_of(part))
        keys, counts = tally.fold()
        yield blocks(keys, counts, bucket_of(keys))

    return rows.mapInArrow(count, SCHEMA)


def summed(parts: DataFrame, finish: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """finish(bucket, keys, counts) of every bucket's sums. A bucket's keys must have a bound: one task holds them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally = None, Tally()
        for batch in batches:
            for bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if now is not None:
                        yield from finish(now, *tally.fold())
                    now, tally = bucket, Tally()
                tally.add(*opened(keys, counts))
        if now is not None:
            yield from finish(now, *tally.fold())

    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, schema)
