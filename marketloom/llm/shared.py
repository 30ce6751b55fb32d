"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import shared_folder

#: Text bytes that a Python worker handles at once; larger Arrow batches are cut (single rows are not).
SLICE_BYTES = 2 << 20
#: A key with more rows than this, and than a share of 1 / MOST_HOT of all rows, is hot: there are at most MOST_HOT such keys.
LEAST_HOT, MOST_HOT = 64, 10_000
#: Rows that one partition of a small table holds at least before it is cut in more.
PART_ROWS = 50_000
#: Largest file that may be broadcast to the executors (vocabularies, benchmarks).
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, most: int) -> DataFrame:
    """A table of narrow rows, most of them at most, in as many partitions as these call for.

    A shuffle writes files for each partition it reads: a table of few rows in as many partitions as
    the session shuffles to would take more disk for empty files than for its rows.
    """
    return df.coalesce(max(1, -(-most // PART_ROWS)))


def written(df: DataFrame, *partitions: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: later readers take only the columns and partitions they need."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """Inner join of rows with a table of one row a key, whose column n counts the key's rows and is left out.

    Hot keys meet their rows where these are, by a broadcast of at most MOST_HOT rows; only the rows
    of all other keys are dealt by key. total: how many rows there are, which n must add up to at most.
    """
    hot = F.col(n) > max(LEAST_HOT, total // MOST_HOT)
    few = counted.where(hot).drop(n)
    far = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(counted.where(~hot).drop(n), on)
    return rows.join(F.broadcast(few), on).unionByName(far)


def read_bounded(path: str) -> bytes:
    """A small file's bytes for a broadcast; refuses files that are too large for one."""
    if os.path.getsize(path) > BROADCAST_BYTES:
        raise ValueError(f"{path} is larger than {BROADCAST_BYTES} bytes")
    with open(path, "rb") as file:
        return file.read()


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns the text operators need, renamed; a null text becomes the empty text."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def slices(batch: pa.RecordBatch, text_at: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about so many bytes of text each."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(text_at)), dtype=np.int64))
    at, rows = 0, batch.num_rows
    while at < rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words ([^\\x20\\x09-\\x0D]+) of the texts in one array, and each text's number of words."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    flat = lists.flatten()
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0)) | (np.asarray(pc.binary_length(pc.ascii_trim_whitespace(texts))) == 0)
    if empty.any():
        counts = np.where(empty, 0, counts)
        flat = flat.filter(pc.not_equal(pc.binary_length(flat), 0))
    return flat, counts


def bytes_of(values: pa.Array) -> list[bytes]:
    """The values of an array of texts or bytes without nulls."""
    values = values.cast(pa.large_binary())
    cuts = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1].tolist() if len(values) else []
    body = values.buffers()[2].to_pybytes() if values.buffers()[2] else b""
    return [body[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
