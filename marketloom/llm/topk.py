"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.shared import materialise

#: Queries that are broadcast and scored at once; more queries take more passes.
QUERY_BLOCK = 4096
#: Bins of a query's score histogram in one pass.
BINS = 2048
#: Candidates that a task scores at once.
CANDIDATES = 512
#: Scores are compared as unsigned numbers with this added.
SHIFT = np.uint64(1 << 63)


def integer_vectors(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and whole-number components (as doubles) of the rows (id, vector) that take part; short vectors are filled with zeros."""
    batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
    ids = np.asarray(batch.column(0), dtype=np.int64)
    sizes = np.asarray(pc.list_value_length(batch.column(1)), dtype=np.int64)
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = int(sizes.max(initial=0))
    matrix = np.zeros((len(ids), wide))
    matrix[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    good = np.isfinite(matrix).all(axis=1)
    with np.errstate(over="raise"):
        return ids[good], np.floor(scale * matrix[good])


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and of b, whole numbers held as doubles; raises where one does not fit in a long.

    Doubles add exactly below 2 ** 53, and longs wrap, so that any sum that fits comes out exact;
    pairs whose terms are large enough for it not to fit are added again as unbounded numbers.
    """
    most = a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    with np.errstate(invalid="ignore"):
        scores = a.astype(np.int64) @ b.astype(np.int64).T
    if most * (1 + 1e-9) >= 2**63:
        sizes = np.abs(a) @ np.abs(b).T
        for row, other in zip(*np.nonzero(sizes * (1 + 1e-9) >= 2**63), strict=True):
            score = sum(int(x) * int(y) for x, y in zip(a[row].tolist(), b[other].tolist(), strict=True))
            if not -(2**63) <= score < 2**63:
                raise OverflowError(f"a score of {score} does not fit in a long")
            scores[row, other] = score
    return scores


@dataclass
class Block:
    """Queries with their present windows of shifted scores: need more are wanted from low to high, in bins of a width."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    width: np.ndarray
    need: np.ndarray


def _scores(batches: Iterator[pa.RecordBatch], block: Block, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates' ids, their shifted scores (candidate by query) and which of these count: a query's own row does not."""
    for batch in batches:
        all_ids, all_vectors = integer_vectors(batch, scale)
        for at in range(0, len(all_ids), CANDIDATES):
            ids, vectors = all_ids[at : at + CANDIDATES], all_vectors[at : at + CANDIDATES]
            d = min(vectors.shape[1], block.vectors.shape[1])
            scores = exact_scores(vectors[:, :d], block.vectors[:, :d]).view(np.uint64) + SHIFT
            yield ids, scores, ids[:, None] != block.ids[None, :]


def _counter(block: Block, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query, bin, n, need): a task's histogram, from the top down to the bin that alone would fill the need.

    The global kth score is no smaller than any task's own kth score: bins below that cannot hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = len(block.ids)
        counts = np.zeros(queries * BINS, dtype=np.int64)
        for _, scores, counted in _scores(batches, block, scale):
            counted &= (scores >= block.low) & (scores <= block.high)
            query = np.nonzero(counted)[1]
            bins = (scores[counted] - block.low[query]) // block.width[query]
            counts += np.bincount(query * BINS + bins.astype(np.int64), minlength=len(counts))
        grid = counts.reshape(queries, BINS)[:, ::-1]
        above = np.cumsum(grid, axis=1) - grid
        query, back = np.nonzero((grid > 0) & (above < block.need[:, None]))
        columns = [pa.array(query), pa.array(BINS - 1 - back), pa.array(grid[query, back]), pa.array(block.need[query])]
        yield pa.RecordBatch.from_arrays(columns, ["query", "bin", "n", "need"])

    return run


def _taker(block: Block, scale: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query_id, vec_id, score) with scores from the kth value up; of a task's own rows, the k best by score and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.int64)]
        for ids, scores, counted in _scores(batches, block, scale):
            row, query = np.nonzero(counted & (scores >= block.low))
            best = [np.concatenate(x) for x in zip(best, (query, scores[row, query], ids[row]), strict=True)]
            order = np.lexsort((best[2], ~best[1], best[0]))
            best = [x[order] for x in best]
            place = np.arange(len(order)) - np.searchsorted(best[0], best[0])
            best = [x[place < k] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(block.ids[best[0]]), pa.array(best[2]), pa.array((best[1] - SHIFT).view(np.int64))], ["query", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by integer inner product.

    Components x become floor(scale * x); a score that does not fit in a long is an error. Ties go to smaller ids. Rows
    with a null id, a null vector or a null or non-finite component take no part; vectors of
    unequal lengths are compared over the shorter one. Rows with a query's id are its own; a
    repeated query is answered for each of its rows, a repeated candidate counts each time. A
    query with fewer candidates gets all of them. Empty tables and tables without queries give
    none. Other columns play no part.

    Queries are broadcast in blocks of a fixed size. For each block every row is scored several
    times: each pass counts scores in a histogram of each query's present window and narrows the
    window to the bin of the kth value, until that value is known; a last pass takes the rows at
    and above it. Scores are never stored and only histogram rows and k rows a task are shuffled.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    asked = rows.where(is_query)
    count = asked.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max((float((v**2).sum(axis=1).max(initial=0)) for _, v in (integer_vectors(b, scale) for b in batches)), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["square"])

    largest = rows.mapInArrow(norms, "square double").agg(F.max("square")).first()[0] or 0.0
    blocks = -(-count // QUERY_BLOCK)
    dealt = asked.repartition(blocks).withColumn("block", F.spark_partition_id())
    dealt = materialise(dealt) if blocks > 1 else dealt
    found = []
    for number in range(blocks):
        own = dealt.where(F.col("block") == number).select("id", "vector").toArrow().combine_chunks()
        parts = [integer_vectors(batch, scale) for batch in own.to_batches()]
        if any(len(ids) for ids, _ in parts):
            wide = max(v.shape[1] for _, v in parts)
            whole = np.vstack([np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for _, v in parts])
            best = _search(rows, np.concatenate([ids for ids, _ in parts]), whole, float(largest), scale, k)
            found.append(materialise(best) if blocks > 1 else best)
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, found)


def _bins(wide: np.ndarray, bins: int) -> np.ndarray:
    """The width of so many bins that together are as wide."""
    return wide // np.uint64(bins) + np.uint64(1)


def _search(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, largest: float, scale: float, k: int) -> DataFrame:
    # no score is beyond the product of the lengths, nor beyond a long
    most = np.sqrt((vectors**2).sum(axis=1)) * np.sqrt(largest) * (1 + 1e-9) + 2
    bound = np.array([min(int(m), (1 << 63) - 1) if np.isfinite(m) else (1 << 63) - 1 for m in most], dtype=np.uint64)
    block = Block(ids, vectors, SHIFT - bound, SHIFT + bound, _bins(bound, BINS // 2), np.full(len(ids), k))
    settled = np.zeros(len(ids), dtype=bool)
    down = Window.partitionBy("query").orderBy(F.desc("bin"))
    while not settled.all():
        counts = rows.mapInArrow(_counter(block, scale), "query long, bin long, n long, need long")
        summed = counts.groupBy("query", "bin", "need").agg(F.sum("n").alias("n")).withColumn("reached", F.sum("n").over(down))
        hit = summed.where("reached >= need").groupBy("query").agg(F.max_by(F.struct("bin", (F.col("reached") - F.col("n")).alias("above")), "bin").alias("b"))
        at = hit.select("query", "b.bin", "b.above").toArrow()
        query, bin_, above = (np.asarray(at[c], dtype=np.int64) for c in ("query", "bin", "above"))
        low, high, width, need = block.low.copy(), block.high.copy(), block.width.copy(), block.need.copy()
        # a query without a kth score takes all scores that there are: its low stays at the bound
        missing = ~np.isin(np.arange(len(ids)), query) & ~settled
        low[query] += bin_.astype(np.uint64) * width[query]
        high[query] = low[query] + np.minimum(high[query] - low[query], width[query] - np.uint64(1))
        need[query] -= above
        settled = settled | missing | (width == 1)
        width = np.where(settled, np.uint64(1), _bins(width, BINS))
        # settled queries have nothing left to count
        block = Block(ids, vectors, low, high, width, np.where(settled, 0, need))
    taken = rows.mapInArrow(_taker(block, scale, k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return taken.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
