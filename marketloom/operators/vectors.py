"""Model scoring in batches, text vectors and similarity search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.scalars import chunks, point_id
from marketloom.sources.keyed import last_wins


def score_texts(rows: DataFrame, make_model: Callable, text: str = "text_for_score", name: str = "score", batch: int = 8, most: int = 4000) -> DataFrame:
    """Rows with a score of the text's first characters by the caller's model; blank texts get null."""
    model = predict_batch_udf(make_model, return_type=T.DoubleType(), batch_size=batch)
    cut = F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, most)
    return rows.withColumn(name, F.when(F.length(cut) > 0, model(cut)))


def chunk_points(articles: DataFrame, ident: str = "article_id", text: str = "text", size: int = 500) -> DataFrame:
    """(point_id, article_id, symbol, chunk_idx, body) for each slice of each article."""
    each = articles.select(ident, "symbol", F.posexplode(chunks(F.col(text), size)).alias("chunk_idx", "body"))
    return each.withColumn("point_id", point_id(F.col(ident), F.col("chunk_idx")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(v)), F.lit(0.0)))


def embed(points: DataFrame, make_model: Callable, stored: DataFrame, batch: int = 64) -> DataFrame:
    """The point table after an upsert of the points' unit vectors by the caller's model."""
    model = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    # the model's column first: no lambda may hold it
    rows = points.withColumn("vector", model("body")).withColumn("vector", normalised(F.col("vector")).cast("array<float>")).drop("body").withColumn("row_seq", F.col("point_id"))
    return last_wins(stored, rows, ["point_id"], "row_seq")


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, norm(a) * norm(b))


#: Points, and queries, of a symbol that meet in one task.
POINTS, QUERIES = 4096, 1024
#: Scores that lie closer together than this are computed again in the vectors' order before they are ranked.
CLOSE = 1e-9


def _chunked(rows: DataFrame, ident: str, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a chunk number by the hash of their id, as many chunks a symbol as its rows need; and (symbol, chunks)."""
    counts = rows.groupBy("symbol").agg(F.ceil(F.count("*") / size).alias(name))
    spread = rows.join(F.broadcast(counts) if counts.limit(100_001).count() <= 100_000 else counts, "symbol")
    return spread.withColumn(f"{name}_at", F.pmod(F.xxhash64(ident), F.col(name))).drop(name), counts


def most_similar(queries: DataFrame, points: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, point_id, score) of each query's k nearest points of its symbol by cosine, ties to smaller ids.

    queries: symbol, query_id, query; points: symbol, point_id, vector. Points and queries of a symbol are cut in chunks; every
    pair of chunks is one matrix product in one task, which hands on k points a query: no row is made for a pair of vectors, and
    a symbol with a third of all points is many tasks. Chunks are by hash and so of about equal size. Queries or
    points without a vector or symbol, and those of another length than their partner or of length 0, have no score and are left out.
    """
    q = queries.select("symbol", F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")).where("symbol is not null and query_id is not null and query is not null")
    p = points.select("symbol", F.col("point_id").cast("long").alias("point_id"), F.col("vector").cast("array<double>").alias("vector")).where("symbol is not null and point_id is not null and vector is not null")
    q, blocks = _chunked(q, "query_id", QUERIES, "q")
    p, chunks = _chunked(p, "point_id", POINTS, "p")
    # a chunk goes to as many tasks as the other side has chunks of its symbol
    p = p.join(blocks, "symbol").withColumn("q_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1))).drop("q")
    q = q.join(chunks, "symbol").withColumn("p_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1))).drop("p")
    keys = ["symbol", "p_at", "q_at"]
    schema = "query_id long, point_id long, score double"
    # each side has passed through the other's counts: new names for its columns
    q, p = (rows.select(*(F.col(c).alias(f"{c}_") for c in rows.columns)).toDF(*rows.columns) for rows in (q, p))
    found = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(lambda a, b: _nearest(a, b, k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "point_id", "score")


def _nearest(queries: pa.Table, points: pa.Table, k: int) -> pa.Table:
    """Each query's k best of the points."""
    out: list[tuple[int, int, float]] = []
    sizes = lambda t, c: np.asarray(pc.list_value_length(t.column(c).combine_chunks()))
    q_size, p_size = (sizes(queries, "query"), sizes(points, "vector")) if queries.num_rows and points.num_rows else (np.zeros(0), np.zeros(0))
    for n in set(q_size.tolist()) & set(p_size.tolist()) - {0}:
        q_rows, p_rows = np.flatnonzero(q_size == n), np.flatnonzero(p_size == n)
        matrix = lambda t, c, rows, n=n: t.column(c).combine_chunks().take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        a, b = matrix(queries, "query", q_rows), matrix(points, "vector", p_rows)
        a_ids, b_ids = np.asarray(queries.column("query_id"))[q_rows], np.asarray(points.column("point_id"))[p_rows]
        # sums run in the vectors' order, as SQL's do
        a_norm, b_norm = (np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) for x in (a, b))
        with np.errstate(divide="ignore", invalid="ignore"):
            rough = (a @ b.T) / np.outer(a_norm, b_norm)
        rough[~np.isfinite(rough)] = -np.inf
        for i in range(len(a)):
            row = rough[i]
            least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            near = np.flatnonzero((row >= least - CLOSE) & (row > -np.inf))
            score = np.cumsum(a[i] * b[near], axis=1)[:, -1] / (a_norm[i] * b_norm[near])
            best = np.lexsort((b_ids[near], -score))[:k]
            out += [(int(a_ids[i]), int(b_ids[near[j]]), float(score[j])) for j in best]
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "point_id", "score"])
