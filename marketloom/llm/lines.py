"""Line dedup: lines that several documents share stay in one of them only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.shared import id_and_text, join_counted, materialise, slices

#: White space stripped from both ends of a line before it is compared.
STRIPPED = b" \t\n\x0b\x0c\r"
#: Stands for a null id: such rows count as one document, smaller than all others.
NO_ID = -(1 << 63)


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """A 128-bit hash of each line's key, None where the key is too short to count."""
    keys: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(STRIPPED)
        # bytes are at most four times as many as code points
        long = len(key) >= 4 * min_chars or (len(key) >= min_chars and len(key.decode()) >= min_chars)
        keys.append(xxhash.xxh3_128_digest(key.lower()) if long else None)
    return keys


def _emit(ids: list[int], keys: list[bytes]) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "k"])


def shared_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(k, drop): for each document that loses lines, the hashes of their keys."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, keys = [], []
                for k, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    own = {key for key in line_keys(text, min_chars) if key}
                    ids += [k] * len(own)
                    keys += own
                yield _emit(ids, keys)

    keyed = id_and_text(docs, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    lines = materialise(keyed.mapInArrow(explode, "h1 long, h2 long, k long"))
    # rows of one id may repeat a line: they are one document
    counts = lines.groupBy("h1", "h2").agg(F.count_distinct("k").alias("docs"), F.count("*").alias("n"), F.max("k").alias("keeper"))
    shared = materialise(counts.where(F.col("docs") >= min_docs).select("h1", "h2", "keeper", "n"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    lost = join_counted(lines, shared, ["h1", "h2"], total).where("k <> keeper")
    return lost.groupBy("k").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, stats_col: str = "line_dedup") -> DataFrame:
    """The table with its text cut, and a struct stats_col (n_lines, n_dropped).

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Lines
    whose key has min_chars code points or more and is found in min_docs distinct documents or
    more stay only in the document with the largest id that holds it (all of its lines with that
    key). Other lines stay as they are, in their order. A null text counts as one empty line.
    Rows with equal ids are one document for the counts and each is cut for itself; rows with a
    null id are together one document with the smallest id. Texts of any length are taken whole. An empty table stays empty; all other
    columns are passed on, but a column named as stats_col is replaced.
    """

    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def cut(text: pa.Array, drop: pa.Array) -> pa.Array:
        texts, totals, dropped = [], [], []
        for body, gone in zip(text.cast(pa.binary()), drop, strict=True):
            body = body.as_py() or b""
            lines = body.split(b"\n")
            totals.append(len(lines))
            if gone.is_valid:
                halves = np.stack([np.asarray(gone.values.field(i)) for i in (0, 1)], axis=1).astype("<i8")
                lost = {half.tobytes() for half in halves}
                lines = [line for line, key in zip(lines, line_keys(body, min_chars), strict=True) if key not in lost]
                body = b"\n".join(lines)
            texts.append(body)
            dropped.append(totals[-1] - len(lines))
        return pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    drops = shared_lines(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"))
    done = rows.join(drops, "k", "left").select("row", cut(F.col("row")[text_col], F.col("drop")).alias("cut"))
    stats = F.struct("cut.n_lines", "cut.n_dropped").alias(stats_col)
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in (stats_col, text_col)]
    at = [c for c in docs.columns if c != stats_col].index(text_col)
    return done.select(*others[:at], F.col("cut.text").alias(text_col), *others[at:], stats)
