"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.shared import id_and_text, slices, words_of

#: Labelled rows that are learned from at most (in the mean: rows are drawn by their id's hash).
MAX_ROWS = 200_000
#: Random Fourier features, folds for the scores that calibration sees, and the ridge's weight in the number of rows.
FEATURES, FOLDS, RIDGE = 192, 4, 1e-3
SEED = 17
#: Partitions over which the normal equations are summed.
PARTS = 16

UPPER, LOWER, DIGIT, SPACE, LINE, MARK, STOP, WIDE = range(8)
CLASS = np.full(256, WIDE, dtype=np.uint8)
CLASS[33:127] = MARK
CLASS[ord("A") : ord("Z") + 1] = UPPER
CLASS[ord("a") : ord("z") + 1] = LOWER
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[:33] = SPACE
CLASS[10] = LINE
CLASS[[ord(c) for c in ".,;:"]] = STOP

STATISTICS = [
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "line", "mark", "stop", "wide",
    "word_length", "word_length_sd", "long_words", "short_words", "marked_words", "capital_words",
    "distinct_words", "doubled_words", "top_word", "repeated_lines", "line_length", "mark_share_sd",
]


def _per_text(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of the values; an empty run sums to zero."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[starts + sizes] - sums[starts]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text, zeros for an empty one. Only the text itself counts."""
    texts = pa.concat_arrays([texts])
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    starts, sizes = offsets[:-1], np.diff(offsets)
    out = np.zeros((len(texts), len(STATISTICS)))
    kinds = CLASS[raw]
    share = np.stack([_per_text(kinds == k, starts, sizes) for k in range(8)], axis=1)
    out[:, 2:10] = share / np.maximum(sizes, 1)[:, None]

    words, counts = words_of(texts)
    first, some = np.cumsum(counts) - counts, np.maximum(counts, 1)
    mean = lambda values: _per_text(values, first, counts) / some
    lengths = np.asarray(pc.binary_length(words), dtype=np.float64)
    coded = words.dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    own = coded.dictionary.cast(pa.binary()).to_pylist()
    marked = np.array([not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:" for w in own], dtype=bool)
    capital = np.array([w[:1].isupper() for w in own], dtype=bool)
    marks, capitals = (marked[codes], capital[codes]) if len(codes) else (np.zeros(0), np.zeros(0))
    doc = np.repeat(np.arange(len(counts)), counts)
    pairs, times = np.unique(doc * (len(own) + 1) + codes, return_counts=True)
    of = pairs // (len(own) + 1)
    top = np.zeros(len(counts))
    np.maximum.at(top, of, times)
    doubled = np.concatenate([[False], (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])]) if len(codes) else np.zeros(0)

    lists = pc.split_pattern(texts, "\n")
    lines, n_lines = lists.flatten(), np.asarray(pc.list_value_length(lists), dtype=np.int64)
    line_codes = np.asarray(lines.dictionary_encode().indices, dtype=np.int64)
    line_doc = np.repeat(np.arange(len(n_lines)), n_lines)
    distinct = np.bincount(np.unique(line_doc * (len(lines) + 1) + line_codes) // (len(lines) + 1), minlength=len(n_lines))

    out[:, 0] = np.log1p(sizes)
    out[:, 1] = np.log1p(counts)
    out[:, 10] = mean(lengths)
    out[:, 11] = np.sqrt(np.maximum(0, mean(lengths**2) - out[:, 10] ** 2))
    out[:, 12] = mean(lengths > 14)
    out[:, 13] = mean(lengths < 3)
    out[:, 14] = mean(marks)
    out[:, 15] = mean(capitals)
    out[:, 16] = np.bincount(of, minlength=len(counts)) / some
    out[:, 17] = mean(doubled)
    out[:, 18] = top / some
    out[:, 19] = 1 - distinct / np.maximum(n_lines, 1)
    out[:, 20] = np.log1p(sizes / np.maximum(n_lines, 1))
    out[:, 21] = np.sqrt(out[:, 14] * (1 - out[:, 14]))
    out[sizes == 0] = 0
    return out


@dataclass
class QualityModel:
    """A fitted model: all of it is a few hundred numbers and the calibration's steps."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.centre, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.steps, self.levels), 0.0, 1.0)

    def column(self, text: F.Column) -> F.Column:
        """The score of a text column; null texts count as empty."""
        model = self

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            texts = texts.fill_null("")
            batch = pa.RecordBatch.from_arrays([texts, texts], ["a", "text"])
            parts = [model.score(statistics(part.column(1))) for part in slices(batch)]
            return pa.array(np.concatenate(parts) if parts else np.zeros(0))

        return score(text)


def fourier(stats: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random features whose products approximate a Gaussian kernel of the scaled statistics; the last is constant."""
    draw = np.random.default_rng(SEED)
    d = stats.shape[1]
    directions = draw.normal(0, 1 / np.sqrt(d), (d, FEATURES))
    phases = draw.uniform(0, 2 * np.pi, FEATURES)
    scaled = np.clip((stats - centre) / scale, -8, 8)
    waves = np.sqrt(2 / FEATURES) * np.cos(scaled @ directions + phases)
    return np.hstack([waves, np.ones((len(stats), 1))])


def is_held_out(id_col: str, folds: int = 3, held: int = 1) -> F.Column:
    """crc32 of the id as text modulo folds; rows with a null id are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> QualityModel:
    """Fit on the labelled rows of docs that is_held_out does not hold out.

    Statistics are computed where the texts are; only they are joined with the labels. Each
    partition sums the normal equations of its rows by fold, the sums are added up by entry, and
    the driver solves one system of FEATURES + 1 unknowns for each fold and for all. Scores of
    rows by the model without their fold give the isotonic calibration. Labels that are null, or of
    unknown ids, are ignored; several labels of one id count as their mean. Without labels, or
    without documents, every score is 0.5; labels of a single class give that class. Null texts
    count as empty, of which all statistics are 0; very long texts are measured whole; repeated
    rows are each learned from; no column but the id, the text and the label plays a part.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = statistics(part.column(1)).astype(np.float32)
                offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "stats"])

    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label_col).alias("label"))
    count = known.count()
    if count > max_rows:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("drawn")), F.lit(1 << 20)) < (max_rows << 20) // count)
    measured = id_and_text(docs.where(~is_held_out(id_col)), id_col, text_col).mapInArrow(measure, "id long, stats array<float>")
    rows = measured.join(known, "id").repartition(PARTS, "id").persist()
    try:
        of = [F.col("stats")[i].cast("double") for i in range(len(STATISTICS))]
        first = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(of)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(of))).first()
        if not first["n"]:
            d = len(STATISTICS)
            return QualityModel(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
        centre = np.array([first[f"m{i}"] for i in range(len(of))])
        scale = np.array([first[f"s{i}"] for i in range(len(of))])
        scale[scale < 1e-9] = 1.0

        def features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            stats = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(part.num_rows, -1)
            fold = np.asarray(part.column(3), dtype=np.int64)
            return fourier(stats, centre, scale), np.asarray(part.column(2), dtype=np.float64), fold

        size = FEATURES + 2
        upper = np.triu_indices(size)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FOLDS, size, size))
            for batch in batches:
                x, y, fold = features(batch)
                z = np.hstack([x, y[:, None]])
                for k in range(FOLDS):
                    total[k] += z[fold == k].T @ z[fold == k]
            entries = np.concatenate([total[k][upper] for k in range(FOLDS)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(entries))), pa.array(entries)], ["entry", "value"])

        folded = rows.select("id", "stats", "label", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).alias("fold"))
        summed = folded.mapInArrow(sums, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value")).toArrow()
        entries = np.zeros(FOLDS * len(upper[0]))
        entries[np.asarray(summed["entry"])] = np.asarray(summed["value"])
        total = np.zeros((FOLDS, size, size))
        for k, own in enumerate(np.split(entries, FOLDS)):
            total[k][upper] = own
            total[k] = np.triu(total[k]) + np.triu(total[k], 1).T

        def solve(matrix: np.ndarray) -> np.ndarray:
            n = max(matrix[-2, -2], 1.0)
            weight = np.diag(np.append(np.full(FEATURES, RIDGE * n), 1e-9 * n))
            return np.linalg.solve(matrix[:-1, :-1] + weight, matrix[:-1, -1])

        everything = total.sum(axis=0)
        weights = solve(everything)
        without = np.stack([solve(everything - total[k]) if first["n"] > FOLDS * 4 else weights for k in range(FOLDS)])

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, fold = features(batch)
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(np.einsum("ij,ij->i", x, without[fold]))], ["label", "raw"])

        judged = folded.mapInArrow(judge, "label double, raw double")
        calibration = IsotonicRegression(labelCol="label", featuresCol="raw").fit(judged)
        steps, levels = calibration.boundaries.toArray(), calibration.predictions.toArray()
    finally:
        rows.unpersist()
    return QualityModel(centre, scale, weights, steps, levels)
