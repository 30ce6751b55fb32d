"""The quality classifier against brute force, and the pipeline's stages on small tables with nulls, ties and repeats."""

import math
import random
import re
import statistics as st
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import quality

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def text_of(r, good):
    if good:
        return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(r.randint(5, 60))).capitalize() + "."
    return " ".join(r.choice(["BUY", "now!!!", "$$$", "click", "1234567", "\n"]) for _ in range(r.randint(3, 60)))


def brute_statistics(text):
    raw = text.encode()
    if not raw:
        return [0.0] * len(quality.STATISTICS)
    kind = lambda b: "line" if b == 10 else "space" if b < 33 else "wide" if b > 126 else "upper" if 65 <= b <= 90 else "lower" if 97 <= b <= 122 else "digit" if 48 <= b <= 57 else "stop" if chr(b) in ".,;:" else "mark"
    share = Counter(map(kind, raw))
    words, lines = WORDS.findall(raw), text.split("\n")
    mean = lambda values: sum(values) / len(words) if words else 0.0
    marked = mean([not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:" for w in words])
    return [
        math.log1p(len(raw)), math.log1p(len(words)), *(share[k] / len(raw) for k in ("upper", "lower", "digit", "space", "line", "mark", "stop", "wide")),
        mean([len(w) for w in words]), st.pstdev([len(w) for w in words]) if words else 0.0, mean([len(w) > 14 for w in words]), mean([len(w) < 3 for w in words]),
        marked, mean([w[:1].isupper() for w in words]), mean([1] * len(set(words))), mean([a == b for a, b in zip(words, words[1:], strict=False)]),
        mean([max(Counter(words).values(), default=0)]), 1 - len(set(lines)) / len(lines), math.log1p(len(raw) / len(lines)), math.sqrt(marked * (1 - marked)),
    ]


def test_statistics_equal_brute_force():
    r = random.Random(1)
    texts = ["", " ", "\n\n", "é ü 漢字", "a a a b", "x" * 5000, *(text_of(r, n % 2) for n in range(60)), "Same line\nSame line\nother, end;"]
    got = quality.statistics(pa.array(["dropped", *texts]).slice(1))
    assert got == pytest.approx(np.array([brute_statistics(t) for t in texts]), abs=1e-9)


def pooled_adjacent(raw, label):
    """Isotonic levels of the sorted raw values by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    blocks = []
    for value, y in zip(raw[order], label[order], strict=True):
        blocks.append([value, value, y, 1])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            low, high = blocks[-2], blocks.pop()
            blocks[-1] = [low[0], high[1], low[2] + high[2], low[3] + high[3]]
    points = [(x, b[2] / b[3]) for b in blocks for x in (b[0], b[1])]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


def test_fit_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(n, text_of(r, n % 3 > 0)) for n in range(240)] + [(7, text_of(r, True)), (None, "x"), (500, None), (501, "")]
    labels = [(n, int(n % 3 > 0)) for n in range(0, 240, 2)] + [(4, 0), (900, 1), (8, None), (500, 0), (None, 1)]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, quality int, stats string")
    model = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    by_id = {}
    for i, y in labels:
        if i is not None and y is not None:
            by_id.setdefault(i, []).append(y)
    own = [(i, t or "", sum(by_id[i]) / len(by_id[i])) for i, t in rows if i in by_id and zlib.crc32(str(i).encode()) % 3 != 1]
    fold = {x.id: x.f for x in docs.select(F.col("doc_id").alias("id"), F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)).alias("f")).collect()}
    stats = np.array([brute_statistics(t) for _, t, _ in own]).astype(np.float32).astype(float)
    y, k = np.array([label for _, _, label in own]), np.array([fold[i] for i, _, _ in own])
    scale = stats.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = quality.fourier(stats, stats.mean(axis=0), scale)

    def ridge(rows):
        n = rows.sum()
        penalty = np.diag(np.append(np.full(quality.FEATURES, quality.RIDGE * n), 1e-9 * n))
        return np.linalg.solve(x[rows].T @ x[rows] + penalty, x[rows].T @ y[rows])

    assert model.weights == pytest.approx(ridge(np.ones(len(y), dtype=bool)), abs=1e-5)
    raw = np.array([row @ ridge(k != f) for row, f in zip(x, k, strict=True)])
    steps, levels = pooled_adjacent(raw, y)
    every = [t or "" for _, t in rows]
    mine = model.score(quality.statistics(pa.array(every)))
    wanted = np.interp(quality.fourier(np.array([brute_statistics(t) for t in every]), stats.mean(axis=0), scale) @ model.weights, steps, levels)
    assert mine == pytest.approx(wanted, abs=1e-3)
    got = {(x.doc_id, x.text): x.s for x in docs.select("doc_id", "text", model.column(F.col("text")).alias("s")).collect()}
    assert [got[row] for row in rows] == pytest.approx(mine.tolist())
    assert got[(500, None)] == got[(501, "")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(3)
    docs = [(n, text_of(r, n % 4 > 0), "en", f"s{n % 3}", 1, "clash") for n in range(200)]
    docs += [(300, None, None, None, None, None), (301, "", "en", "s", 0, "c"), (None, docs[1][1], "en", "s", 1, "c"), (5, docs[5][1], "en", "s", 1, "c"), (302, text_of(r, True) + " ok" * 40_000, "en", "s", 1, "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(n, int(n % 4 > 0), 0) for n in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    item = docs[9][1]
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_quality_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    kept = corpus_pipeline.quality(spark, docs, tables)
    want = [tuple(x) for x in docs.collect() if model.score(quality.statistics(pa.array([x.text or ""])))[0] >= 0.5]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want)) and kept.columns == docs.columns
    assert 100 < len(want) < 205
    assert corpus_pipeline.quality(spark, docs.where("false"), tables).count() == 0


def test_line_stage(spark, tables):
    line = "A line that many documents share"
    rows = [(1, f"{line}\none", 9), (2, f"{line} \ntwo", 9), (3, line.upper(), 9), (None, None, None), (4, "", 0), (4, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    kept = corpus_pipeline.line_dedup(spark, docs, tables)
    assert kept.schema == docs.schema or kept.dtypes == docs.dtypes
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, "one", 3), (2, "two", 3), (3, line.upper(), len(line)), (None, "", 0), (4, "", 0), (4, "x", 1)]))


def test_decontamination_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    item = next(x.text for x in docs.collect() if x.doc_id == 9)
    kept = corpus_pipeline.decontamination(spark, docs, tables)
    want = [tuple(x) for x in docs.collect() if item not in (x.text or "")]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want)) and len(want) < 205
    assert corpus_pipeline.decontamination(spark, docs.where("false"), tables).count() == 0


def test_packing_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = corpus_pipeline.packing(spark, docs, tables).collect()
    assert Counter(x.doc_id for x in got if x.piece == 0) == Counter(x.doc_id for x in docs.collect())
    ends = Counter()
    for x in got:
        ends[x.sequence_id] += x.length
    assert max(ends.values()) <= 1024 and all(x.offset >= 0 for x in got)
    assert corpus_pipeline.packing(spark, docs.where("false"), tables).count() == 0
