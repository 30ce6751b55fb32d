"""Near-duplicates by wide SimHash sketches against the shingles' Jaccard similarity and brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.llm import near, simhash


def prose(r, n):
    return [r.choice("abcdefgh") + "".join(r.choices("lmnopqrst", k=r.randint(1, 6))) for _ in range(n)]


def variant(r, words, changes):
    words = list(words)
    for at in r.sample(range(len(words)), changes):
        words[at] = "changed" + str(r.randrange(10**6))
    return words


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("size", [40, 1024])
def test_near_duplicates(spark, monkeypatch, size):
    monkeypatch.setattr(near, "TREE_SIZE", size)
    r = random.Random(size)
    rows, clean = [], []
    for group in range(12):
        base = prose(r, r.choice([200, 600, 3000]))
        rows += [(1000 + group * 20, " ".join(base)), (1001 + group * 20, " ".join(base).upper()), (1002 + group * 20, "\n".join(variant(r, base, max(1, len(base) // 400))))]
        half = variant(r, base, len(base) // 12)
        assert jaccard(base, half) < 0.55
        clean.append(1003 + group * 20)
        rows.append((clean[-1], " ".join(half)))
    hot = prose(r, 400)
    rows += [(5000 + i, " ".join(variant(r, hot, 1))) for i in range(150)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one three"), (7, "x" * 30_000), (7, "x" * 30_000), (None, "one two"), (None, "alone here")]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, id string, key int")
    found = near.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    got = {}
    for x in found:
        got.setdefault(x.id, set()).add(x.component)
    for group in range(12):
        first = 1000 + group * 20
        assert got[first] == got[first + 1] == got[first + 2] == {first}
    assert all(got[i] == {i} for i in clean)
    assert all(got[5000 + i] == {5000} for i in range(150))
    assert got[1] == got[2] == got[3] == {1} and got[4] == got[5] == {4} and got[6] == {6} and got[7] == {7} and got[None] == {4, None}
    assert near.near_duplicates(frame.where("false")).count() == 0


def test_unit_links_connect_what_brute_force_connects():
    r = random.Random(6)
    for _ in range(20):
        centres = [[r.getrandbits(64) for _ in range(near.WIDE)] for _ in range(4)]
        wide = np.array([[p ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 8))) for p in r.choice(centres)] for _ in range(80)], dtype=np.uint64)
        apart = np.bitwise_count(wide[:, None] ^ wide[None]).sum(axis=2)

        def classes(links):
            root = list(range(80))
            for a, b in links:
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
            return [root.index(x) for x in root]

        links, kind = near.unit_links(wide, 60)
        assert all(apart[a, b] == bits <= 60 for a, b, bits in links)
        every = classes(zip(*np.nonzero(apart <= 60), strict=True))
        assert classes((a, b) for a, b, _ in links) == every == [kind.tolist().index(x) for x in kind.tolist()]
        roots = np.array([r.randrange(5) for _ in range(80)])
        asks = np.array([r.random() < 0.4 for _ in range(80)])
        pairs = [(a, b) for a in range(80) for b in range(80) if asks[a] and not asks[b] and roots[a] != roots[b] and apart[a, b] <= 60]
        assert near.unit_crossings(roots, wide, asks, 60).tolist() == sorted({x for pair in pairs for x in pair})
        sets = [sorted(r.sample(range(14), r.randint(8, 12))) for _ in range(80)]
        ends = np.append(0, np.cumsum([len(x) for x in sets]))
        found = near.unit_verified(roots, wide, asks, np.concatenate(sets).astype(np.uint64), ends, 60, 0.8)
        good = [(a, b) for a, b in pairs if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))]
        same = [(a, b) for a in range(80) for b in range(80) if roots[a] == roots[b]]
        assert set(found) <= set(good) and classes([*same, *found]) == classes([*same, *good])


def test_sketches_are_majorities():
    r = random.Random(8)
    texts = ["", "a", " ".join(prose(r, 3000)), "b b b b b b", " ".join(["same"] * 700), None]
    texts = [t or "" for t in texts]
    key, whole = near.text_sketches(pa.array(texts), 5)
    for n, text in enumerate(texts):
        one_key, one = near.text_sketches(pa.array([text]), 5)
        assert one_key[0] == key[n] and (one[:, 0] == whole[:, n]).all()
    hashes = np.array([r.getrandbits(64) for _ in range(1500)], dtype=np.uint64)
    starts = np.array([0, 1, 3, 700])
    for got, part in zip(near._majority(hashes, starts), np.split(hashes, starts[1:]), strict=True):
        assert int(got) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in part) > len(part))


def test_contiguous_edits_and_short_texts_are_found(spark):
    r = random.Random(21)
    rows, pairs = [], []
    while len(rows) < 1200:
        base = prose(r, r.choice([15, 30, 80, 110, 200, 300]))
        cut = max(1, len(base) * r.choice([5, 10, 15]) // 100)
        edit = r.choice(["truncated", "appended", "headed", "word"])
        other = {"truncated": base[:-cut], "appended": base + prose(r, cut), "headed": prose(r, cut) + base, "word": variant(r, base, 1)}[edit]
        at = len(rows)
        rows += [(at, " ".join(base)), (at + 1, " ".join(other))]
        pairs.append((at, jaccard(base, other) >= 0.8))
    assert sum(near for _, near in pairs) > 300 and sum(not near for _, near in pairs) > 30
    got = {x.id: x.component for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(at, got[at + 1] == got[at] == at) for at, _ in pairs] == pairs


@pytest.mark.parametrize("size", [30, 1024])
def test_components_equal_brute_force_where_candidates_fail(spark, monkeypatch, size):
    monkeypatch.setattr(near, "TREE_SIZE", size)
    r = random.Random(5)
    texts = []
    for _ in range(3):
        base = prose(r, 120)
        for _ in range(40):
            # texts of one base are often near 0.8 and on either side of it
            start, head = r.randint(0, 40), prose(r, r.randint(0, 12))
            texts.append(head + base[start : start + 80])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {x.id: x.component for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == root


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    r = random.Random(4)
    a, b, c, d = (" ".join(prose(r, 60)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (None, a), (3, c), (3, c), (None, d), (None, d + " more"), (4, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = corpus_pipeline.near_dedup(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, a), (2, b), (3, c), (None, d), (4, None)]))


def test_half_of_all_texts_are_empty(spark):
    """Empty texts are one fingerprint and one component, met where their rows are."""
    rows = [(i, "" if i % 2 else f"some words of text number {i} and {i * 7} more of them") for i in range(400)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("component", F.lit("x"))
    for found in (simhash.simhash_components(docs), near.near_duplicates(docs)):
        got = found.collect()
        assert len(got) == 401 and {r.component for r in got if r.id is None or r.id % 2} == {1}
        assert all(r.component is not None and r.component <= r.id for r in got if r.id is not None)


def test_pipeline_links_what_the_simhash_operator_links(spark):
    """A phrase repeated decides the fingerprint, so that other tails stay linked though few distinct shingles are shared."""
    import corpus_pipeline

    r = random.Random(9)
    phrases, texts = [" ".join(prose(r, 7)) for _ in range(3)], []
    for phrase in phrases:
        texts += [" ".join([phrase] * 40 + prose(r, 10)) for _ in range(4)]
    base = prose(r, 60)
    texts += [" ".join(base), " ".join(base[:-6]), " ".join(prose(r, 60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked = {x.id: x.component for x in simhash.simhash_components(docs).collect()}
    assert [linked[i] for i in range(12)] == [0] * 4 + [4] * 4 + [8] * 4
    assert linked[13] == 13 and jaccard(base, base[:-6]) >= 0.8
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 4, 8, 12, 14]
    without = {x.id: x.component for x in near.near_duplicates(docs).collect()}
    assert without == {i: min(i, 12) if i in (12, 13) else i for i in range(15)}


def test_few_links_stay_in_few_partitions(spark, monkeypatch):
    """Files of a shuffle and a checkpoint follow the rows, not the session's shuffle partitions."""
    from marketloom.llm import components

    seen, materialise = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df: seen.append(df.rdd.getNumPartitions()) or materialise(df))
    monkeypatch.setattr("marketloom.llm.shared.PART_ROWS", 60)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.createDataFrame([(i, i + 1) for i in range(99)] + [(200, i) for i in range(201, 230)], "a long, b long")
        got = {x.node: x.root for x in components.connected_components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {**dict.fromkeys(range(100), 0), **dict.fromkeys(range(200, 230), 200)}
    assert len(seen) > 2 and max(seen[1:]) <= 5


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    rows = [(i, f"line {i}\nthe same long line in all of the documents", "en", "s", 3) for i in range(5)] + [(5, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"near_row": F.lit("mine"), "Line_Dedup": F.lit(7), "id": F.lit(9), "key": F.lit(8)})
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and {(r.near_row, r.Line_Dedup, r.id, r.key) for r in got.collect()} == {("mine", 7, 9, 8)}
        assert stage(spark, docs.limit(0), "").collect() == []
