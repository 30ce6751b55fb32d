"""Parts of the operators, the top-k search and the pipeline."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import topk
from marketloom.llm.components import connected_components
from marketloom.llm.packing import best_fit
from marketloom.llm.simhash import BKTree, block_masks, fingerprint_links, finer_masks


def brute_top(rows, k=10):
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in whole if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 2])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    r = random.Random(block)
    rows = [(i, [r.choice([-1.5, -0.3, 0.0, 0.25, 0.7]) for _ in range(6)]) for i in range(0, 600, 7)]
    rows += [(i, [0.25] * 6) for i in range(1000, 1030)] + [(i * 100, [0.25] * 6) for i in range(20, 24)]
    rows += [(None, [1.0] * 6), (7, None), (9, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (11, [float("nan")] * 6), (2500, [float("inf")] * 6), (13, [1.0, 2.0]), (2700, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")
    got = sorted(map(tuple, topk.top_k(frame, F.col("id") % 100 == 0).collect()))
    assert got == brute_top(rows)
    assert topk.top_k(frame.where("false"), F.col("id") % 100 == 0).count() == 0
    few = frame.where("vec_id in (0, 7, 14)")
    assert [r.vec_id for r in topk.top_k(few, F.col("id") % 100 == 0).orderBy("rank").collect()] == [i for _, _, i, _ in brute_top([x for x in rows if x[0] in (0, 7, 14)])]


def test_top_k_of_large_components(spark):
    r = random.Random(8)
    for size, d in ((1e6, 256), (2.0**42, 4), (2.0**42, 2)):
        # few components are large, so that every score fits in a long
        rows = []
        for i in range(0, 400, 5):
            v = [r.choice([-1.5, 0.0, 0.25]) for _ in range(d)]
            if i % 100:
                v[i % d] = r.choice([-size, size, size / 3]) if i % d else 0.0
            rows.append((i, v))
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, topk.top_k(frame, F.col("id") % 100 == 0).collect())) == brute_top(rows)
    rows = [(0, [1.0]), (1, [300000.0]), (2, [400000.0]), (3, [None])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.top_k(frame, F.col("id") == 0).collect()] == [(0, 1, 2, 1024 * 409600000), (0, 2, 1, 1024 * 307200000)]
    # terms beyond a long may add up to a score that is none
    whole = np.array([[2.0**40, -(2.0**40), 3.0], [2.0**40, 1.0, 0.0]])
    assert topk.exact_scores(whole[:1], np.array([[2.0**40, 2.0**40, 5.0]])).tolist() == [[15]]
    with pytest.raises(OverflowError):
        topk.exact_scores(whole, whole)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    root = {x: x for link in links for x in link if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rounds", [0, 3])
def test_fingerprint_links_of_a_dense_shard(spark, monkeypatch, rounds):
    import marketloom.llm.simhash as simhash

    monkeypatch.setattr(simhash, "TREE_SIZE", 40)
    monkeypatch.setattr(simhash, "REFINED", rounds)
    r = random.Random(4)
    prints = set()
    for _ in range(5):
        centre = r.getrandbits(64)
        for _ in range(60):
            x = centre
            for bit in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << bit
            prints.add(x)
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = fingerprint_links(spark.createDataFrame([(signed(x),) for x in prints], "fp long")).collect()
    mask = (1 << 64) - 1
    assert all(((x.a ^ x.b) & mask).bit_count() <= 3 for x in found)
    own = {x: x for x in prints}

    def find_own(x):
        while own[x] != x:
            x = own[x]
        return x

    for x in found:
        own[find_own(x.a & mask)] = find_own(x.b & mask)
    groups = lambda f: sorted(sorted(x for x in prints if f(x) == y) for y in {f(x) for x in prints})
    assert groups(find) == groups(find_own)


@pytest.mark.parametrize("count", [10, 10**8, 10**11])
def test_block_masks_miss_no_pair(count):
    masks = block_masks(count, 3)
    r = random.Random(1)
    for _ in range(500):
        flips = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not flips & m for m in masks)


def test_finer_masks_miss_no_pair():
    r = random.Random(1)
    for mask in [*block_masks(10**8, 3)[:5], 0, (1 << 60) - 1, (1 << 64) - 1]:
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(100):
            flips = sum(1 << b for b in r.sample(free, min(3, len(free))))
            assert any(not flips & m for m in finer_masks(mask, 3)) and all(m & mask == mask for m in finer_masks(mask, 3))


def test_bk_tree():
    r = random.Random(9)
    items = [r.getrandbits(16) for _ in range(300)]
    tree = BKTree()
    for x in items:
        tree.add(x)
    for q in items[:50]:
        assert sorted(tree.items[i] for i in tree.search(q, 3)) == sorted(x for x in items if (x ^ q).bit_count() <= 3)


def test_best_fit_fills_slots():
    r = random.Random(6)
    for _ in range(100):
        capacity = r.choice([5, 16, 64])
        histogram = {x: r.randint(1, 40) for x in r.sample(range(1, capacity + 1), r.randint(1, min(capacity, 12)))}
        used = {}
        for length, _, count, first, offset in best_fit(histogram, capacity):
            for i in range(count):
                used.setdefault(first + i, []).append((offset, length))
        seen = dict.fromkeys(histogram, 0)
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
                seen[length] += 1
            assert at <= capacity
        assert seen == histogram
        assert sum(sum(n for _, n in parts) * 2 <= capacity for parts in used.values()) <= 1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if at < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            assert out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        out.write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        assert docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
