"""The class language model against brute force: gains, core transitions, every word's class and every text's score."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.llm import brown, tallies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*(w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))), b""]


def texts():
    r = random.Random(3)
    rows = []
    for i in range(120):
        words = []
        for _ in range(r.randint(0, 30)):
            words += [r.choice(["the", "a", "The"]), r.choice(["cat", "dog", "bird", f"thing{r.randint(0, 40)}"]), r.choice(["runs", "sings", f"acts{r.randint(0, 60)}"])]
        rows.append((i, " ".join(words)))
    return [*rows, (200, None), (201, ""), (202, "cat " * 4000), (203, " \n"), (5, "the cat"), (5, "the cat"), (None, "unseen words here the dog"), (204, "zebra zebra")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in texts()], "doc_id long, text string, word string")


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


def test_exchange_gains_are_exact():
    r = np.random.default_rng(1)
    n, classes = r.integers(0, 6, (12, 12)).astype(float), r.integers(0, 4, 12)

    def matrix(c):
        m = np.zeros((4, 4))
        np.add.at(m, (c[:, None], c[None, :]), n)
        return m

    right, left = (np.stack([np.bincount(classes, weights=x[u], minlength=4) for u in range(12)]) for x in (n, n.T))
    gains = brown.exchange_gains(classes, right, left, np.diag(n).copy(), matrix(classes))
    for u in range(12):
        for c in range(4):
            moved = classes.copy()
            moved[u] = c
            assert abs(gains[u, c] - brown.mutual_information(matrix(moved)) + brown.mutual_information(matrix(classes))) < 1e-6


def test_tally(monkeypatch):
    monkeypatch.setattr(tallies, "FOLD", 50)
    r = np.random.default_rng(2)
    own, want = tallies.Tally(), Counter()
    for _ in range(40):
        keys = r.integers(0, 2**40 if r.random() < 0.2 else 30, 20)
        own.add(keys)
        want.update(keys.tolist())
    keys, counts = own.fold()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()
    found = Counter()
    for row in tallies.blocks(keys, counts, keys % 7).to_pylist():
        k, n = tallies.opened(row["keys"], row["counts"])
        assert (k % 7 == row["bucket"]).all()
        found.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    assert found == want
    assert tallies.blocks(keys[:0], keys[:0], keys[:0]).num_rows == 0


def test_all_words_are_classed_and_texts_scored(spark, docs):
    learned = [tokens(t) for i, t in texts() if not held(i)]
    counts = Counter(w for t in learned for w in t)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), (~brown.is_held_out("doc_id")).alias("learn"))
    model = brown.learn_classes(rows, 30, 12)
    # the frequent words are whole steps of the greatest counts
    assert model.frequent[0] == b"" and len(model.frequent) <= 30
    assert all(counts[w] == c for w, c in zip(model.frequent, model.counts.tolist(), strict=True))
    least = min(model.counts.tolist())
    assert all(w in model.frequent for w, c in counts.items() if math.floor(8 * math.log2(c)) > math.floor(8 * math.log2(least)))
    # transitions of the core, and no worse classes than at the start
    core = model.frequent[:12]
    at = {w: n for n, w in enumerate(core)}
    own, matrix = brown.cluster(spark, brown.core_pairs(model.coded, 12), 12)
    pairs = Counter((u, v) for t in learned for u, v in zip([b"", *t], t, strict=False) if u in at and v in at)

    def transitions(classes):
        m = np.zeros((brown.CLASSES, brown.CLASSES))
        for (u, v), n in pairs.items():
            m[classes[at[u]], classes[at[v]]] += n
        return m

    assert (transitions(own) == matrix).all() and (model.classes[:12] == own).all()
    assert brown.mutual_information(matrix) >= brown.mutual_information(transitions(np.arange(12) % brown.CLASSES))
    # each other word goes where its neighbours' weights say
    weights = brown.neighbour_weights(matrix)

    def best(word, classes):
        total = np.zeros(brown.CLASSES)
        for t in learned:
            for n, w in enumerate(t):
                if w == word:
                    behind = t[n + 1] if n + 1 < len(t) else None
                    ahead = t[n - 1] if n else b""
                    if ahead in classes:
                        total += weights[2 * classes[ahead]]
                    if behind in classes:
                        total += weights[2 * classes[behind] + 1]
        return int(total.argmax())

    classes = dict(zip(core, own.tolist(), strict=True))
    for word, k in zip(model.frequent[12:], model.classes[12:].tolist(), strict=True):
        assert k == best(word, classes)
    classes = dict(zip(model.frequent, model.classes.tolist(), strict=True))
    rare = {bytes(r.word): (r.c, r["class"]) for r in model.rare.collect()}
    assert set(rare) | set(classes) == set(counts) and not set(rare) & set(classes)
    assert rare == {w: (counts[w], best(w, classes)) for w in rare}
    # scores from the classes alone
    classes |= {w: k for w, (_, k) in rare.items()}
    kinds = np.bincount([classes[w] for w in counts], minlength=brown.CLASSES)
    total = np.bincount([classes[w] for w, n in counts.items() for _ in range(n)], minlength=brown.CLASSES)
    follow = np.zeros((brown.CLASSES, brown.CLASSES))
    for t in learned:
        for u, v in zip([b"", *t], t, strict=False):
            follow[classes[u], classes[v]] += 1
    spread = (total + 1) / (total + 1).sum()
    follow = (follow + 2 * brown.CLASSES * spread) / (follow.sum(axis=1, keepdims=True) + 2 * brown.CLASSES)
    n, v, place = sum(counts.values()), len(counts), 1 / (total + kinds + 1)
    want = []
    for i, text in texts():
        score, chance = 0.0, np.eye(brown.CLASSES)[classes[b""]]
        for w in tokens(text):
            each = chance @ follow * place
            own = each[classes[w]] if w in classes else each.sum()
            score += math.log10((counts[w] + 1) * (0.98 * own + 0.02 / (n + v + 1)))
            chance = np.eye(brown.CLASSES)[classes[w]] if w in classes else each / each.sum()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(text))
        want.append((str(i), held(i), len(tokens(text)), sum(counts[w] > 0 for w in tokens(text)), n, base, score))
    for frame in (docs, docs.repartition(7)):
        got = brown.class_scores(frame, most_frequent=30, core=12).collect()
        assert [r.n_tokens for r in sorted(got, key=lambda r: (str(r.id), r.n_tokens))] == [w[2] for w in sorted(want, key=lambda w: (w[0], w[2]))]
        for r, w in zip(sorted(got, key=lambda r: (str(r.id), r.n_tokens)), sorted(want, key=lambda w: (w[0], w[2])), strict=True):
            assert (str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
            assert (r.base_score, r.score) == pytest.approx(w[5:], abs=1e-6)


def test_scores_without_rows_to_learn_from(spark, docs):
    got = brown.class_scores(docs.where("doc_id is null")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 6, 0, 0, 0.0)]
    # nothing is frequent but the end, and a step of equal counts is taken by hash parts
    only = spark.createDataFrame([(1, " ".join(f"w{n}" for n in range(300)))], "doc_id long, text string")
    assert brown.class_scores(only, most_frequent=1, core=1).count() == 1
    vocabulary = spark.createDataFrame([(b"", 1), *((f"w{n}".encode(), 1) for n in range(300))], "word binary, c long")
    words, counts = brown.frequent_words(vocabulary, 100)
    assert 90 < len(words) <= 100 and words[0] == b"" and len(set(words)) == len(words) == len(counts)


def test_flat_of_slices():
    column = pa.array([np.arange(n, dtype="<i4").tobytes() for n in (3, 0, 2, 1)], pa.binary())
    assert brown.flat(column.slice(1, 2), "<i4").tolist() == [0, 1] and brown.flat(column.slice(4), "<i4").tolist() == []
