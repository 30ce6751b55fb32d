"""Weighted-sampling fingerprints against walks in plain Python."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from marketloom.llm import fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")




def jaccard(a, b):
    x, y = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    both = set(x) | set(y)
    return sum(min(x[w], y[w]) for w in both) / sum(max(x[w], y[w]) for w in both) if both else 1.0


def expected(rows):
    """(id, n_chars, edited text, next text) of distinct rows."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()))
    out = {}
    for at, (i, t) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        m = len(t) // 3
        out[i, t] = (len(t), t[: len(t) - m] + after[:m], after)
    return out


ROWS = [
    (1, "a b c a b a"), (2, ""), (3, None), (5, "\t \n"), (7, "éé 数 word\x0bword 🙂🙂🙂"), (7, "other text of one id"), (7, "other text of one id"),
    (None, "null id here"), (None, None), (9, "x" * 5000), (10, "long " * 20_000 + "tail"), (11, "a b c a b a"), (-4, "below zero"),
]


def test_edits_and_order(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("id", F.lit("x")).withColumn("word", F.lit(2)).repartition(5)
    want, got = expected(ROWS), fingerprints.edited_fingerprints(docs).collect()
    assert len(got) == len(ROWS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    by_sha = {(i, sha(t)): v for (i, t), v in want.items()}
    prints = {}
    for r in got:
        n, edited, after = by_sha[r.id, r.text_sha256]
        assert (r.n_chars, r.edited_sha256) == (n, sha(edited))
        for text, found in ((r.text_sha256, r.fingerprint), (r.edited_sha256, r.edited_fingerprint), (sha(after), r.next_fingerprint)):
            assert len(found) == fingerprints.SAMPLES and prints.setdefault(text, found) == found
    assert prints[sha("")] == prints[sha("\t \n")] == [0] * fingerprints.SAMPLES
    assert fingerprints.edited_fingerprints(docs.limit(0)).collect() == []
    one = fingerprints.edited_fingerprints(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].fingerprint == one[0].next_fingerprint and one[0].edited_sha256 == sha("a b c a a b")


def test_collisions_follow_the_generalised_jaccard(spark):
    r = random.Random(4)
    pairs = []
    for n in range(150):
        words = [f"w{r.randrange(1 + 20 * (1 + n % 5))}" for _ in range(r.randint(1, 400))]
        other = [w for w in words if r.random() < n % 11 / 10] + [f"v{r.randrange(30)}" for _ in range(r.randint(0, 60))]
        pairs.append((str(n), " ".join(words), " ".join(other * (1 + n % 3))))
    pairs += [("same", "a b b", "b a b"), ("none", "a b", "c"), ("empty", "", " ")]
    frame = spark.createDataFrame(pairs, "k string, a string, b string")
    found = fingerprints.signatures(frame, "k", ["a", "b"], 128)
    got = {x.k: x.s for x in found.select("k", fingerprints.likeness(F.col("a_fp"), F.col("b_fp")).alias("s")).collect()}
    off = [got[k] - jaccard(a, b) for k, a, b in pairs]
    assert got["same"] == got["empty"] == 1.0 and got["none"] == 0.0
    assert max(map(abs, off)) < 0.2 and abs(sum(off) / len(off)) < 0.015
    assert math.sqrt(sum(x * x for x in off) / len(off)) < 0.5 / math.sqrt(128)


def test_a_sample_is_the_least_of_its_terms(spark):
    """The first samples, walked term by term from the hashes."""
    text = "b a c a a d e e f g"
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in set(text.split())], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for w, h in hashes.items():
        assert h & (1 << 64) - 1 == xxhash.xxh64_intdigest(w.encode(), seed=42)

    def walked(k):
        found = []
        for w, n in Counter(text.split()).items():
            one, two = (xxhash.xxh64_intdigest(struct.pack("<i", x), seed=xxhash.xxh64_intdigest(struct.pack("<q", hashes[w]), seed=42)) for x in (2 * k, 2 * k + 1))
            u = [((x >> s & (1 << 25) - 1) + 0.5) / (1 << 25) for x in (one, two) for s in (0, 25)]
            r, c = -math.log(u[0] * u[1]), math.log(-math.log(u[2] * u[3]))
            beta = (one >> 50) / (1 << 14) + ((two >> 50) + 0.5) / (1 << 28)
            found.append(c - r * (math.floor(math.log(n) / r + beta) - beta) - r)
        return min(found)

    terms = spark.createDataFrame([(h, math.log(text.split().count(w))) for w, h in hashes.items()], "h long, lw double")
    got = terms.agg(*(F.min(fingerprints.sample(F.col("h"), [F.col("lw")], k)[0]) for k in range(6))).first()
    assert list(got) == pytest.approx([walked(k) for k in range(6)])
