"""Token alignment against a walk over whole texts, byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the", "The", " ", "  ", "\n", "\r\n", "\t", ";\r", "{\r\n", "don't", "x", "naïve", "数据", "🙂", "1234", "…", "--", ".", ",", "!", "word.", "end!,", " ", "　", "é", "<|endoftext|>", "<s>", "<0x0A>", "ing", "\x00", "​"]


def walk(texts):
    """(n_a, n_b, n_groups, links, groups) of whole texts, without chunks."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    names = {i: t for t, i in a.get_vocab().items()}
    out = []
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        p = [bytes(letters[c] for c in names[i]) if all(c in letters for c in names[i]) else names[i].encode() for i in x]
        q = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or not b"".join(p) == b"".join(q) == (" " + text).encode():
            out.append((0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(t) for t in own]).tolist() for own in (p, q)]
        owner = [[i for i, t in enumerate(own) for _ in t] for own in (p, q)]
        links = [(x[i], y[j]) for i, j in sorted(set(zip(*owner, strict=True)))]
        groups, s, t = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            u, v = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(f"{','.join(map(str, x[s:u]))}|{','.join(map(str, y[t:v]))}")
            s, t = u, v
        out.append((len(x), len(y), len(groups), links, ";".join(groups)))
    return out


def expected(texts):
    found, counts, best = walk([t or "" for t in texts]), Counter(), defaultdict(int)
    for *_, links, _ in found:
        counts.update(set(links))
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(n_a, n_b, n, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), groups, hashlib.sha256(groups.encode()).hexdigest() if n_a else "") for n_a, n_b, n, links, groups in found]


def texts():
    r = random.Random(6)
    made = ["".join(r.choice(PARTS) for _ in range(r.randint(1, 40))) for _ in range(250)]
    return [*made, None, "", " ", "  ", "\n", "a▁b", "▁", "ok ▁ ok", "long " * 30_000, "x" * 5000, *made[:40], *[made[3]] * 30]


@pytest.mark.parametrize("shard", [alignment.SHARD_PAIRS, 60])
def test_alignment(spark, monkeypatch, shard):
    monkeypatch.setattr(alignment, "SHARD_PAIRS", shard)
    rows = texts()
    frame = spark.createDataFrame([(i if i % 50 else None, i, t) for i, t in enumerate(rows)], "doc_id long, at long, text string")
    frame = frame.withColumn("row", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("bucket", F.lit(2)).repartition(5)
    got = alignment.align_tokenizers(frame, A, B, id_col="at", with_groups=True)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"]
    found = {r.id: tuple(r[n] for n in names) for r in got.select("id", *names).collect()}
    want = dict(enumerate(expected(rows)))
    assert found == want
    assert sum(w[0] > 0 for w in want.values()) > 200 and alignment.align_tokenizers(frame, A, B).count() == len(rows)


def test_nothing_to_align(spark):
    frame = spark.createDataFrame([(1, None), (None, ""), (1, "▁")], "doc_id long, text string")
    got = alignment.align_tokenizers(frame, A, B).collect()
    assert len(got) == 3 and all(tuple(r)[1:7] == (0,) * 6 and r.groups_sha256 == "" for r in got)
    assert alignment.align_tokenizers(frame.limit(0), A, B).collect() == []


def test_perfect_hash():
    r = np.random.default_rng(7)
    keys = np.unique(r.integers(0, 1 << 32, 40_000))
    rows = []
    for bucket in range(alignment.BUCKETS):
        own = keys[alignment.bucket_of(keys) == bucket]
        rows += [(bucket, level, w.tobytes(), k.astype("<u4").tobytes()) for level, (w, k) in enumerate(alignment.perfect_levels(own))]
    index = alignment.PairIndex(rows)
    at = index.find(keys)
    assert sorted(at) == list(range(len(keys))) and (index.keys[at] == keys).all()
    others = np.setdiff1d(r.integers(0, 1 << 32, 40_000), keys)
    assert (index.find(others) == -1).all() and (alignment.PairIndex([]).find(others) == -1).all()
