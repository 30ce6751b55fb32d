"""The prefix trie against a walk over all prefixes in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

from marketloom.llm import prefixes, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(own)] for c, own in by.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(own), len(p), min(members[p[:-1]]) if p else -(10**9), len(own), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, own in members.items()
    )


def run(spark, rows, tmp_path, **more):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name, value in more.items():
        frame = frame.withColumn(name, value)
    frame.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = queries.op12_prefix_trie(spark, str(tmp_path)).select(names).collect()
    return sorted((r[0], r[1], -(10**9) if r[2] is None else r[2], *r[3:]) for r in got)


def test_random_conversations(spark, tmp_path):
    from pyspark.sql import functions as F

    r = random.Random(5)
    rows = []
    for c in [*range(-12, 60), 10**12, 10**12 + 3]:
        for t in range(r.choice([1, 2, 3, 8, 9, 17])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bé", None, ""])))
    rows += [r.choice(rows) for _ in range(20)]  # repeated rows are turns of their own
    rows += [(7, None, "user", "first"), (7, None, None, None), (None, 1, "user", "nobody"), (3, 1 << 20, "user", "x" * 100_000)]
    got = run(spark, rows, tmp_path, cut=F.lit(1), conv=F.lit("clash"), pos=F.lit(2), root=F.lit(3))
    assert got == trie(rebuilt(sequences(rows)))


def test_many_copies_and_one_long_conversation(spark, tmp_path):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 900, 5) for t in range(3)]
    rows += [(c, t, "user", f"{t % 3}") for c in (1001, 1002) for t in range(150 + c % 2)]
    own = sequences(rows)
    assert run(spark, rows, tmp_path) == trie(rebuilt(own))
    turns = prefixes.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    plain = prefixes.prefix_trie(turns, turns.select("conv"))
    assert plain.nodes.count() == len(trie(own)) and plain.ends.count() == len(own)


def test_empty_and_turnless(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
    # crc32("1") % 9 turns of a conversation that is not there: nothing is left of these
    only = [(c, 0, "user", "x") for c in range(1, 9) if zlib.crc32(str(c).encode()) % 9 and c % 5]
    assert only and run(spark, only, tmp_path) == trie(rebuilt(sequences(only)))
