"""Keyed stores against a dictionary: upserts, inserts, deletes, emptied partitions, old commits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators.features import refill
from marketloom.sources.keyed import KeyedStore

SCHEMA = "symbol string, day int, part int, v double, seq int"


def table(rows):
    return sorted(tuple(r[c] for c in ("symbol", "day", "part", "v", "seq")) for r in rows.collect())


def test_random_writes(spark, tmp_path):
    r = random.Random(9)
    store, want = KeyedStore(spark, str(tmp_path), ["symbol", "day"], "part"), {}
    assert store.read() is None and store.delete(F.lit(True)) == 0
    states = []
    for n in range(7):
        rows = [(r.choice("ABCD"), day, day // 10, float(n), i) for i, day in enumerate(r.choices(range(60), k=25))]
        frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
        if n % 3 == 1:
            store.insert(frame, "seq")
            for row in sorted(rows, key=lambda x: x[4]):
                want.setdefault(row[:2], row)
        elif n % 3 == 0:
            store.upsert(frame, "seq")
            want.update({row[:2]: row for row in sorted(rows, key=lambda x: x[4])})
        else:
            gone = [k for k in want if k[0] == "B" or k[1] < 20]
            assert store.delete((F.col("symbol") == "B") | (F.col("day") < 20)) == len(gone)
            for k in gone:
                del want[k]
        states.append(sorted(want.values()))
        assert table(store.read()) == states[-1]
    assert [table(store.read(c)) for c in store.commits] == states


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), ["symbol", "day"], "part")
    store.upsert(spark.createDataFrame([("A", d, d // 10, 1.0, 0) for d in range(40)], SCHEMA))
    files = lambda part: {f.name for f in (tmp_path / "data" / f"part={part}").rglob("*.parquet")}
    before = [files(p) for p in range(4)]
    store.upsert(spark.createDataFrame([("A", 25, 2, 2.0, 0)], SCHEMA))
    assert [files(p) == b for p, b in enumerate(before)] == [True, True, False, True] and store.read().count() == 40


def test_everything_may_go_and_come_back(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), ["symbol", "day"], "part")
    rows = spark.createDataFrame([("A", 1, 0, 1.0, 0), (None, 2, 0, 2.0, 1)], SCHEMA)
    store.insert(rows)
    assert store.delete(F.lit(True)) == 2 and store.read().count() == 0
    store.insert(rows.limit(0))
    store.upsert(rows)
    assert store.read().count() == 2
    # a second writer that began with the same manifest fails and leaves the table alone
    late = KeyedStore(spark, str(tmp_path), ["symbol", "day"], "part")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        late._commit(rows, rows.select("part"), store.commits[-2])
    assert store.read().count() == 2


def test_refill(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    schema = "symbol string, ts timestamp, year int, a double, b double"
    store = KeyedStore(spark, str(tmp_path), ["symbol", "ts"], "year")
    store.insert(spark.createDataFrame([("A", day(1), 2024, None, 1.0), ("A", day(2), 2024, 5.0, 5.0), ("B", day(1), 2024, None, None), ("C", day(1), 2024, None, 2.0)], schema))
    computed = spark.createDataFrame([("A", day(1), 2024, 7.0, 7.0), ("A", day(2), 2024, 8.0, 8.0), ("A", day(3), 2024, 9.0, 9.0), ("A", day(4), 2024, None, 9.0), ("C", day(1), 2024, None, 3.0)], schema)
    assert refill(store, computed, ["a", "b"]) == 1
    got = sorted(((r.symbol, r.ts.day, r.a) for r in store.read().collect()), key=str)
    assert got == [("A", 1, 7.0), ("A", 2, 5.0), ("A", 3, 9.0), ("B", 1, None), ("C", 1, None)]
