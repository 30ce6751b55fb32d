"""Incremental features against one run over all bars."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators.features import complete, compute_features
from marketloom.operators.incremental import KEPT, FeatureStore
from marketloom.schemas import VALUES
from marketloom.streaming import ingest

DAY = dt.datetime(2020, 1, 1)
SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"


def series(symbol, n, r, start=0):
    rows, price = [], 100.0
    for i in range(n):
        price *= 1 + r.uniform(-0.03, 0.03)
        rows.append((symbol, DAY + dt.timedelta(days=start + i), price, price * (1 + r.random() / 50), price * (1 - r.random() / 50), price * (1 + r.uniform(-0.01, 0.01)), r.randint(1, 9)))
    return rows


def same(store, rows, spark):
    want = {(x.symbol, x.ts): x for x in complete(compute_features(spark.createDataFrame(rows, SCHEMA)), VALUES).collect()}
    got = {(x.symbol, x.ts): x for x in store.features.read().collect()}
    assert got.keys() == want.keys() and got
    for k, x in want.items():
        for c in VALUES:
            assert got[k][c] == pytest.approx(x[c], rel=1e-8, abs=1e-8), (k, c)


def test_batches_equal_one_run(spark, tmp_path):
    r = random.Random(12)
    rows = [*series("A", 330, r), *series("B", 240, r, 40), *series("C", 20, r), *series("late", 210, r, 150)]
    cuts = [10, 30, 205, 206, 400]
    store, before = FeatureStore(spark, str(tmp_path)), 0
    for cut in cuts:
        part = [x for x in rows if before <= (x[1] - DAY).days < cut]
        r.shuffle(part)
        store.advance(spark.createDataFrame(part, SCHEMA).withColumn("state", F.lit("clash")).repartition(3))
        before = cut
    same(store, rows, spark)
    states = {x.symbol: x for x in store.states.read().collect()}
    assert len(states["A"].tail) == KEPT and states["A"].state[0] == 330 and states["C"].state is None and len(states["C"].tail) == 20
    # what came before and what came twice changes nothing
    assert store.advance(spark.createDataFrame([*rows[:50], rows[3], (None, DAY, *rows[0][2:]), ("A", None, *rows[0][2:])], SCHEMA)) == 0
    assert store.advance(spark.createDataFrame([], SCHEMA)) == 0
    same(store, rows, spark)


def test_streamed_in_parts(spark, tmp_path):
    r = random.Random(13)
    rows = [*series("A", 230, r), *series("B", 215, r)]
    store = FeatureStore(spark, f"{tmp_path}/store")
    for cut in ((0, 100), (100, 300)):
        spark.createDataFrame([x for x in rows if cut[0] <= (x[1] - DAY).days < cut[1]], SCHEMA).write.mode("append").parquet(f"{tmp_path}/landed")
        ingest.start(ingest.files(spark, f"{tmp_path}/landed", spark.createDataFrame([], SCHEMA).schema), f"{tmp_path}/offsets", ingest.features_into(store)).awaitTermination()
    same(store, rows, spark)
