"""Smoothing block by block against smoothing in one pass."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions.smoothing import SMOOTHED, with_smoothing, with_smoothing_in_blocks

DAY = dt.datetime(2020, 1, 1)
SCHEMA = "symbol string, ts timestamp, close double, high double, low double, note string"


def series(symbol, n, r, step=dt.timedelta(days=1), holes=0.0):
    rows, price = [], 100.0
    for i in range(n):
        price *= 1 + r.uniform(-0.03, 0.03)
        close = r.choice([None, math.nan]) if r.random() < holes else price
        rows.append((symbol, DAY + i * step, close, price * 1.01, price * 0.98, f"{symbol}{i}"))
    return rows


@pytest.mark.parametrize("block", [64, 100, 1 << 16])
def test_blocks_give_the_same_values(spark, block):
    r = random.Random(11)
    rows = [*series("long", 1000, r), *series("short", 20, r), *series("exact", 128, r), *series("one", 1, r), *series("three", 3, r), *series("holes", 500, r, holes=0.2), *series("flat", 0, r), *series("none", 80, r, holes=1.0)]
    rows += [("still", DAY + dt.timedelta(days=i), 5.0, 5.0, 5.0, "s") for i in range(300)]
    rows += series("ticks", 700, r, dt.timedelta(seconds=7))
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(3)).repartition(4)
    want = {(x.symbol, x.ts): x for x in with_smoothing(frame).collect()}
    got = with_smoothing_in_blocks(frame, block)
    assert got.columns == [*frame.columns, *SMOOTHED] and got.count() == len(rows)
    for x in got.collect():
        y = want[x.symbol, x.ts]
        assert x.note == y.note
        for c in SMOOTHED:
            assert (x[c] is None) == (y[c] is None) and (x[c] is None or x[c] == pytest.approx(y[c], rel=1e-9, abs=1e-9)), (x.symbol, x.ts, c)


def test_nothing_to_smooth(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert with_smoothing_in_blocks(frame).collect() == []
    with pytest.raises(ValueError, match="64"):
        with_smoothing_in_blocks(frame, 10)


def test_no_task_holds_a_series(spark):
    """Bars meet their states by symbol and block."""
    r = random.Random(2)
    plan = with_smoothing_in_blocks(spark.createDataFrame(series("a", 300, r), SCHEMA), 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow 2, 2" in plan
