"""Trade labels and splits in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.windows import running
from marketloom.schemas import HOLD, STOP_LOSS, TAKE_PROFIT, TARGET


def trade_labels(bars: DataFrame, hold: int = HOLD, take_profit: float = TAKE_PROFIT, stop_loss: float = STOP_LOSS, keep_open: bool = False) -> DataFrame:
    """Bars with TARGET: 1 if a coming bar's high reaches the profit before or with a low at the stop, else 0.

    Looks at the next hold bars of the same symbol. Bars whose series ends before either is
    reached have no label and are dropped unless keep_open.
    """
    ahead = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1, hold)
    coming = F.collect_list(F.struct("high", "low")).over(ahead)
    wins = lambda b: b["high"] >= F.col("close") * (1 + take_profit)
    ends = lambda b: wins(b) | (b["low"] <= F.col("close") * (1 - stop_loss))
    first = F.get(F.filter("__ahead", ends), F.lit(0))
    label = F.when(first.isNotNull(), wins(first).cast("int")).when(F.size("__ahead") >= hold, 0)
    out = bars.withColumn("__ahead", coming).withColumn(TARGET, label).drop("__ahead")
    return out if keep_open else out.where(F.col(TARGET).isNotNull())


def chronological(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """Rows with part: train for the first share of each symbol's rows, test for the others."""
    w = Window.partitionBy("symbol")
    place, total = F.row_number().over(w.orderBy("ts")), F.count("*").over(w)
    return rows.withColumn("part", F.when(place <= F.floor(total * share), "train").otherwise("test"))


def _splits(total: Column, train: int, test: int, step: int) -> Column:
    """array<struct<split,from,train_to,test_to>> of 0-based half-open row ranges."""
    last = F.floor((total - train - test) / step)
    ranges = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int")), lambda i: F.struct(i.alias("split"), (i * step).alias("from"), (i * step + train).alias("train_to"), (i * step + train + test).alias("test_to")))
    return F.when(last >= 0, ranges)


def walk_forward(rows: DataFrame, train: int = 2000, test: int = 250, step: int = 250, pooled: bool = True, embargo: int = 0) -> DataFrame:
    """Rows of each split with split and part (train or test).

    pooled: ranges are of distinct instants over all symbols; else of each symbol's own rows. The
    first embargo instants after the training range belong to no part. Only distinct instants are
    ranked, by calendar units; rows meet the splits of their instant in a join.
    """
    keys = [] if pooled else ["symbol"]
    times = rows.select(*keys, "ts").distinct()
    ranked = running(times, keys, {"__i": (F.sum, F.lit(1))}).withColumn("__i", F.col("__i") - 1)
    ranked = ranked.join(times.groupBy(*keys).agg(F.count("*").alias("__n")), keys) if keys else ranked.withColumn("__n", F.lit(times.count()))
    each = ranked.select(*keys, "ts", "__i", F.explode(_splits(F.col("__n"), train, test, step)).alias("s"))
    part = F.when((F.col("__i") >= F.col("s.from")) & (F.col("__i") < F.col("s.train_to")), "train")
    part = part.when((F.col("__i") >= F.col("s.train_to") + embargo) & (F.col("__i") < F.col("s.test_to")), "test")
    members = each.select(*keys, "ts", F.col("s.split").alias("split"), part.alias("part")).where("part is not null")
    return rows.join(members, [*keys, "ts"])
