"""Market context of bars: index features by equal instants, the volatility index as of each instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.windows import gated, running
from marketloom.schemas import CONTEXT, INDEX_CONTEXT
from marketloom.session import shared_folder

#: Context tables of up to this many rows (an instant each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def by_instant(bars: DataFrame, context: DataFrame, on: str = "ts") -> DataFrame:
    """Left equi join with one row for each instant; broadcast only where a count shows that it is small.

    The context is computed once, in the shared folder: the count and the join read it there.
    """
    shared_folder(context.sparkSession)
    context = context.checkpoint()
    return bars.join(F.broadcast(context) if context.count() <= BROADCAST_ROWS else context, on, "left")


def one_per_instant(rows: DataFrame) -> DataFrame:
    """The first row of each instant by symbol, null instants left out."""
    forth = Window.partitionBy("ts").orderBy("symbol")
    return rows.where("ts is not null").withColumn("__n", F.row_number().over(forth)).where("__n = 1").drop("__n")


def index_context(scores: DataFrame, prefix: str) -> DataFrame:
    """(ts, <prefix>_..._z): an index's z-scores and the difference of its 5-day and 1-day returns'."""
    rows = one_per_instant(scores)
    kept = [F.col(f"{c}_z").alias(f"{prefix}_{c}_z") for c in [*INDEX_CONTEXT, "sma_50"]]
    return rows.select("ts", *kept, (F.col("return_5d_z") - F.col("return_1d_z")).alias(f"{prefix}_return_5d_z_minus_1d_z"))


def volatility_context(scores: DataFrame) -> DataFrame:
    """(ts, vix_..._z) from the 50th row on. An index is one series: its rows are few."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-49, 0)
    rows = one_per_instant(scores).withColumn("__mean", gated(F.avg("close_z").over(w), "close_z", w, 50)).where("__mean is not null")
    return rows.select(
        "ts", F.col("close_z").alias("vix_level_z"), F.col("return_1d_z").alias("vix_change_z"), F.col("return_5d_z").alias("vix_return_5d_z"),
        F.col("volatility_20_z").alias("vix_volatility_20_z"), F.col("sma_20_z").alias("vix_sma_20_z"),
        F.try_divide(F.col("close_z") - F.col("__mean"), F.col("__mean")).alias("vix_high_vol_z"),
    )


def as_of(probes: DataFrame, context: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, ts, context's columns) for each distinct probe: the last context row at or before it.

    Only distinct keys and instants meet the context, never the bars. They are counted: up to
    BROADCAST_ROWS of them stand in one window (for each of the keys), more are put in order by calendar units, so
    that no task gets all of them.
    """
    keys = keys or []
    columns = [c for c in context.columns if c not in [*keys, "ts"]]
    empty = F.lit(None).cast(context.select(F.struct(*columns).alias("c")).schema["c"].dataType)
    both = context.select(*keys, "ts", F.struct(*columns).alias("__c"), F.lit(False).alias("__probe"))
    both = both.unionByName(probes.select(*keys, "ts").distinct().select(*keys, "ts", empty.alias("__c"), F.lit(True).alias("__probe")))
    # one row an instant: the context's own row is as of its instant too
    both = both.groupBy(*keys, "ts").agg(F.max_by("__c", F.when(~F.col("__probe"), F.lit(1))).alias("__own"), F.bool_or("__probe").alias("__probe"))
    shared_folder(both.sparkSession)
    both = both.checkpoint()
    if both.count() <= BROADCAST_ROWS:
        before = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("__c", F.last("__own", ignorenulls=True).over(before))
    else:
        found = running(both, keys, {"__c": (F.last, F.col("__own"))})
    return found.where("__probe").select(*keys, "ts", "__c.*")


def attach_context(scores: DataFrame, spy: DataFrame, qqq: DataFrame, vix: DataFrame, complete: bool = True) -> DataFrame:
    """Bars' z-scores with CONTEXT (and the indices' sma_50_z); complete drops bars that lack any of it."""
    out = by_instant(scores, index_context(spy, "spy"))
    out = by_instant(out, index_context(qqq, "qqq"))
    out = by_instant(out, as_of(scores, volatility_context(vix)))
    return out.na.drop("any", subset=CONTEXT) if complete else out
