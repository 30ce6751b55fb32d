"""Bars, market indices, articles and the like, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order line: nation, day, price and the line's place in the day's order."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.select(
        F.col("s_nationkey").alias("nation"),
        F.col("l_shipdate").alias("ts"),
        (F.lit(100) + F.lit(0.27) * F.col("l_quantity")).alias("price"),
        F.struct(*LINE_ORDER).alias("line"),
        "l_quantity",
        "l_discount",
        "l_orderkey",
    )


def tenfold_mean(c: str) -> F.Column:
    """Ten times a column's mean, to four places, whatever the order of its rows.

    Doubles' sums end a last place apart by their order, and a mean half way between two results is then rounded either way.
    Values are added as decimals of 12 places, halves go up; where a value is no such decimal under 100, doubles are added.
    """
    value = F.col(c).try_cast("decimal(14,12)")
    n = F.count(value)
    exact = F.round(F.try_divide(F.sum(value), n.cast("decimal(10,0)")) * 10, 4).cast("double")
    return F.when(n == F.count(c), exact).otherwise(F.round(F.avg(c) * 10, 4))


def as_bars(rows: DataFrame, *keys: str) -> DataFrame:
    """OHLCV bars of trades by the keys; first and last trades are those of the least and greatest line."""
    return rows.groupBy(*keys).agg(
        F.min_by("price", "line").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "line").alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
        tenfold_mean("l_discount").alias("prob_trade_success"),
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume, prob_trade_success): a symbol for each supplier nation."""
    symbol = F.concat(F.lit("N"), F.lpad(F.col("nation").cast("string"), 2, "0"))
    return as_bars(trades(spark, sf_dir).withColumn("symbol", symbol), "symbol", "ts")


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of SPY (all nations), QQQ (nations of region 1) and ^VIX (from discounts, without volume, one day in five missing)."""
    rows = trades(spark, sf_dir)
    spy = as_bars(rows, "ts").withColumn("symbol", F.lit("SPY"))
    own = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("nation"))
    qqq = as_bars(rows.join(F.broadcast(own), "nation", "left_semi"), "ts").withColumn("symbol", F.lit("QQQ"))
    level = 15 + 100 * F.avg("l_discount")
    vix = rows.groupBy("ts").agg(level.alias("close")).where(F.dayofyear("ts") % 5 != 0)
    vix = vix.select("ts", *(F.col("close").alias(c) for c in ("open", "high", "low", "close")), F.lit(0).cast("long").alias("volume"), F.lit(0.0).alias("prob_trade_success"), F.lit("^VIX").alias("symbol"))
    return spy.unionByName(qqq).unionByName(vix).select("symbol", "ts", "open", "high", "low", "close", "volume", "prob_trade_success")


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze prices: a row for each order line with gaps; row_seq is the order of arrival."""
    rows = trades(spark, sf_dir).withColumn("symbol", F.concat(F.lit("N"), F.lpad(F.col("nation").cast("string"), 2, "0")))
    seq = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("line"))
    key = F.col("l_orderkey")
    return rows.select(
        "symbol", "ts", seq.alias("row_seq"), F.col("price").alias("open"), (F.col("price") + 1).alias("high"),
        F.when(key % 89 == 0, 0.0).otherwise(F.col("price") - 1).alias("low"),
        F.when(key % 97 != 0, F.col("price")).alias("close"),
        F.when(key % 83 != 0, F.col("l_quantity").cast("long")).alias("volume"),
    )


def event_symbol() -> F.Column:
    return F.when(F.col("user_id") % 10 == 0, "SPY").otherwise(F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, symbol, published_at, label, score, finbert_scalar) from events."""
    label = F.when(F.col("event_type").isin("purchase", "signup"), "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("article_id"), event_symbol().alias("symbol"), F.col("ts").cast("timestamp").alias("published_at"),
        label.alias("label"), F.least(F.col("value") / 500, F.lit(1.0)).alias("score"),
    )
    signed = F.when(F.col("label") == "positive", F.col("score")).when(F.col("label") == "negative", -F.col("score")).otherwise(0.0)
    return rows.withColumn("finbert_scalar", F.when(F.col("article_id") % 11 != 0, signed))


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events; a bar's ts is the end of its hour."""
    rows = table(spark, sf_dir, "events").select(event_symbol().alias("symbol"), (F.date_trunc("hour", F.col("ts")) + F.expr("INTERVAL 1 HOUR")).cast("timestamp").alias("ts"), "event_id", (100 + F.col("value") / 100).alias("price"))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "event_id").alias("close"), F.count("*").alias("volume"),
    )


def feature_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_hourly(spark, sf_dir).select("symbol", F.to_date("ts").alias("as_of_date")).distinct()
