"""Queries of ingest, cleaning, audits and scans of prices with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.windows import last_rows
from marketloom.operators import prices as ops
from marketloom.operators.features import latest
from marketloom.plans import sql
from marketloom.plans.features import DAY, day, rounded
from marketloom.schemas import PRICES
from marketloom.sources import tables, universe
from marketloom.sources.keyed import first_wins, last_wins

SPLIT = "1999-01-01"
TODAY = "2001-06-30"


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clean_prices(tables.raw_prices(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).select("symbol", day(), *rounded(PRICES))


def clean_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.audit(tables.raw_prices(spark, sf_dir), _clean(spark, sf_dir))


def vix_waiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.market_bars(spark, sf_dir).withColumn("row_seq", F.lit(1))
    return ops.clean_prices(bars).groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"))


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir)
    stored = bars.where((F.col("ts") < SPLIT) & (F.col("symbol") != "N03"))
    new = ops.new_rows(bars, stored, F.lit(TODAY).cast("date"))
    return new.groupBy("symbol").agg(F.count("*").alias("bars"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.raw_prices(spark, sf_dir)
    stored = raw.where("row_seq = 1").select("symbol", "ts", "open", "row_seq")
    incoming = raw.where("row_seq >= 2").select("symbol", "ts", "open", "row_seq")
    return last_wins(stored, incoming, ["symbol", "ts"], "row_seq").select("symbol", day(), F.round("open", 6).alias("open"), "row_seq")


def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir)
    stored = bars.where((F.dayofyear("ts") % 3 != 0) & F.col("close").isNotNull())
    new = first_wins(stored, bars, ["symbol", "ts"], "close")
    return new.groupBy("symbol").agg(F.count("*").alias("added"), F.round(F.sum("close"), 4).alias("closes"))


def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir)
    starts = ops.watermarks(bars.where(F.col("symbol") < "N20"))
    return ops.history_from(bars, starts).groupBy("symbol").agg(F.count("*").alias("bars"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"))


def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("N01",), ("N02",), ("N01",)], "symbol string").distinct()
    bars = tables.bars_daily(spark, sf_dir).where(F.col("ts").between("1997-01-01", TODAY))
    return bars.join(F.broadcast(wanted), "symbol", "left_semi").select("symbol", day(), *rounded(PRICES))


def symbol_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir)
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"), F.countDistinct("ts").alias("days"))


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir)
    expected = universe.resolve(bars.select("symbol"))
    return ops.coverage(expected, _clean(spark, sf_dir), bars.where("symbol <> 'N05'"))


def universe_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir)
    return universe.overlap(bars, universe.resolve(bars)).withColumn("ratio", F.round("ratio", 6))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tables.bars_daily(spark, sf_dir).select("symbol").unionByName(tables.market_bars(spark, sf_dir).select("symbol"))
    return universe.training_pool(both.select(universe.ticker(F.concat(F.lit(" "), F.lower("symbol"))).alias("symbol")), ["AAPL"])


def last_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(tables.bars_daily(spark, sf_dir), n=5).select("symbol", day(), *rounded(PRICES))


def volume_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir).withColumn("volume_sma_20", F.avg("volume").over(last_rows(20)))
    return latest(bars).select("symbol", day(), *rounded(["volume_sma_20"]))


def page_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.first_cells(tables.table(spark, sf_dir, "pages")).agg(F.count("*").alias("symbols"))


QUERIES = {
    "i03_clean_prices": clean,
    "i05_clean_audit": clean_audit,
    "i03_volume_waiver": vix_waiver,
    "i01_incremental_window": incremental,
    "i02_last_wins_upsert": upsert,
    "i06_first_wins_append": append_new,
    "s13_history_scan": history_scan,
    "s14_window_scan": window_scan,
    "a01_symbol_stats": symbol_stats,
    "a05_preflight": preflight,
    "x4_universe_overlap": universe_overlap,
    "i18_training_pool": pool,
    "k5_last_bars": last_bars,
    "w22_volume_mean": volume_mean,
    "s10_page_cells": page_cells,
}

CLEAN = f"""{sql.RAW},
clean AS (
  SELECT * FROM (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY row_seq DESC) = 1)
  WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0)"""
ORACLE_SQL = {
    "i03_clean_prices": f"WITH {CLEAN} SELECT symbol, {DAY}, {sql.rounded(PRICES)} FROM clean",
    "i05_clean_audit": f"""WITH {CLEAN} SELECT symbol, raw_rows, coalesce(clean_rows, 0) AS clean_rows
        FROM (SELECT symbol, count(*) AS raw_rows FROM raw GROUP BY symbol)
        LEFT JOIN (SELECT symbol, count(*) AS clean_rows FROM clean GROUP BY symbol) USING (symbol)""",
    "i03_volume_waiver": f"""WITH {sql.MARKET} SELECT symbol, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume
        FROM market WHERE close > 0 AND (volume > 0 OR symbol = '^VIX') GROUP BY symbol""",
    "i01_incremental_window": f"""WITH {sql.BARS}, mark AS (
          SELECT symbol, max(ts) AS m FROM bars WHERE ts < TIMESTAMP '{SPLIT}' AND symbol <> 'N03' GROUP BY symbol)
        SELECT symbol, count(*) AS bars, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
        FROM bars LEFT JOIN mark USING (symbol)
        WHERE ts < DATE '{TODAY}' + INTERVAL 1 DAY AND (m IS NULL OR ts >= CAST(m AS DATE) + INTERVAL 1 DAY) GROUP BY symbol""",
    "i02_last_wins_upsert": f"""WITH {sql.RAW} SELECT symbol, {DAY}, round(open, 6) AS open, CAST(row_seq AS INTEGER) AS row_seq
        FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY row_seq DESC) = 1""",
    "i06_first_wins_append": f"""WITH {sql.BARS} SELECT symbol, count(*) AS added, round(sum(close), 4) AS closes
        FROM bars WHERE dayofyear(ts) % 3 = 0 GROUP BY symbol""",
    "s13_history_scan": f"""WITH {sql.BARS}, mark AS (SELECT symbol, max(ts) AS m FROM bars WHERE symbol < 'N20' GROUP BY symbol)
        SELECT symbol, count(*) AS bars, strftime(min(ts), '%Y-%m-%d') AS first_day
        FROM bars LEFT JOIN mark USING (symbol) WHERE m IS NULL OR ts >= m - INTERVAL 400 DAY GROUP BY symbol""",
    "s14_window_scan": f"""WITH {sql.BARS} SELECT symbol, {DAY}, {sql.rounded(PRICES)} FROM bars
        WHERE symbol IN ('N01', 'N02') AND ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '{TODAY}'""",
    "a01_symbol_stats": f"""WITH {sql.BARS} SELECT symbol, count(*) AS bars, strftime(max(ts), '%Y-%m-%d') AS last_day,
        count(DISTINCT ts) AS days FROM bars GROUP BY symbol""",
    "a05_preflight": f"""WITH {CLEAN}, seen AS (SELECT DISTINCT symbol FROM raw),
        expected AS (SELECT symbol FROM seen UNION SELECT unnest(['QQQ', 'SPY', '^VIX'])),
        marked AS (SELECT e.symbol, e.symbol IN (SELECT symbol FROM clean) AS c,
          e.symbol IN (SELECT symbol FROM seen WHERE symbol <> 'N05') AS f FROM expected e)
        SELECT count(*) AS expected, count(*) FILTER (WHERE c) AS with_clean, count(*) FILTER (WHERE f) AS with_features,
          coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (WHERE NOT f), '') AS missing, bool_and(f) AS passed FROM marked""",
    "x4_universe_overlap": f"""WITH {sql.BARS}, n AS (SELECT count(DISTINCT symbol) AS k FROM bars)
        SELECT k AS overlap, k + 3 AS expected, round(k / (k + 3), 6) AS ratio, k / (k + 3) >= 0.95 AS passed FROM n""",
    "i18_training_pool": f"WITH {sql.BARS} SELECT DISTINCT symbol FROM bars",
    "k5_last_bars": f"""WITH {sql.BARS} SELECT symbol, {DAY}, {sql.rounded(PRICES)} FROM bars
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 5""",
    "w22_volume_mean": f"""WITH {sql.BARS}, v AS (SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY ts
          ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS volume_sma_20 FROM bars)
        SELECT symbol, {DAY}, round(volume_sma_20, 6) AS volume_sma_20 FROM v QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""",
    "s10_page_cells": r"""SELECT count(DISTINCT s) AS symbols FROM (SELECT upper(trim(split_part(regexp_replace(
          unnest(regexp_extract_all(html, '(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>', 1)), '<[^>]*>', '', 'g'), '[', 1))) AS s FROM pages) WHERE s <> ''""",
}
