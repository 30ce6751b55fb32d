"""Queries of cleaning, features and z-scores with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.smoothing import SMOOTHED, with_smoothing, with_smoothing_in_blocks
from marketloom.operators import features as ops
from marketloom.plans import sql
from marketloom.schemas import FEATURES, VALUES, z
from marketloom.sources import tables

WINDOWED = [c for c in FEATURES if c not in SMOOTHED and c not in ("open", "high", "low", "volume", "ema_trend_bull")]


def rounded(columns: list[str], places: int = 6) -> list:
    return [F.round(c, places).alias(c) for c in columns]


def day() -> F.Column:
    return F.date_format("ts", "yyyy-MM-dd").alias("day")


DAY = "strftime(ts, '%Y-%m-%d') AS day"


def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.window_features(ops.numeric(tables.bars_daily(spark, sf_dir)))
    return out.select("symbol", day(), *rounded(WINDOWED))


def smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_smoothing(tables.bars_daily(spark, sf_dir)).select("symbol", day(), *rounded(SMOOTHED))


def smoothing_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values with series cut in blocks, as for bars of seconds."""
    return with_smoothing_in_blocks(tables.bars_daily(spark, sf_dir), 128).select("symbol", day(), *rounded(SMOOTHED))


def latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, _ = ops.feature_tables(tables.bars_daily(spark, sf_dir))
    return ops.latest(features).select("symbol", day(), *rounded(VALUES))


def latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores = ops.feature_tables(tables.bars_daily(spark, sf_dir))
    return ops.latest(scores).select("symbol", day(), *rounded(z(VALUES)))


def table_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.parity(*ops.feature_tables(tables.bars_daily(spark, sf_dir)))


def row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["open", "high", "low", "close", "volume"]
    bars = ops.numeric(tables.bars_daily(spark, sf_dir))
    return ops.row_z_scores(bars, columns).select("symbol", day(), *rounded(z(columns)))


def batch_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir)
    part = ops.symbols_from(bars, " n12", bars.select("symbol").distinct())
    return part.groupBy("symbol").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 4).alias("closes"))


QUERIES = {
    "w01_window_features": window_features,
    "w03_smoothing": smoothing,
    "w03_smoothing_in_blocks": smoothing_in_blocks,
    "w18_row_z_scores": row_scores,
    "k1_latest_features": latest_features,
    "k1_latest_scores": latest_scores,
    "i10_table_parity": table_parity,
    "i09_batch_slice": batch_slice,
}

FIVE = ["open", "high", "low", "close", "volume"]
ORACLE_SQL = {
    "w01_window_features": f"WITH {sql.BARS}, {sql.window_features('bars')} SELECT symbol, {DAY}, {sql.rounded(WINDOWED)} FROM win",
    "w03_smoothing": f"WITH RECURSIVE {sql.BARS}, {sql.smoothing('bars')} SELECT symbol, {DAY}, {sql.rounded(SMOOTHED)} FROM smooth",
    "w18_row_z_scores": f"""WITH {sql.BARS}, m AS (SELECT *, list_avg([open, high, low, close, CAST(volume AS DOUBLE)]) AS mean_,
        coalesce(nullif(list_stddev_pop([open, high, low, close, CAST(volume AS DOUBLE)]), 0), 1) AS sd_ FROM bars)
        SELECT symbol, {DAY}, {", ".join(f"round(({c} - mean_) / sd_, 6) AS {c}_z" for c in FIVE)} FROM m""",
    "k1_latest_features": f"""WITH RECURSIVE {sql.BARS}, {sql.features("bars")}
        SELECT symbol, {DAY}, {sql.rounded(VALUES)} FROM features QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""",
    "k1_latest_scores": f"""WITH RECURSIVE {sql.BARS}, {sql.features("bars")}, {sql.z_scores()}
        SELECT symbol, {DAY}, {sql.rounded(z(VALUES))} FROM scores QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""",
    "i10_table_parity": f"""WITH RECURSIVE {sql.BARS}, {sql.features("bars")}
        SELECT count(*) AS features, count(*) AS scores, CAST(0 AS BIGINT) AS unmatched FROM features""",
    "i09_batch_slice": f"""WITH {sql.BARS} SELECT symbol, count(*) AS bars, round(sum(close), 4) AS closes
        FROM bars WHERE symbol >= 'N12' GROUP BY symbol""",
}
ORACLE_SQL["w03_smoothing_in_blocks"] = ORACLE_SQL["w03_smoothing"]
