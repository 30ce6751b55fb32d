"""Queries of context, labels, splits and sentiment with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.windows import series
from marketloom.operators import context, labels, sentiment
from marketloom.plans import sql
from marketloom.plans.features import DAY, day, rounded
from marketloom.schemas import SENTIMENT_ALL
from marketloom.sources import tables

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def _ts() -> F.Column:
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")


def trade_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.trade_labels(tables.bars_daily(spark, sf_dir)).select("symbol", day(), "trade_success")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.trade_labels(tables.bars_daily(spark, sf_dir), keep_open=True).groupBy("trade_success").agg(F.count("*").alias("bars"))


def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.chronological(tables.bars_daily(spark, sf_dir)).groupBy("symbol", "part").agg(F.count("*").alias("bars"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"))


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.walk_forward(tables.bars_daily(spark, sf_dir), 250, 60, 60)
    return out.groupBy("split", "part").agg(F.count("*").alias("bars"), F.countDistinct("ts").alias("days"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"))


def walk_forward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.walk_forward(tables.bars_daily(spark, sf_dir), 250, 60, 60, pooled=False)
    return out.groupBy("symbol", "split", "part").agg(F.count("*").alias("bars"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


def vix_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    vix = tables.market_bars(spark, sf_dir).where("symbol = '^VIX'").select("ts", F.col("close").alias("vix"), F.date_format("ts", "yyyy-MM-dd").alias("vix_day"))
    bars = tables.bars_daily(spark, sf_dir)
    return context.by_instant(bars, context.as_of(bars, vix)).select("symbol", day(), F.round("vix", 6).alias("vix"), "vix_day")


def index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = tables.market_bars(spark, sf_dir)
    out = tables.bars_daily(spark, sf_dir)
    for m in ("SPY", "QQQ"):
        own = context.one_per_instant(market.where(F.col("symbol") == m)).withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(series())) - 1)
        out = context.by_instant(out, own.select("ts", F.round("r", 6).alias(f"{m.lower()}_return_1d")))
    return out.select("symbol", day(), "spy_return_1d", "qqq_return_1d")


def as_of_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentiment.as_of_sentiment(tables.bars_hourly(spark, sf_dir), tables.articles(spark, sf_dir))
    return out.select("symbol", _ts(), *rounded(SENTIMENT_ALL, 10))


def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentiment.daily_rollup(tables.feature_days(spark, sf_dir), tables.articles(spark, sf_dir), F.lit("2024-01-10").cast("date"))
    return out.select("symbol", F.date_format("as_of_date", "yyyy-MM-dd").alias("day"), "article_count", *rounded(SENTIMENT_ALL[:6]))


def daily_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = tables.articles(spark, sf_dir).withColumn("row_seq", F.col("article_id")).withColumn("as_of_date", F.to_date("published_at"))
    daily = daily.withColumn("sentiment_24h", F.col("finbert_scalar"))
    out = sentiment.daily_sentiment(tables.bars_hourly(spark, sf_dir), daily)
    return out.select("symbol", _ts(), *rounded(["sentiment_24h", "sentiment_1h"]))


def sentiment_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentiment.sentiment_cache(tables.feature_days(spark, sf_dir), tables.articles(spark, sf_dir), last=20)
    return out.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), "news_volume", *rounded(["news_sentiment_mean_z", "sentiment_24h"]))


def sentiment_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars with each source of sentiment in turn: articles, the daily table, the cache, none."""
    bars, articles = tables.bars_hourly(spark, sf_dir), tables.articles(spark, sf_dir)
    daily = articles.select("symbol", F.to_date("published_at").alias("as_of_date"), F.col("finbert_scalar").alias("sentiment_24h"), F.col("article_id").alias("row_seq"))
    cache = daily.where("row_seq % 3 = 0").select("symbol", F.col("as_of_date").cast("timestamp").alias("ts"), "sentiment_24h", "row_seq")
    none = articles.limit(0)
    turns = {"articles": (articles, daily, cache), "gold": (none, daily, cache), "cache": (none, daily.limit(0), cache), "neutral": (None, None, None)}
    out = None
    for name, sources in turns.items():
        found = sentiment.attach_sentiment(bars, *sources).groupBy("symbol").agg(F.count("*").alias("bars"), F.round(F.sum("news_volume"), 4).alias("news"), F.round(F.sum("sentiment_24h"), 4).alias("score"))
        own = found.select(F.lit(name).alias("source"), "*")
        out = own if out is None else out.unionByName(own)
    return out


QUERIES = {
    "j08_sentiment_sources": sentiment_sources,
    "m01_trade_labels": trade_labels,
    "a15_label_counts": label_counts,
    "m02_chronological_split": chronological_split,
    "m04_walk_forward_pooled": walk_forward,
    "m03_walk_forward_rows": walk_forward_rows,
    "j05_vix_as_of": vix_as_of,
    "j03_index_join": index_join,
    "j06_as_of_sentiment": as_of_sentiment,
    "w31_daily_rollup": daily_rollup,
    "j07_daily_sentiment": daily_join,
    "s20_sentiment_cache": sentiment_cache,
}

LABELS = f"""{sql.BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS total FROM bars),
hits AS (
  SELECT a.symbol, a.rn, arg_min(CAST(b.high >= a.close * 1.08 AS INTEGER), b.rn) AS hit
  FROM n a JOIN n b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 15
  WHERE b.high >= a.close * 1.08 OR b.low <= a.close * 0.96 GROUP BY a.symbol, a.rn),
labels AS (SELECT n.symbol, n.ts, CASE WHEN hit IS NOT NULL THEN hit WHEN total - n.rn >= 15 THEN 0 END AS trade_success
  FROM n LEFT JOIN hits USING (symbol, rn))"""


def _news(alias: str, condition: str) -> str:
    """Aggregates of the articles that meet a condition."""
    s = f"coalesce(finbert_scalar, 0)) FILTER ({condition}"
    n = f"count(article_id) FILTER ({condition})"
    return f"coalesce(avg({s}), 0) AS {alias}_mean, {n} AS {alias}_n, CASE WHEN {n} > 1 THEN stddev_samp({s}) ELSE 0 END AS {alias}_sd"


_WINDOWS = ", ".join(_news(a, f"WHERE published_at > ts - INTERVAL {i}") for a, i in (("h1", "1 HOUR"), ("h24", "24 HOUR"), ("d3", "3 DAY")))
_DAY = "WHERE published_at >= date_trunc('day', ts)"
_Z = "OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


def _z(c: str) -> str:
    return f"coalesce(CASE WHEN count({c}) {_Z} >= 10 THEN ({c} - avg({c}) {_Z}) / nullif(stddev_samp({c}) {_Z}, 0) END, 0)"


ORACLE_SQL = {
    "m01_trade_labels": f"WITH {LABELS} SELECT symbol, {DAY}, trade_success FROM labels WHERE trade_success IS NOT NULL",
    "a15_label_counts": f"WITH {LABELS} SELECT trade_success, count(*) AS bars FROM labels GROUP BY trade_success",
    "m02_chronological_split": f"""WITH {sql.BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
          count(*) OVER (PARTITION BY symbol) AS total FROM bars)
        SELECT symbol, CASE WHEN rn <= floor(total * 0.8) THEN 'train' ELSE 'test' END AS part, count(*) AS bars,
          strftime(min(ts), '%Y-%m-%d') AS first_day FROM n GROUP BY ALL""",
    "m04_walk_forward_pooled": f"""WITH {sql.BARS}, d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS total
          FROM (SELECT DISTINCT ts FROM bars)),
        s AS (SELECT unnest(range(0, CAST((max(total) - 310) // 60 + 1 AS BIGINT))) AS split FROM d),
        m AS (SELECT split, ts, CASE WHEN i < split * 60 + 250 THEN 'train' ELSE 'test' END AS part
          FROM d JOIN s ON i >= split * 60 AND i < split * 60 + 310)
        SELECT CAST(split AS INTEGER) AS split, part, count(*) AS bars, count(DISTINCT ts) AS days, strftime(min(ts), '%Y-%m-%d') AS first_day
        FROM bars JOIN m USING (ts) GROUP BY split, part""",
    "m03_walk_forward_rows": f"""WITH {sql.BARS}, d AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i,
          count(*) OVER (PARTITION BY symbol) AS total FROM bars),
        s AS (SELECT symbol, unnest(range(0, CAST((max(total) - 310) // 60 + 1 AS BIGINT))) AS split FROM d GROUP BY symbol HAVING max(total) >= 310)
        SELECT symbol, CAST(split AS INTEGER) AS split, CASE WHEN i < split * 60 + 250 THEN 'train' ELSE 'test' END AS part,
          count(*) AS bars, strftime(max(ts), '%Y-%m-%d') AS last_day
        FROM d JOIN s USING (symbol) WHERE i >= split * 60 AND i < split * 60 + 310 GROUP BY ALL""",
    "j05_vix_as_of": f"""WITH {sql.MARKET}, v AS (SELECT ts, close AS vix, strftime(ts, '%Y-%m-%d') AS vix_day FROM market WHERE symbol = '^VIX')
        SELECT symbol, strftime(b.ts, '%Y-%m-%d') AS day, round(vix, 6) AS vix, vix_day FROM bars b ASOF LEFT JOIN v ON b.ts >= v.ts""",
    "j03_index_join": f"""WITH {sql.MARKET}, r AS (SELECT symbol AS m, ts, round(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 6) AS r
          FROM market WHERE symbol <> '^VIX')
        SELECT symbol, strftime(bars.ts, '%Y-%m-%d') AS day, s.r AS spy_return_1d, q.r AS qqq_return_1d FROM bars
        LEFT JOIN r s ON s.m = 'SPY' AND s.ts = bars.ts LEFT JOIN r q ON q.m = 'QQQ' AND q.ts = bars.ts""",
    "j06_as_of_sentiment": f"""WITH {sql.EVENTS}, own AS (
          SELECT h.symbol, h.ts, {_WINDOWS}, {_news("sym", _DAY)} FROM hourly h
          LEFT JOIN articles a ON a.symbol = h.symbol AND published_at <= ts AND published_at > ts - INTERVAL 3 DAY GROUP BY h.symbol, h.ts),
        spy AS (SELECT t.ts, {_news("spy", _DAY)} FROM (SELECT DISTINCT ts FROM hourly) t
          LEFT JOIN articles a ON a.symbol = 'SPY' AND published_at <= ts AND published_at >= date_trunc('day', ts) GROUP BY t.ts)
        SELECT symbol, strftime(own.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(h24_mean, 10) AS news_sentiment_mean_z, round(h1_mean, 10) AS sentiment_1h,
          round(h24_mean, 10) AS sentiment_24h, round(d3_mean, 10) AS sentiment_3d, CAST(h24_n AS DOUBLE) AS news_volume,
          round(d3_sd, 10) AS sentiment_volatility, round(sym_mean, 10) AS sym_sentiment_d1, CAST(sym_n AS DOUBLE) AS sym_news_volume_d1,
          round(sym_sd, 10) AS sym_sentiment_vol_d1, round(spy_mean, 10) AS spy_sentiment_d1, CAST(spy_n AS DOUBLE) AS spy_news_volume_d1,
          round(spy_sd, 10) AS spy_sentiment_vol_d1 FROM own JOIN spy USING (ts)""",
    "w31_daily_rollup": f"""WITH {sql.EVENTS}, days AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) AS ts FROM hourly),
        w AS (SELECT d.symbol, d.day, {_WINDOWS}, count(article_id) FILTER (WHERE CAST(published_at AS DATE) = d.day) AS article_count,
            coalesce(avg(coalesce(finbert_scalar, 0)) FILTER (WHERE CAST(published_at AS DATE) = d.day), 0) AS mean_score
          FROM days d LEFT JOIN articles a ON a.symbol = d.symbol AND published_at <= ts AND published_at > ts - INTERVAL 3 DAY GROUP BY d.symbol, d.day),
        l AS (SELECT *, ln(1 + h24_n) AS volume FROM w),
        z AS (SELECT symbol, day, article_count, {_z("mean_score")} AS a, {_z("h1_mean")} AS b, {_z("h24_mean")} AS c, {_z("d3_mean")} AS d, {_z("volume")} AS e, {_z("d3_sd")} AS f FROM l)
        SELECT symbol, strftime(day, '%Y-%m-%d') AS day, article_count, round(a, 6) AS news_sentiment_mean_z, round(b, 6) AS sentiment_1h,
          round(c, 6) AS sentiment_24h, round(d, 6) AS sentiment_3d, round(e, 6) AS news_volume, round(f, 6) AS sentiment_volatility
        FROM z WHERE day >= DATE '2024-01-10'""",
    "j07_daily_sentiment": f"""WITH {sql.EVENTS}, d AS (SELECT symbol, CAST(published_at AS DATE) AS day, finbert_scalar FROM articles
          QUALIFY row_number() OVER (PARTITION BY symbol, CAST(published_at AS DATE) ORDER BY article_id DESC) = 1)
        SELECT h.symbol, {TS.replace("ts,", "h.ts,")} AS ts, round(coalesce(finbert_scalar, 0), 6) AS sentiment_24h, 0.0 AS sentiment_1h
        FROM hourly h LEFT JOIN d ON d.symbol = h.symbol AND d.day = CAST(h.ts AS DATE)""",
    "j08_sentiment_sources": f"""WITH {sql.EVENTS}, h AS (SELECT symbol, ts FROM hourly),
        w AS (SELECT h.symbol, h.ts, count(a.article_id) AS n, coalesce(avg(coalesce(a.finbert_scalar, 0)) FILTER (a.article_id IS NOT NULL), 0) AS m
          FROM h LEFT JOIN articles a ON a.symbol = h.symbol AND a.published_at > h.ts - INTERVAL 24 HOUR AND a.published_at <= h.ts GROUP BY h.symbol, h.ts),
        d AS (SELECT symbol, CAST(published_at AS DATE) AS day, finbert_scalar FROM articles QUALIFY row_number() OVER (PARTITION BY symbol, CAST(published_at AS DATE) ORDER BY article_id DESC) = 1),
        c AS (SELECT symbol, CAST(published_at AS DATE) AS day, finbert_scalar FROM articles WHERE article_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY symbol, CAST(published_at AS DATE) ORDER BY article_id DESC) = 1)
        SELECT 'articles' AS source, symbol, count(*) AS bars, round(CAST(sum(n) AS DOUBLE), 4) AS news, round(sum(m), 4) AS score FROM w GROUP BY symbol
        UNION ALL SELECT 'gold', h.symbol, count(*), 0.0, round(sum(coalesce(finbert_scalar, 0)), 4) FROM h LEFT JOIN d ON d.symbol = h.symbol AND d.day = CAST(h.ts AS DATE) GROUP BY h.symbol
        UNION ALL SELECT 'cache', h.symbol, count(*), 0.0, round(sum(coalesce(finbert_scalar, 0)), 4) FROM h LEFT JOIN c ON c.symbol = h.symbol AND c.day = CAST(h.ts AS DATE) GROUP BY h.symbol
        UNION ALL SELECT 'neutral', symbol, count(*), 0.0, 0.0 FROM h GROUP BY symbol""",
    "s20_sentiment_cache": f"""WITH {sql.EVENTS}, days AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM hourly),
        last AS (SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) <= 20),
        a AS (SELECT symbol, CAST(published_at AS DATE) AS day, avg(finbert_scalar) AS s, count(*) AS n FROM articles GROUP BY ALL),
        r AS (SELECT symbol, day, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM last LEFT JOIN a USING (symbol, day))
        SELECT symbol, strftime(day, '%Y-%m-%d') AS day, n AS news_volume, round({_z("s")}, 6) AS news_sentiment_mean_z, round(s, 6) AS sentiment_24h FROM r""",
}
