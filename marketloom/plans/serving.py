"""Queries of datasets, predictions, decisions and their records with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.windows import last_rows
from marketloom.operators import backtest as trading
from marketloom.operators import dataset, experiments, models, scanner
from marketloom.operators.features import feature_tables, latest, numeric, window_features
from marketloom.operators.labels import trade_labels, walk_forward
from marketloom.plans import sql
from marketloom.plans.backtest import _CALMAR, _GRID
from marketloom.plans.context import LABELS
from marketloom.plans.features import DAY, day, rounded
from marketloom.plans.prices import CLEAN
from marketloom.schemas import CHART, CONTEXT, MODEL_VECTOR, VALUES
from marketloom.session import shared_folder
from marketloom.sources import ohlcv, series, tables

LEVEL = 0.35
CLOSE = "2001-10-01"
SHOWN = ["return_1d_z", "rsi_14_z", *CONTEXT]


def ohlcv_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = tables.bars_daily(spark, sf_dir).select(
        "symbol", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("-05:00")).alias("Date"),
        F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"), F.lit(0.0).alias("Dividends"),
    )
    return ohlcv.as_prices(named).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), *rounded(["open", "high", "low", "close"]), "volume")


def training_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, market = numeric(tables.bars_daily(spark, sf_dir)), numeric(tables.market_bars(spark, sf_dir))
    features, scores = feature_tables(bars)
    of = {name: feature_tables(market.where(F.col("symbol") == name))[1] for name in ("SPY", "QQQ", "^VIX")}
    rows = dataset.dataset(features, scores, of["SPY"], of["QQQ"], of["^VIX"], tables.articles(spark, sf_dir))
    whole = dataset.model_matrix(rows)
    return whole.select("symbol", day(), "trade_success", *rounded(SHOWN), F.size(F.array(*MODEL_VECTOR)).alias("columns"))


def inference_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset without labels: each symbol's last rows stay. Rows a symbol and year, with their last day."""
    bars, market = numeric(tables.bars_daily(spark, sf_dir)), numeric(tables.market_bars(spark, sf_dir))
    features, scores = feature_tables(bars)
    of = {name: feature_tables(market.where(F.col("symbol") == name))[1] for name in ("SPY", "QQQ", "^VIX")}
    rows = dataset.model_matrix(dataset.dataset(features, scores, of["SPY"], of["QQQ"], of["^VIX"], tables.articles(spark, sf_dir), labelled=False))
    return rows.groupBy("symbol", F.year("ts").alias("year")).agg(F.count("*").alias("bars"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"), F.round(F.sum("vix_level_z"), 4).alias("level"))


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanner's rows: the last of each symbol, with context and sentiment; and how far each symbol's stages got."""
    bars, market = numeric(tables.bars_daily(spark, sf_dir)), numeric(tables.market_bars(spark, sf_dir))
    features, scores = feature_tables(bars)
    # some symbols' z-scores end earlier, so that their last rows do not meet
    scores = scores.where(~F.col("symbol").endswith("4") | (F.col("ts") < "2001-06-01"))
    of = {name: feature_tables(market.where(F.col("symbol") == name))[1] for name in ("SPY", "QQQ", "^VIX")}
    rows, stages = dataset.latest_rows(features, scores, of["SPY"], of["QQQ"], of["^VIX"], tables.articles(spark, sf_dir))
    shown = rows.select("symbol", *rounded(["close", *SHOWN]))
    at = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return stages.select("symbol", *(at(c) for c in ("latest_features", "latest_scores", "latest_context", "latest_merged"))).join(shown, "symbol", "left")


def stored_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and features of some symbols up to a day, from two tables that are joined bucket by bucket."""
    name, folder = uuid.uuid4().hex, f"{shared_folder(spark)}/series-{uuid.uuid4().hex}"
    bars = numeric(tables.bars_daily(spark, sf_dir)).drop("prob_trade_success")
    prices, values = (series.SeriesTable(spark, f"{n}_{name}", f"{folder}/{n}", 16) for n in ("prices", "features"))
    prices.save(bars)
    values.save(window_features(bars.where(F.dayofmonth("ts") != 5)).na.drop("any", subset=["sma_50"]).select("symbol", "ts", "close", "sma_50", "return_5d"))
    symbols = bars.select("symbol").distinct().where("symbol < 'N20'")
    rows = series.joined(prices, values, symbols, "2000-12-31")
    few = series.joined(prices, values, [" n03 ", "N07", "N07"], "1999-12-31").select("symbol", "ts", F.lit(True).alias("listed"))
    return rows.join(few, ["symbol", "ts"], "left").select("symbol", day(), *rounded(["open", "close", "volume", "sma_50", "return_5d"]), "listed")


def shared_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir)
    rows = bars.withColumn("spy", F.dayofyear("ts")).withColumn("own", F.when(F.col("symbol") == "N03", F.col("close")))
    return dataset.context_is_shared(rows, ["spy", "own"]).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "symbols", "same")


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir)
    scores = bars.where(F.col("symbol") != "N07")
    context = scores.where(F.dayofmonth("ts") < 20)
    out = scanner.stage_times(bars.where(F.dayofmonth("ts") % 2 == 0), scores, context)
    return out.select("symbol", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in out.columns[1:]))


def first_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanner.first_symbols(tables.bars_daily(spark, sf_dir), 7)


def refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir)
    fresh = scanner.freshness(bars, bars, bars.where(~F.col("symbol").endswith("3") | (F.col("ts") <= "2001-09-01")), bars.where("symbol <> 'N07'"), F.lit(CLOSE).cast("timestamp"))
    clean, features = scanner.refreshed(fresh, tables.raw_prices(spark, sf_dir))
    built = features.groupBy("symbol").agg(F.count("*").alias("features"))
    return clean.groupBy("symbol").agg(F.count("*").alias("clean"), F.round(F.sum("close"), 4).alias("closes")).join(built, "symbol", "left").select("symbol", "clean", "closes", (F.col("features") > 0).alias("built"))


def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir)
    fresh = scanner.freshness(bars, bars, bars, bars.where("symbol <> 'N07' or ts < '2001-01-01'"), F.lit(CLOSE).cast("timestamp"))
    reasons = fresh.select(F.when(F.col("stale"), "stale").when(F.col("symbol") < "N03", "missing_or_other").alias("bucket"))
    counts = scanner.skipped_by_reason(reasons).select(F.to_json("skipped").alias("skipped"))
    return scanner.overall(fresh).select("fresh", "stale").join(counts)


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bars_daily(spark, sf_dir).withColumn("volume_sma_20", F.avg("volume").over(last_rows(20))).withColumn("probability", F.col("prob_trade_success"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanner.decided(latest(_probed(spark, sf_dir)), 0.33)


def explained_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _probed(spark, sf_dir).withColumns({"ema_10": F.col("close"), "ema_20": F.col("open"), "macd": F.col("high"), "macd_signal": F.col("low"), "rsi_14": F.col("close") - 40, "sym_sentiment_d1": F.lit(None).cast("double"), "spy_sentiment_d1": F.lit(0.1)})
    importances = rows.groupBy(F.lit("close").alias("feature")).agg(F.lit(0.25).alias("importance")).unionByName(rows.groupBy(F.lit("open").alias("feature")).agg(F.lit(0.75).alias("importance")))
    out = scanner.explained_decisions(rows, 0.33, ["open", "high", "low", "close"], importances, magnitudes=3, bars=30)
    return out.select(
        "symbol", "should_trade", "reason", F.date_format("latest_bar", "yyyy-MM-dd").alias("day"), F.array_join("indicator_context_tags", ", ").alias("tags"),
        F.array_join(F.col("top_feature_magnitudes.feature"), ",").alias("magnitudes"), F.array_join(F.col("global_feature_importance.feature"), ",").alias("importances"),
        F.size("chart_history").alias("bars"), F.date_format(F.get("chart_history", F.lit(0))["ts"], "yyyy-MM-dd").alias("first_bar"),
    )


def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, _ = feature_tables(tables.bars_daily(spark, sf_dir))
    return scanner.chart_history(features).select("symbol", day(), *rounded([c for c in CHART if c not in ("ts", "volume")]))


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").select(
        "source", F.upper("source").alias("symbol"), F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("doc_id") / 2) * 60).alias("published_at"), F.col("doc_id").alias("article_id"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" Title "), F.col("doc_id").cast("string"))).alias("title"),
    )
    return scanner.evidence(scanner.headline_digest(rows), rows.where("article_id % 7 = 0 and source <> 'src1'"))


def rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(_probed(spark, sf_dir)).select(
        "symbol", "probability", F.lit(0.33).alias("threshold"), F.when(F.col("volume") % 4 != 0, F.col("close") / 50 - 2.15).alias("sentiment"), F.lit(None).cast("string").alias("regime"),
        F.lit(True).alias("has_news"), F.lit(True).alias("has_hits"), F.repeat(F.concat(F.col("symbol"), F.lit(" rises again. ")), 12).alias("titles"),
        F.filter(F.array(F.when(F.col("close") > F.col("open"), "up"), F.when(F.col("volume") % 2 == 0, "even"), F.lit("third"), F.lit("fourth")), lambda t: t.isNotNull()).alias("tags"),
    )
    return scanner.trade_analysis(rows).select("symbol", "rationale_brief", *rounded(["sentiment_adjustment", "adjusted_score"]))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("symbol").orderBy("ts")
    change = lambda a, b: F.try_divide(a, b) - 1
    bars = tables.bars_daily(spark, sf_dir)
    rows = bars.withColumn("return_1d", change(F.col("close"), F.lag("close").over(order))).withColumn("actual", change(F.lead("close").over(order), F.col("close")))
    return rows.where("return_1d is not null and actual is not null")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _returns(spark, sf_dir)
    model = models.estimator("linear_regression", ["return_1d"], label="actual").fit(rows)
    out = models.prediction_table(model, rows, "actual")
    return out.select("symbol", day(), "signal", *rounded(["predicted_return", "actual_return"]))


def stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a fitted model and of the same model after it was stored and read again."""
    columns = ["open", "close"]
    rows = walk_forward(trade_labels(tables.bars_daily(spark, sf_dir)), 250, 60, 60).drop("prob_trade_success")
    model = models.estimator("logistic_regression", columns, scaled=True).fit(rows.where("part = 'train' and split = 0"))
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    models.save_model(model, columns, path)
    again, names = models.load_model(path)
    # the first split's model scores the test rows of all splits
    test = rows.where("part = 'test'").select("split", "symbol", "ts", *names)
    both = models.with_probability(model, test, "before").join(models.with_probability(again, test, "after"), ["split", "symbol", "ts"])
    return both.agg(F.count("*").alias("bars"), F.count(F.when(F.col("before") == F.col("after"), 1)).alias("equal"))


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk_forward(trade_labels(tables.bars_daily(spark, sf_dir)), 250, 60, 60).where("part = 'test'").drop("part")


def split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _tests(spark, sf_dir)
    market = trading.market_growth(tests, ["split"]).withColumn("cum_market_return", F.col("cum_market_return") * 2)
    out = trading.backtest(trading.with_threshold(tests, [LEVEL]), "threshold", ["split", "threshold"], market=market)
    return out.select("split", "strategy_trade_count", *rounded(["cum_return", "cum_market_return", "win_rate", "max_drawdown"]))


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of an experiment whose scores are the probabilities of the table."""
    tests = _tests(spark, sf_dir)
    found = experiments.evaluated(tests)
    symbols = sorted(r["symbol"] for r in tests.select("symbol").distinct().collect())
    out = models.experiment_record("table_probability", "pooled", symbols, found.summary, found.best, 1)
    numbers = [c for c, t in out.dtypes if t == "double"]
    return out.select(*(c for c in out.columns if c not in numbers), *rounded(numbers))


QUERIES = {
    "s01_ohlcv": ohlcv_prices, "m14_training_dataset": training_dataset, "m15_inference_dataset": inference_dataset, "x5_latest_rows": latest_rows, "s11_stored_series": stored_series, "p09_shared_context": shared_context, "a19_stage_times": stage_times,
    "k8_first_symbols": first_symbols, "x3_refresh": refresh, "x2_overall": overall, "x8_decisions": decisions, "x9_explained_decisions": explained_decisions,
    "x14_chart_history": chart, "f25_headline_digest": digests, "x10_rationale": rationales, "m16_predictions": predictions,
    "m09_stored_model": stored_model, "b21_split_metrics": split_metrics, "m18_experiment": experiment,
}

_LATEST = f"{sql.BARS}, p AS (SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vs FROM bars), l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"
_REASON = """CASE WHEN prob_trade_success - 0.33 > 0
          THEN format('Signal emitted: model score {:.4f} is above threshold {:.4f} (margin +{:.4f}).', prob_trade_success, CAST(0.33 AS DOUBLE), prob_trade_success - CAST(0.33 AS DOUBLE))
          ELSE format('Signal omitted: model score {:.4f} is below/equal threshold {:.4f} (margin {:.4f}).', prob_trade_success, CAST(0.33 AS DOUBLE), prob_trade_success - CAST(0.33 AS DOUBLE)) END"""
_INDEX = ", ".join(f"{{0}}.{c}_z AS {{0}}_{c}_z" for c in ("return_1d", "return_5d", "volatility_20", "sma_20", "ema_trend_bull", "ema_slope_20"))
_INDEX += ", {0}.return_5d_z - {0}.return_1d_z AS {0}_return_5d_z_minus_1d_z"
_DATASET = f"""{sql.MARKET}, every AS (SELECT * FROM bars UNION ALL SELECT * FROM market),
{sql.features("every")},
{sql.z_scores()},
spy AS (SELECT * FROM scores WHERE symbol = 'SPY'), qqq AS (SELECT * FROM scores WHERE symbol = 'QQQ'),
v AS (SELECT *, avg(close_z) OVER w AS m, count(*) OVER w AS k FROM scores WHERE symbol = '^VIX' WINDOW w AS (ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
vix AS (SELECT ts AS vix_ts, close_z AS vix_level_z, return_1d_z AS vix_change_z, return_5d_z AS vix_return_5d_z, volatility_20_z AS vix_volatility_20_z,
  sma_20_z AS vix_sma_20_z, (close_z - m) / nullif(m, 0) AS vix_high_vol_z FROM v WHERE k >= 50),
held AS (SELECT s.*, {_INDEX.format("spy")}, {_INDEX.format("qqq")} FROM scores s JOIN spy USING (ts) JOIN qqq USING (ts) WHERE s.symbol NOT IN ('SPY', 'QQQ', '^VIX')),
ctx AS (SELECT * FROM held ASOF JOIN vix ON held.ts >= vix.vix_ts WHERE vix_high_vol_z IS NOT NULL),
whole AS (SELECT f.close, f.high, f.low, ctx.* FROM features f JOIN ctx USING (symbol, ts)),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS total FROM whole),
hits AS (SELECT a.symbol, a.rn, arg_min(CAST(b.high >= a.close * 1.08 AS INTEGER), b.rn) AS hit
  FROM n a JOIN n b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 15
  WHERE b.high >= a.close * 1.08 OR b.low <= a.close * 0.96 GROUP BY a.symbol, a.rn)"""
_RETURNS = f"""{sql.BARS}, r AS (SELECT symbol, ts, close / nullif(lag(close) OVER w, 0) - 1 AS x, lead(close) OVER w / nullif(close, 0) - 1 AS y FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
k AS (SELECT * FROM r WHERE x IS NOT NULL AND y IS NOT NULL), fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k),
p AS (SELECT symbol, ts, a + b * x AS p, y FROM k, fit)"""
_FRESH = f"""{sql.BARS}, c AS (SELECT symbol, max(ts) AS a, max(ts) FILTER (NOT (symbol LIKE '%3' AND ts > TIMESTAMP '2001-09-01')) AS b,
  max(ts) FILTER (symbol <> 'N07') AS d FROM bars GROUP BY symbol),
fresh AS (SELECT symbol, b IS NULL OR d IS NULL OR CAST(least(a, b, d) AS DATE) < DATE '{CLOSE}' AS stale FROM c),
own AS (SELECT symbol FROM fresh WHERE stale OR NOT EXISTS (SELECT 1 FROM fresh WHERE stale))"""
_CLAMP = "greatest({1}, least({2}, {0}))"
_MEANS = ["avg_cum_return", "avg_cum_market_return", "avg_profit_factor", "avg_win_rate", "avg_max_drawdown"]

ORACLE_SQL = {
    "s01_ohlcv": f"""WITH {sql.BARS} SELECT symbol, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS at, {sql.rounded(["open", "high", "low", "close"])}, volume FROM bars""",
    "m14_training_dataset": f"""WITH RECURSIVE {_DATASET} SELECT n.symbol, {DAY.replace("ts,", "n.ts,")}, CASE WHEN hit IS NOT NULL THEN hit ELSE 0 END AS trade_success,
        {sql.rounded(SHOWN)}, CAST({len(MODEL_VECTOR)} AS INTEGER) AS columns FROM n LEFT JOIN hits USING (symbol, rn) WHERE hit IS NOT NULL OR total - rn >= 15""",
    "m15_inference_dataset": f"""WITH RECURSIVE {_DATASET} SELECT symbol, CAST(year(ts) AS INTEGER) AS year, count(*) AS bars, strftime(max(ts), '%Y-%m-%d') AS last_day, round(sum(vix_level_z), 4) AS level
        FROM whole GROUP BY symbol, year(ts)""",
    "x5_latest_rows": f"""WITH RECURSIVE {_DATASET.split("whole AS", 1)[0].replace("held AS (SELECT s.*,", "last_z AS (SELECT * FROM scores WHERE NOT (symbol LIKE '%4' AND ts >= TIMESTAMP '2001-06-01') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1), held AS (SELECT s.*,").replace("FROM scores s JOIN spy", "FROM last_z s JOIN spy")}
        last_f AS (SELECT symbol, ts, close FROM features WHERE symbol NOT IN ('SPY', 'QQQ', '^VIX') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)
        SELECT f.symbol, strftime(f.ts, '%Y-%m-%d') AS latest_features, strftime(z.ts, '%Y-%m-%d') AS latest_scores, strftime(ctx.ts, '%Y-%m-%d') AS latest_context,
          CASE WHEN ctx.ts = f.ts THEN strftime(f.ts, '%Y-%m-%d') END AS latest_merged, CASE WHEN ctx.ts = f.ts THEN round(f.close, 6) END AS close,
          {", ".join(f"CASE WHEN ctx.ts = f.ts THEN round(ctx.{c}, 6) END AS {c}" for c in SHOWN)}
        FROM last_f f LEFT JOIN last_z z USING (symbol) LEFT JOIN ctx USING (symbol)""",
    "s11_stored_series": f"""WITH {sql.BARS}, f AS (SELECT symbol, ts, CASE WHEN count(*) OVER w >= 50 THEN avg(close) OVER w END AS sma_50, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS return_5d
          FROM bars WHERE dayofmonth(ts) <> 5 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
        SELECT symbol, {DAY}, {sql.rounded(["open", "close"])}, round(CAST(volume AS DOUBLE), 6) AS volume, {sql.rounded(["sma_50", "return_5d"])}, CASE WHEN symbol IN ('N03', 'N07') AND ts <= TIMESTAMP '1999-12-31' THEN true END AS listed
        FROM bars JOIN f USING (symbol, ts) WHERE sma_50 IS NOT NULL AND symbol < 'N20' AND ts <= TIMESTAMP '2000-12-31'""",
    "p09_shared_context": f"""WITH {sql.BARS} SELECT {DAY}, count(DISTINCT symbol) AS symbols, count(*) FILTER (symbol = 'N03') = 0 AS same
        FROM bars GROUP BY ts HAVING count(DISTINCT symbol) > 1""",
    "a19_stage_times": f"""WITH {sql.BARS}, e AS (SELECT symbol, max(ts) FILTER (dayofmonth(ts) % 2 = 0) AS f, max(ts) FILTER (symbol <> 'N07') AS s,
          max(ts) FILTER (symbol <> 'N07' AND dayofmonth(ts) < 20) AS c, max(ts) FILTER (symbol <> 'N07' AND dayofmonth(ts) < 20 AND dayofmonth(ts) % 2 = 0) AS m FROM bars GROUP BY symbol)
        SELECT symbol, strftime(f, '%Y-%m-%d') AS latest_features, strftime(s, '%Y-%m-%d') AS latest_scores, strftime(c, '%Y-%m-%d') AS latest_context,
          strftime(m, '%Y-%m-%d') AS latest_merged FROM e""",
    "k8_first_symbols": f"WITH {sql.BARS} SELECT DISTINCT symbol FROM bars ORDER BY symbol LIMIT 7",
    "x3_refresh": f"""WITH {CLEAN}, bars AS (SELECT 'N' || lpad(CAST(nation AS VARCHAR), 2, '0') AS symbol, ts FROM trades GROUP BY nation, ts),
        {_FRESH.split(",", 1)[1].split("GROUP BY nation, ts),", 1)[1]}
        SELECT symbol, count(*) AS clean, round(sum(close), 4) AS closes, CASE WHEN count(*) >= 200 THEN true END AS built FROM clean JOIN own USING (symbol) GROUP BY symbol""",
    "x2_overall": f"""WITH {sql.BARS}, c AS (SELECT symbol, max(ts) AS a, max(ts) FILTER (symbol <> 'N07' OR ts < TIMESTAMP '2001-01-01') AS d FROM bars GROUP BY symbol),
        f AS (SELECT symbol, d IS NULL OR CAST(least(a, d) AS DATE) < DATE '{CLOSE}' AS stale FROM c),
        k AS (SELECT count(*) FILTER (stale) AS s, count(*) FILTER (NOT stale AND symbol < 'N03') AS m FROM f)
        SELECT s = 0 AS fresh, s AS stale, '{{' || concat_ws(',', CASE WHEN m > 0 THEN '"missing_or_other":' || m END, CASE WHEN s > 0 THEN '"stale":' || s END) || '}}' AS skipped FROM k""",
    "x8_decisions": f"""WITH {_LATEST} SELECT symbol, prob_trade_success AS probability_trade_success, CAST(0.33 AS DOUBLE) AS threshold_used, prob_trade_success > 0.33 AS should_trade
        FROM l WHERE prob_trade_success IS NOT NULL""",
    "x9_explained_decisions": f"""WITH {_LATEST}, u AS (SELECT symbol, unnest(['open', 'high', 'low', 'close']) AS f, unnest([open, high, low, close]) AS v, unnest([0, 1, 2, 3]) AS i FROM l),
        t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(v) DESC, i) AS r FROM u), m AS (SELECT symbol, string_agg(f, ',' ORDER BY r) AS magnitudes FROM t WHERE r <= 3 GROUP BY symbol),
        h AS (SELECT symbol, count(*) AS bars, strftime(min(ts), '%Y-%m-%d') AS first_bar FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 30) GROUP BY symbol)
        SELECT symbol, prob_trade_success > 0.33 AS should_trade, {_REASON} AS reason, {DAY}, concat_ws(', ', CASE WHEN close > open THEN 'EMA short above long' ELSE 'EMA short below long' END,
          CASE WHEN high > low THEN 'MACD bullish' ELSE 'MACD bearish' END, CASE WHEN close - 40 >= 70 THEN 'RSI overbought' WHEN close - 40 <= 30 THEN 'RSI oversold' ELSE 'RSI neutral' END,
          CASE WHEN vs <> 0 THEN CASE WHEN volume > vs THEN 'Volume above 20D avg' ELSE 'Volume below 20D avg' END END, 'Market sentiment positive') AS tags,
          magnitudes, 'open,close' AS importances, CAST(bars AS INTEGER) AS bars, first_bar FROM l JOIN m USING (symbol) JOIN h USING (symbol)""",
    "x14_chart_history": f"""WITH RECURSIVE {sql.BARS}, {sql.features("bars")} SELECT symbol, {DAY}, {sql.rounded([c for c in CHART if c not in ("ts", "volume")])} FROM features""",
    "f25_headline_digest": """WITH n AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN 'Title ' || doc_id END AS title,
          row_number() OVER (PARTITION BY source ORDER BY doc_id // 2 DESC, doc_id DESC) AS r FROM documents)
        SELECT upper(source) AS symbol, coalesce(string_agg(title, ' | ' ORDER BY r) FILTER (r <= 3), 'No recent symbol headlines.') AS titles, true AS has_news,
          count(*) FILTER (doc_id % 7 = 0 AND source <> 'src1') AS hit_count, count(*) FILTER (doc_id % 7 = 0 AND source <> 'src1') > 0 AS has_hits FROM n GROUP BY source""",
    "x10_rationale": f"""WITH {_LATEST}, s AS (SELECT *, coalesce(CASE WHEN volume % 4 <> 0 THEN close / 50 - 2.15 END, 0) AS s, prob_trade_success AS p FROM l),
        a AS (SELECT *, {_CLAMP.format("s * 0.04", -0.06, 0.06)} AS sa FROM s), b AS (SELECT *, {_CLAMP.format("(p - 0.33) * 1.5 + sa", -1, 1)} AS cs FROM a),
        c AS (SELECT *, {_CLAMP.format("sa + " + _CLAMP.format("cs * 0.05", -0.08, 0.08), -0.1, 0.1)} AS fa FROM b)
        SELECT symbol, substring('Signal ' || CASE WHEN p > 0.33 THEN 'above' ELSE 'below' END || ' threshold; sentiment=' || CASE WHEN s > 0.15 THEN 'supportive' ELSE 'mixed/weak' END
          || '; technical=' || array_to_string(list_filter([CASE WHEN close > open THEN 'up' END, CASE WHEN volume % 2 = 0 THEN 'even' END, 'third', 'fourth'], lambda t: t IS NOT NULL)[1:3], ', ')
          || '; news=' || substring(repeat(symbol || ' rises again. ', 12), 1, 120), 1, 280) AS rationale_brief,
          round(sa, 6) AS sentiment_adjustment, round({_CLAMP.format("p + fa", 0, 1)}, 6) AS adjusted_score FROM c""",
    "m16_predictions": f"""WITH {_RETURNS} SELECT symbol, {DAY}, CASE WHEN p > 0.02 THEN 1 WHEN p < -0.02 THEN -1 ELSE 0 END AS signal, round(p, 6) AS predicted_return, round(y, 6) AS actual_return FROM p""",
    "m09_stored_model": f"WITH RECURSIVE {_GRID} SELECT count(*) AS bars, count(*) AS equal FROM tests",
    "b21_split_metrics": f"""WITH RECURSIVE {_GRID} SELECT CAST(split AS INTEGER) AS split, strategy_trade_count, round(cum_return, 6) AS cum_return, round(cum_market_return * 2, 6) AS cum_market_return,
        round(win_rate, 6) AS win_rate, round(max_drawdown, 6) AS max_drawdown FROM metrics WHERE threshold = {LEVEL}""",
    "m18_experiment": f"""WITH RECURSIVE {_GRID}, said AS (SELECT *, CAST(prob_trade_success > 0.5 AS INTEGER) AS c FROM tests),
        own AS (SELECT split, avg(abs(c - trade_success)) AS mae, avg(CAST(sign(c) = sign(trade_success) AS INTEGER)) AS da FROM said GROUP BY split),
        e AS (SELECT avg(mae) AS mae, avg(da) AS da FROM own),
        names AS (SELECT count(DISTINCT symbol) AS n_symbols, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM tests),
        hits_ AS (SELECT threshold, CAST(sum(strategy_directional_hits) AS BIGINT) AS total_hits FROM metrics GROUP BY threshold),
        t AS (SELECT whole.*, CASE WHEN total_trades >= min_trades THEN 0 ELSE 2 END AS tier FROM whole, floor_),
        best AS (SELECT * FROM t ORDER BY tier, {_CALMAR} DESC, threshold LIMIT 1)
        SELECT 'table_probability' AS model, 'pooled' AS symbol, CAST(n_symbols AS INTEGER) AS n_symbols, symbols, CAST(1 AS INTEGER) AS features, h.total_hits AS strategy_total_hits,
          b.total_trades AS strategy_total_trades, b.total_trades AS opt_total_trades, round(mae, 4) AS mae, round(da, 4) AS directional_accuracy,
          round(b.avg_cum_return, 6) AS cum_strategy_return, round(b.avg_cum_market_return, 6) AS cum_market_return, round(b.avg_cum_market_return, 6) AS cum_market_return_pooled_eqw,
          round(coalesce(100.0 * h.total_hits / nullif(b.total_trades, 0), 0), 6) AS directional_accuracy_strategy, round(b.avg_win_rate, 6) AS avg_win_rate, round(b.avg_profit_factor, 6) AS avg_profit_factor,
          round(b.avg_max_drawdown, 6) AS avg_max_drawdown, round(b.threshold, 6) AS best_threshold, round(b.avg_cum_return, 6) AS opt_avg_cum_return,
          round(b.avg_cum_market_return, 6) AS opt_avg_cum_market_return, round(b.avg_profit_factor, 6) AS opt_avg_profit_factor, round(b.avg_win_rate, 6) AS opt_avg_win_rate
        FROM e, names, best b JOIN hits_ h USING (threshold)""",
}
