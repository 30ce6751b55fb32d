"""Queries of report tables with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import reports
from marketloom.operators.backtest import equity, market_curve
from marketloom.plans import sql
from marketloom.plans.backtest import _FLAGS, _flags
from marketloom.plans.features import DAY, day, rounded
from marketloom.sources.tables import bars_daily

SPLIT = "CAST(year(ts) AS INTEGER)"


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars_daily(spark, sf_dir).withColumns({"signal": (F.col("prob_trade_success") > 0.6).cast("int"), "ema_10": F.col("close"), "ema_20": F.col("open")})
    out = reports.explained(reports.of_kind(rows, "omissions"), 0.6)
    return out.select("symbol", day(), "signal", "reason", "indicator_explanation")


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars_daily(spark, sf_dir).withColumn("signal", (F.col("prob_trade_success") > 0.6).cast("int"))
    return reports.common_reasons(reports.explained(rows, 0.6))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flags(spark, sf_dir)
    both = rows.join(equity(rows, []), "ts").join(market_curve(rows, []).withColumnRenamed("market", "cum_market_return"), "ts")
    out = reports.split_summary(both.withColumn("split", F.year("ts")))
    return out.select("split", "signal_rows", "rows", *rounded(["cum_strategy_end", "cum_market_end"]))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flags(spark, sf_dir).withColumn("close", F.when(F.dayofmonth("ts") > 2, F.col("close")))
    return reports.symbol_curves(rows).select("symbol", day(), *rounded(["strategy", "market"]))


def legacy_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.trades_without_exits(_flags(spark, sf_dir))
    return out.select("symbol", F.date_format("entry_ts", "yyyy-MM-dd").alias("entry_day"), F.date_format("exit_ts", "yyyy-MM-dd").alias("exit_day"), *rounded(["entry_price", "exit_price", "trade_return", "equity"]))


def stored_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_daily(spark, sf_dir)
    stored = bars.where("volume % 2 = 0").select("symbol", "ts", (F.col("close") + 1).alias("close"))
    return reports.preferring_stored(bars, stored, ["close"]).select("symbol", day(), *rounded(["close"]))


QUERIES = {
    "b28_explained_rows": explained,
    "a16_common_reasons": reasons,
    "a18_split_summary": summary,
    "b25_symbol_curves": curves,
    "b23_trades_without_exits": legacy_trades,
    "j10_stored_indicators": stored_first,
}

_P = "prob_trade_success"
_MARGIN = f"{_P} - CAST(0.6 AS DOUBLE)"
_BELOW = f"format('Signal omitted: model score {{:.4f}} is below/equal threshold {{:.4f}} (margin {{:.4f}}).', {_P}, CAST(0.6 AS DOUBLE), {_MARGIN})"
_SERIES = f"""{_FLAGS}, f AS (SELECT flags.*, series.close FROM flags JOIN series USING (symbol, ts))"""
ORACLE_SQL = {
    "b28_explained_rows": f"""WITH {sql.BARS} SELECT symbol, {DAY}, 0 AS signal, {_BELOW} AS reason,
        CASE WHEN close > open THEN 'EMA short above long' ELSE 'EMA short below long' END AS indicator_explanation FROM bars WHERE NOT {_P} > 0.6""",
    "a16_common_reasons": f"WITH {sql.BARS} SELECT {_BELOW} AS reason, count(*) AS count FROM bars WHERE NOT {_P} > 0.6 GROUP BY 1",
    "a18_split_summary": f"""WITH RECURSIVE {_SERIES},
        eq AS (SELECT ts, exp(sum(ln(1 + r)) OVER (ORDER BY ts)) AS c FROM (SELECT ts, avg(strategy_return) AS r FROM f GROUP BY ts)),
        m AS (SELECT ts, avg(nc) AS m FROM (SELECT ts, close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS nc FROM f) GROUP BY ts)
        SELECT {SPLIT} AS split, CAST(sum(signal) AS BIGINT) AS signal_rows, count(*) AS rows, round(arg_max(c, ts), 6) AS cum_strategy_end,
          round(arg_max(m, ts), 6) AS cum_market_end FROM f JOIN eq USING (ts) JOIN m USING (ts) GROUP BY 1""",
    "b25_symbol_curves": f"""WITH RECURSIVE {_SERIES}, g AS (SELECT *, CASE WHEN dayofmonth(ts) > 2 THEN close END AS k FROM f),
        nn AS (SELECT *, k / first_value(k IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nk FROM g)
        SELECT symbol, {DAY}, round(exp(sum(ln(1 + strategy_return)) OVER (PARTITION BY symbol ORDER BY ts)), 6) AS strategy,
          round(coalesce(last_value(nk IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts),
            first_value(nk IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS market FROM nn""",
    "b23_trades_without_exits": f"""WITH RECURSIVE {_SERIES}, x AS (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS exit_ts FROM f)
        SELECT symbol, strftime(ts, '%Y-%m-%d') AS entry_day, strftime(exit_ts, '%Y-%m-%d') AS exit_day, round(entry_price, 6) AS entry_price,
          round(entry_price * (1 + strategy_return), 6) AS exit_price, round(strategy_return, 6) AS trade_return,
          round(exp(sum(ln(1 + strategy_return)) OVER (PARTITION BY symbol ORDER BY ts)), 6) AS equity FROM x WHERE entry_trade = 1""",
    "j10_stored_indicators": f"WITH {sql.BARS} SELECT symbol, {DAY}, round(CASE WHEN volume % 2 = 0 THEN close + 1 ELSE close END, 6) AS close FROM bars",
}
