"""Queries of the trading rule and the threshold search with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import backtest as ops
from marketloom.operators import thresholds
from marketloom.operators.labels import trade_labels, walk_forward
from marketloom.plans.context import LABELS
from marketloom.plans.features import DAY, day, rounded
from marketloom.session import shared_folder
from marketloom.sources import tables

LEVEL = 0.5
GRID = thresholds.GRID
SHORT = [f"avg_{m}" for m in ("cum_return", "cum_market_return", "profit_factor", "max_drawdown", "win_rate", "expectancy")] + ["median_cum_return", "min_cum_return"]


def _trades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = ops.numbered(tables.bars_daily(spark, sf_dir), ["symbol"])
    return bars, ops.trades(bars, ["symbol"], F.lit(LEVEL))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades(spark, sf_dir)[1].select("symbol", "entry_i", "exit_i", "hit", *rounded(["entry_price", "exit_price", "trade_return"]))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, found = _trades(spark, sf_dir)
    return ops.flagged(bars, found, ["symbol"], F.lit(LEVEL))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("symbol", day(), "signal", "entry_trade", "exit_trade", *rounded(["strategy_return", "entry_price", "exit_price"]))


def symbol_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.backtest(tables.bars_daily(spark, sf_dir), F.lit(LEVEL), by_symbol=True)
    counts = ["strategy_trade_count", "strategy_directional_hits"]
    return out.select("symbol", *counts, *rounded([c for c in out.columns if c not in [*counts, "symbol"]]))


def pooled_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.equity(_flags(spark, sf_dir), []).select(day(), *rounded(["portfolio_return", "cum_strategy_return"]))


def market_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir)
    curve = ops.market_curve(bars, [])
    out = ops.on_market_curve(bars, curve.where(F.dayofmonth("ts") > 3))
    # 0.0 is added so that no change is no negative zero
    return out.select("symbol", day(), *rounded(["cum_market_return"]), (F.round("market_return", 6) + F.lit(0.0)).alias("market_return"))


def pnl_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.pnl_table(_flags(spark, sf_dir))
    return out.select("symbol", "n", F.date_format("entry_ts", "yyyy-MM-dd").alias("entry_day"), F.date_format("exit_ts", "yyyy-MM-dd").alias("exit_day"), *rounded(["entry_price", "exit_price", "trade_return", "equity"]))


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = trade_labels(tables.bars_daily(spark, sf_dir))
    return walk_forward(bars, 250, 60, 60).where("part = 'test'").drop("part")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = thresholds.optimise(_tests(spark, sf_dir))
    return out.select("threshold", "total_trades", F.size("per_split").alias("splits"), *rounded([*SHORT, "avg_mae_at_threshold", "selection_score"]))


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = thresholds.optimise(_tests(spark, sf_dir))
    return out.select("threshold", "total_trades", "tier", *rounded(["selection_score"]))


def best_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = thresholds.optimise(_tests(spark, sf_dir), objective="risk_penalty", joint=True)
    return out.select("threshold", "max_rank", "k", *rounded(["mean_rank", "selection_score"]))


def floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.trade_floor(_tests(spark, sf_dir))


def objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold by each objective, over one grid."""
    tests = _tests(spark, sf_dir)
    shared_folder(spark)
    metrics = thresholds.grid_metrics(tests).checkpoint()
    out = None
    for name in thresholds.OBJECTIVES:
        _, best = thresholds.optimise(tests, name, metrics=metrics)
        own = best.select(F.lit(name).alias("objective"), "threshold", F.round("selection_score", 6).alias("selection_score"))
        out = own if out is None else out.unionByName(own)
    return out


QUERIES = {
    "b15_objectives": objectives,
    "b02_trades": trades,
    "b03_flagged_bars": flagged,
    "b12_symbol_metrics": symbol_metrics,
    "b04_pooled_equity": pooled_curve,
    "b08_market_curve": market_curve,
    "b22_pnl_table": pnl_table,
    "b13_threshold_grid": grid,
    "b17_best_threshold": best,
    "b18_joint_threshold": best_joint,
    "b16_trade_floor": floor,
}


def _walk(source: str, keys: list[str], level: str) -> str:
    """closed: closed trades of each series, by recursion over its bars. Needs WITH RECURSIVE."""
    k = ", ".join(keys)
    b = ", ".join(f"b.{c}" for c in keys)
    same = " AND ".join(f"b.{c} = r.{c}" for c in keys)
    late, won = "b.i > r.deadline", "b.high >= r.price * 1.08"
    lost = "b.low <= r.price * (1 - 0.04)"
    ends = f"(r.entry IS NOT NULL AND ({late} OR {won} OR {lost}))"
    opens = f"((r.entry IS NULL OR {ends}) AND b.sig)"
    stays = f"(r.entry IS NOT NULL AND NOT {ends})"
    return f"""series AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY {k}) - 1 AS last_i,
  prob_trade_success > {level} AS sig, (high + low) / 2 AS middle FROM {source}),
state AS (
  SELECT {k}, i, CASE WHEN sig THEN i END AS entry, CASE WHEN sig THEN close END AS price,
    CASE WHEN sig THEN least(i + 15, last_i) END AS deadline, middle,
    CAST(NULL AS BIGINT) AS entry_i, CAST(NULL AS BIGINT) AS exit_i, CAST(NULL AS DOUBLE) AS entry_price, CAST(NULL AS DOUBLE) AS exit_price,
    CAST(NULL AS DOUBLE) AS trade_return, CAST(NULL AS BOOLEAN) AS hit
  FROM series WHERE i = 0
  UNION ALL
  SELECT {b}, b.i, CASE WHEN {opens} THEN b.i WHEN {stays} THEN r.entry END, CASE WHEN {opens} THEN b.close WHEN {stays} THEN r.price END,
    CASE WHEN {opens} OR ({stays} AND b.sig) THEN least(b.i + 15, b.last_i) WHEN {stays} THEN r.deadline END, b.middle,
    CASE WHEN {ends} THEN r.entry END, CASE WHEN {ends} THEN CASE WHEN {late} THEN r.deadline ELSE b.i END END,
    CASE WHEN {ends} THEN r.price END,
    CASE WHEN {ends} THEN CASE WHEN {late} THEN r.middle WHEN {won} THEN r.price * 1.08 ELSE r.price * (1 - 0.04) END END,
    CASE WHEN {ends} THEN CASE WHEN {late} THEN r.middle / r.price - 1 WHEN {won} THEN 0.08 ELSE -0.04 END END,
    CASE WHEN {ends} THEN NOT {late} AND {won} END
  FROM state r JOIN series b ON {same} AND b.i = r.i + 1),
closed AS (
  SELECT {k}, entry_i, exit_i, entry_price, exit_price, trade_return, hit FROM state WHERE entry_i IS NOT NULL
  UNION ALL
  SELECT {k}, s.entry, s.deadline, s.price, s.middle, s.middle / s.price - 1, false FROM state s
  JOIN (SELECT {k}, max(i) AS i FROM series GROUP BY {k}) USING ({k}, i) WHERE s.entry IS NOT NULL)"""


def _metrics(keys: str, own: str) -> str:
    """metrics: of series by own, put together by keys."""
    g = f"GROUP BY {keys}" if keys else ""
    k = f"{keys}," if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""flags AS (SELECT s.*, coalesce(t.trade_return, 0) AS strategy_return FROM series s
  LEFT JOIN closed t ON {" AND ".join(f"t.{c} = s.{c}" for c in own.split(", "))} AND t.entry_i = s.i),
eq AS (SELECT {k} ts, avg(strategy_return) AS portfolio_return FROM flags GROUP BY {k} ts),
curve AS (SELECT *, exp(sum(ln(1 + portfolio_return)) OVER ({part} ORDER BY ts)) AS c FROM eq),
peaks AS (SELECT *, (c - max(c) OVER ({part} ORDER BY ts)) / max(c) OVER ({part} ORDER BY ts) AS dd FROM curve),
risk AS (SELECT {k} min(dd) AS max_drawdown, arg_max(c, ts) AS cum_return FROM peaks {g}),
normed AS (SELECT *, close / first_value(close) OVER (PARTITION BY {own} ORDER BY ts) AS nc FROM series),
market AS (SELECT {k} arg_max(m, ts) AS cum_market_return FROM (SELECT {k} ts, avg(nc) AS m FROM normed GROUP BY {k} ts) {g}),
tm AS (SELECT {k} count(*) AS strategy_trade_count, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS strategy_directional_hits,
    avg(CAST(trade_return > 0 AS INTEGER)) AS win_rate, avg(trade_return) AS expectancy, avg(CAST(hit AS INTEGER)) * 100 AS directional_accuracy,
    coalesce(sum(trade_return) FILTER (trade_return > 0), 0) AS gains, abs(coalesce(sum(trade_return) FILTER (trade_return < 0), 0)) AS losses
  FROM closed {g}),
metrics AS (SELECT {k} coalesce(strategy_trade_count, 0) AS strategy_trade_count, coalesce(strategy_directional_hits, 0) AS strategy_directional_hits,
    coalesce(win_rate, 0) AS win_rate, coalesce(expectancy, 0) AS expectancy, coalesce(directional_accuracy, 0) AS directional_accuracy,
    CASE WHEN losses > 1e-12 THEN gains / losses WHEN gains > 0 THEN 999 ELSE 0 END AS profit_factor,
    CASE WHEN strategy_trade_count > 0 THEN max_drawdown ELSE 0 END AS max_drawdown, cum_return, cum_market_return
  FROM risk LEFT JOIN tm {using} JOIN market {using})"""


_ALL = f"{LABELS}, {_walk('bars', ['symbol'], str(LEVEL))}"
_FLAGS = f"""{_ALL}, ex AS (SELECT symbol, exit_i, arg_max(exit_price, entry_i) AS exit_price FROM closed GROUP BY symbol, exit_i),
flags AS (SELECT s.symbol, s.ts, s.i, CAST(sig AS INTEGER) AS signal, coalesce(t.trade_return, 0) AS strategy_return, t.entry_price,
    CAST(t.entry_i IS NOT NULL AS INTEGER) AS entry_trade, ex.exit_price, CAST(ex.exit_i IS NOT NULL AS INTEGER) AS exit_trade
  FROM series s LEFT JOIN closed t ON t.symbol = s.symbol AND t.entry_i = s.i LEFT JOIN ex ON ex.symbol = s.symbol AND ex.exit_i = s.i)"""
_GRID = f"""{LABELS},
known AS (SELECT bars.*, trade_success FROM bars JOIN labels USING (symbol, ts) WHERE trade_success IS NOT NULL),
d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS di, count(*) OVER () AS dn FROM (SELECT DISTINCT ts FROM known)),
sp AS (SELECT unnest(range(0, CAST((max(dn) - 310) // 60 + 1 AS BIGINT))) AS split FROM d),
tests AS (SELECT known.*, split FROM known JOIN d USING (ts) JOIN sp ON di >= split * 60 + 250 AND di < split * 60 + 310),
levels AS (SELECT unnest({GRID!r}) AS threshold),
rows_ AS (SELECT * FROM tests CROSS JOIN levels),
{_walk("rows_", ["split", "threshold", "symbol"], "threshold")},
{_metrics("split, threshold", "split, threshold, symbol")},
mae AS (SELECT threshold, avg(e) AS avg_mae_at_threshold FROM (SELECT threshold, split,
  avg(abs(trade_success - CAST(prob_trade_success > threshold AS INTEGER))) AS e FROM rows_ GROUP BY threshold, split) GROUP BY threshold),
grid AS (SELECT threshold, CAST(sum(strategy_trade_count) AS BIGINT) AS total_trades, CAST(count(*) AS INTEGER) AS splits, avg(cum_return) AS avg_cum_return,
  median(cum_return) AS median_cum_return, min(cum_return) AS min_cum_return, avg(cum_market_return) AS avg_cum_market_return,
  avg(profit_factor) AS avg_profit_factor, avg(max_drawdown) AS avg_max_drawdown, avg(win_rate) AS avg_win_rate, avg(expectancy) AS avg_expectancy,
  avg(directional_accuracy) AS avg_directional_accuracy_strategy FROM metrics GROUP BY threshold),
whole AS (SELECT * FROM grid JOIN mae USING (threshold)),
floor_ AS (SELECT CAST(sum(n) AS BIGINT) AS trading_days, CAST(greatest(5, ceil(sum(n) / 42)) AS INTEGER) AS min_trades
  FROM (SELECT split, count(DISTINCT ts) AS n FROM tests GROUP BY split))"""
_CALMAR = "(avg_cum_return - 1) / greatest(1e-6, abs(avg_max_drawdown))"
_R = "rank() OVER (ORDER BY {} DESC)"
_RANKS = [_R.format(m) for m in thresholds.METRICS[:-1]] + ["rank() OVER (ORDER BY avg_mae_at_threshold)"]

ORACLE_SQL = {
    "b02_trades": f"""WITH RECURSIVE {_ALL} SELECT symbol, CAST(entry_i AS INTEGER) AS entry_i, CAST(exit_i AS INTEGER) AS exit_i, hit,
        round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(trade_return, 6) AS trade_return FROM closed""",
    "b03_flagged_bars": f"""WITH RECURSIVE {_FLAGS} SELECT symbol, {DAY}, signal, entry_trade, exit_trade, round(strategy_return, 6) AS strategy_return,
        round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price FROM flags""",
    "b12_symbol_metrics": f"""WITH RECURSIVE {_ALL}, {_metrics("symbol", "symbol")} SELECT symbol, strategy_trade_count, strategy_directional_hits,
        round(win_rate, 6) AS win_rate, round(expectancy, 6) AS expectancy, round(expectancy, 6) AS average_trade_return, round(directional_accuracy, 6) AS directional_accuracy,
        round(profit_factor, 6) AS profit_factor, round(max_drawdown, 6) AS max_drawdown, round(cum_return, 6) AS cum_return,
        round(cum_market_return, 6) AS cum_market_return FROM metrics""",
    "b04_pooled_equity": f"""WITH RECURSIVE {_FLAGS}, eq AS (SELECT ts, avg(strategy_return) AS r FROM flags GROUP BY ts)
        SELECT {DAY}, round(r, 6) AS portfolio_return, round(exp(sum(ln(1 + r)) OVER (ORDER BY ts)), 6) AS cum_strategy_return FROM eq""",
    "b08_market_curve": f"""WITH {LABELS}, m AS (SELECT ts, avg(nc) AS market FROM (SELECT ts, close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS nc FROM bars)
          GROUP BY ts HAVING dayofmonth(ts) > 3),
        j AS (SELECT bars.symbol, bars.ts, market FROM bars LEFT JOIN m USING (ts)),
        f AS (SELECT symbol, ts, coalesce(last_value(market IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts),
          first_value(market IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS c FROM j)
        SELECT symbol, {DAY}, round(c, 6) AS cum_market_return,
          round(coalesce(c / lag(c) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0), 6) + CAST(0 AS DOUBLE) AS market_return FROM f""",
    "b22_pnl_table": f"""WITH RECURSIVE {_FLAGS},
        e AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM flags WHERE entry_trade = 1),
        x AS (SELECT symbol, ts AS exit_ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM flags WHERE exit_trade = 1)
        SELECT symbol, CAST(n AS INTEGER) AS n, strftime(e.ts, '%Y-%m-%d') AS entry_day, strftime(exit_ts, '%Y-%m-%d') AS exit_day,
          round(entry_price, 6) AS entry_price, round(entry_price * (1 + strategy_return), 6) AS exit_price, round(strategy_return, 6) AS trade_return,
          round(exp(sum(ln(1 + strategy_return)) OVER (PARTITION BY symbol ORDER BY n)), 6) AS equity FROM e JOIN x USING (symbol, n)""",
    "b13_threshold_grid": f"""WITH RECURSIVE {_GRID} SELECT threshold, total_trades, splits, {", ".join(f"round({c}, 6) AS {c}" for c in [*SHORT, "avg_mae_at_threshold"])},
        round({_CALMAR}, 6) AS selection_score FROM whole""",
    "b17_best_threshold": f"""WITH RECURSIVE {_GRID}, t AS (SELECT *, CASE WHEN total_trades >= min_trades THEN 0 ELSE 2 END AS tier FROM whole, floor_)
        SELECT threshold, total_trades, tier, round({_CALMAR}, 6) AS selection_score FROM t ORDER BY tier, {_CALMAR} DESC, threshold LIMIT 1""",
    "b18_joint_threshold": f"""WITH RECURSIVE {_GRID}, p AS (SELECT *, (avg_cum_return - 1) - abs(avg_max_drawdown) AS s FROM whole, floor_ WHERE total_trades >= min_trades),
        r AS (SELECT threshold, s, CAST(greatest({", ".join(_RANKS)}) AS INTEGER) AS max_rank, ({" + ".join(_RANKS)}) / 6.0 AS mean_rank FROM p),
        k AS (SELECT *, CAST(greatest(3, min(max_rank) OVER ()) AS INTEGER) AS k FROM r)
        SELECT threshold, max_rank, k, round(mean_rank, 6) AS mean_rank, round(s, 6) AS selection_score FROM k WHERE max_rank <= k
        ORDER BY mean_rank, s DESC, threshold LIMIT 1""",
    "b15_objectives": f"""WITH RECURSIVE {_GRID}, t AS (SELECT *, CASE WHEN total_trades >= min_trades THEN 0 ELSE 2 END AS tier FROM whole, floor_),
        o AS (SELECT unnest({thresholds.OBJECTIVES!r}) AS objective, unnest([avg_cum_return, median_cum_return, min_cum_return, avg_cum_return - 1 - abs(avg_max_drawdown), {_CALMAR}]) AS score, threshold, tier FROM t)
        SELECT objective, threshold, round(score, 6) AS selection_score FROM o QUALIFY row_number() OVER (PARTITION BY objective ORDER BY tier, score DESC, threshold) = 1""",
    "b16_trade_floor": f"WITH RECURSIVE {_GRID} SELECT trading_days, min_trades FROM floor_",
}
