"""Tables behind reports on backtests: summaries, curves, explained rows, trades of artifacts without exit flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.windows import growth, up_to_now
from marketloom.operators.scanner import context_tags, explanation

#: Indicators that the tags read (fixed values).
INDICATORS = ["ema_10", "ema_20", "macd", "macd_signal", "rsi_14", "volume", "volume_sma_20", "sym_sentiment_d1", "spy_sentiment_d1"]


def is_signal() -> Column:
    return F.coalesce(F.expr("try_cast(signal AS DOUBLE)") == 1, F.lit(False))


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    """all, omissions (rows without a signal) or signals."""
    if kind not in ("all", "omissions", "signals"):
        raise ValueError(f"unknown kind of rows {kind}")
    return rows if kind == "all" else rows.where(is_signal() if kind == "signals" else ~is_signal())


def with_indicators(rows: DataFrame, indicators: DataFrame) -> DataFrame:
    """Rows with the stored indicators of their symbol and instant in place of their own."""
    stored = [c for c in indicators.columns if c not in ("symbol", "ts")]
    return rows.drop(*stored).join(indicators, ["symbol", "ts"], "left")


def preferring_stored(rows: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with columns of the stored table where it has them, else their own."""
    named = stored.select("symbol", "ts", *(F.col(c).alias(f"__{c}") for c in columns))
    out = rows.join(named, ["symbol", "ts"], "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns})
    return out.drop(*(f"__{c}" for c in columns))


def explained(rows: DataFrame, threshold: float | None, names: tuple[str, ...] = ("prob_trade_success", "probability_trade_success")) -> DataFrame:
    """(ts, symbol, signal, reason, indicator_explanation): the score against the threshold and the indicators' tags."""
    there = [F.col(c).cast("double") for c in names if c in rows.columns]
    p = F.coalesce(*there, F.lit(None).cast("double")) if there else F.lit(None).cast("double")
    reason = F.coalesce(explanation(p, F.lit(threshold)), F.lit("No model score in artifact; see indicator explanation.")) if threshold is not None else F.lit("No model score in artifact; see indicator explanation.")
    full = rows.withColumns({c: F.lit(None).cast("double") for c in INDICATORS if c not in rows.columns})
    tags = F.coalesce(F.nullif(F.array_join(context_tags(), ", "), F.lit("")), F.lit("No indicator context available."))
    return full.select("ts", "symbol", is_signal().cast("int").alias("signal"), reason.alias("reason"), tags.alias("indicator_explanation"))


def common_reasons(rows: DataFrame) -> DataFrame:
    """(reason, count) of rows without a signal, most common first."""
    return rows.where("signal <> 1").groupBy("reason").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "reason")


def split_summary(rows: DataFrame) -> DataFrame:
    """(split, cum_strategy_end, cum_market_end, signal_rows, rows) of flagged rows with both curves."""
    return rows.groupBy("split").agg(
        F.max_by("cum_strategy_return", "ts").alias("cum_strategy_end"), F.max_by("cum_market_return", "ts").alias("cum_market_end"),
        F.sum(is_signal().cast("long")).alias("signal_rows"), F.count("*").alias("rows"),
    )


def summary_means(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("splits"), F.avg("cum_strategy_end").alias("cum_strategy_end"), F.avg("cum_market_end").alias("cum_market_end"))


def symbol_curves(rows: DataFrame) -> DataFrame:
    """(symbol, ts, strategy, market): each symbol's compounded returns and its close over the first known one, gaps filled."""
    # the next value, looked for backwards so that the frame only grows
    back = Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("close", ignorenulls=True).over(whole)
    normed = rows.withColumn("__n", F.when(first > 1e-12, F.col("close") / first).otherwise(1.0))
    market = F.coalesce(F.last("__n", ignorenulls=True).over(up_to_now()), F.last("__n", ignorenulls=True).over(back), F.lit(1.0))
    return normed.select("symbol", "ts", growth(F.coalesce("strategy_return", F.lit(0.0)), up_to_now()).alias("strategy"), market.alias("market"))


def grid_series(grid: DataFrame) -> DataFrame:
    """(threshold, split, cum_return, cum_market_return) of grid rows with their splits nested."""
    return grid.select("threshold", F.explode("per_split").alias("s")).select("threshold", "s.split", "s.cum_return", "s.cum_market_return")


def trades_without_exits(flags: DataFrame) -> DataFrame:
    """(symbol, entry_ts, exit_ts, entry_price, exit_price, trade_return, equity) where only entries are flagged.

    A trade is taken to end on the next bar; entries with a null or infinite return are left out.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    nearby = flags.withColumns({"exit_ts": F.lead("ts").over(w), "__next": F.lead("close").over(w)})
    r = F.col("strategy_return")
    entries = nearby.where("entry_trade = 1").where(r.isNotNull() & ~F.isnan(r) & (F.abs(r) < float("inf")))
    price = F.coalesce("entry_price", "close")
    return entries.select(
        "symbol", F.col("ts").alias("entry_ts"), "exit_ts", price.alias("entry_price"), F.coalesce(price * (1 + r), "__next").alias("exit_price"),
        r.alias("trade_return"), growth(r, up_to_now()).alias("equity"),
    )
