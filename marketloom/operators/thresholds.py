"""Threshold grid: the trading rule over splits and thresholds as one job, and the choice of a threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.backtest import grid_backtest

GRID = [round(0.05 * i, 2) for i in range(1, 17)]
OBJECTIVES = ["avg_cum_return", "median_cum_return", "maximin_cum_return", "risk_penalty", "calmar_proxy"]
#: Metrics that the joint choice ranks by; of the last one less is better.
METRICS = ["avg_cum_return", "avg_profit_factor", "avg_win_rate", "avg_directional_accuracy_strategy", "avg_max_drawdown", "avg_mae_at_threshold"]
LESS_IS_BETTER = "avg_mae_at_threshold"
TRADING_DAYS = 42


def grid_metrics(tests: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(split, threshold, metrics) of each split's test bars, all thresholds in one pass."""
    return grid_backtest(tests, ["split"], thresholds or GRID)


def mean_errors(tests: DataFrame, thresholds: list[float] | None = None, actual: str = "trade_success") -> DataFrame:
    """(threshold, avg_mae_at_threshold): mean over splits of the mean |actual - (probability > threshold)|."""
    levels = thresholds or GRID
    error = lambda t: F.avg(F.abs(F.col(actual) - (F.col("prob_trade_success") > t).cast("int")))
    each = tests.groupBy("split").agg(F.array(*(F.struct(F.lit(t).alias("threshold"), error(t).alias("e")) for t in levels)).alias("a"))
    return each.select(F.inline("a")).groupBy("threshold").agg(F.avg("e").alias(LESS_IS_BETTER))


def finite(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def over_splits(metrics: DataFrame) -> DataFrame:
    """A row for each threshold: means, median and least over splits (missing values left out), trades in all."""
    mean = lambda c, name, default=0.0: F.coalesce(F.avg(finite(c)), F.lit(default)).alias(name)
    return metrics.groupBy("threshold").agg(
        mean("cum_return", "avg_cum_return", 1.0),
        F.coalesce(F.median(finite("cum_return")), F.lit(1.0)).alias("median_cum_return"),
        F.coalesce(F.min(finite("cum_return")), F.lit(1.0)).alias("min_cum_return"),
        mean("cum_market_return", "avg_cum_market_return", 1.0),
        mean("profit_factor", "avg_profit_factor"),
        mean("max_drawdown", "avg_max_drawdown"),
        mean("win_rate", "avg_win_rate"),
        mean("expectancy", "avg_expectancy"),
        mean("directional_accuracy", "avg_directional_accuracy_strategy"),
        F.sum("strategy_trade_count").alias("total_trades"),
        F.sum("strategy_directional_hits").alias("total_hits"),
        F.array_sort(F.collect_list(F.struct("split", "cum_return", "cum_market_return"))).alias("per_split"),
    )


def selection_score(objective: str, lambda_dd: float = 1.0, eps: float = 1e-6) -> Column:
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective}; expected one of {', '.join(OBJECTIVES)}")
    excess, down = F.col("avg_cum_return") - 1, F.abs("avg_max_drawdown")
    return {
        "avg_cum_return": F.col("avg_cum_return"),
        "median_cum_return": F.col("median_cum_return"),
        "maximin_cum_return": F.col("min_cum_return"),
        "risk_penalty": excess - lambda_dd * down,
        "calmar_proxy": excess / F.greatest(F.lit(eps), down),
    }[objective]


def trade_floor(tests: DataFrame, least: int = 5, days: int = TRADING_DAYS) -> DataFrame:
    """One row: trading days of all splits and the least number of trades asked for."""
    total = tests.groupBy("split").agg(F.countDistinct("ts").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("trading_days"))
    scaled = F.greatest(F.lit(least), F.ceil(F.col("trading_days") / max(days, 1)), F.lit(1))
    return total.withColumn("min_trades", F.when(F.col("trading_days") > 0, scaled).otherwise(least).cast("int"))


def eligible(grid: DataFrame, floor: DataFrame, least_factor: float | None = None, most_drawdown: float | None = None) -> DataFrame:
    """Rows of the best tier there is: 0 enough trades and within the limits, 1 enough trades, 2 any. A grid is a few rows."""
    limits = F.lit(True)
    if least_factor is not None:
        limits = limits & (F.col("avg_profit_factor") >= least_factor)
    if most_drawdown is not None:
        limits = limits & (F.abs("avg_max_drawdown") <= most_drawdown)
    need = floor.first()["min_trades"]
    enough = F.col("total_trades") >= need
    tier = F.when(enough & limits, 0).when(enough, 1).otherwise(2)
    return grid.withColumn("tier", tier).withColumn("__best", F.min("tier").over(Window.partitionBy(F.lit(0)))).where("tier = __best").drop("__best")


def steady(c: str) -> Column:
    """A number to nine places and ten digits, for comparisons alone.

    Thresholds that no probability lies between have the same trades, but sums of doubles that end a last place apart by the
    order of their rows: they are equal here, so that the order behind them decides.
    """
    return F.when(F.col(c).isNotNull(), F.format_string("%.9e", F.round(c, 9)).cast("double"))


def best_single(pool: DataFrame) -> DataFrame:
    return pool.orderBy(F.desc(steady("selection_score")), "threshold").limit(1)


def ranks(pool: DataFrame, metrics: list[str]) -> DataFrame:
    """<metric>_rank, ties at the lowest rank, null worst; max_rank and mean_rank."""
    one = Window.partitionBy(F.lit(0))
    order = lambda m: F.asc_nulls_last(steady(m)) if m == LESS_IS_BETTER else F.desc_nulls_last(steady(m))
    out = pool.withColumns({f"{m}_rank": F.rank().over(one.orderBy(order(m))) for m in metrics})
    columns = [F.col(f"{m}_rank") for m in metrics]
    most = F.greatest(*columns) if len(columns) > 1 else columns[0]
    return out.withColumn("max_rank", most).withColumn("mean_rank", reduce(Column.__add__, columns) / len(columns))


def best_joint(pool: DataFrame, metrics: list[str] | None = None, k_start: int = 3, k_max: int = 16) -> DataFrame:
    """The row with the least mean rank among those within the smallest K on every metric; k is null if no K serves."""
    ranked = ranks(pool, metrics or METRICS)
    k = F.greatest(F.min("max_rank").over(Window.partitionBy(F.lit(0))), F.lit(k_start))
    ranked = ranked.withColumn("k", F.when(k <= k_max, k))
    within = ranked.where(F.col("k").isNull() | (F.col("max_rank") <= F.col("k")))
    return within.orderBy("mean_rank", F.when(F.col("k").isNotNull(), -steady("selection_score")), "threshold").limit(1)


def optimise(tests: DataFrame, objective: str = "calmar_proxy", joint: bool = False, thresholds: list[float] | None = None, least_trades: int = 5, metrics: DataFrame | None = None, **limits: float) -> tuple[DataFrame, DataFrame]:
    """(grid, best row). metrics: those of grid_metrics() where they are there already."""
    grid = over_splits(grid_metrics(tests, thresholds) if metrics is None else metrics).withColumn("selection_score", selection_score(objective))
    grid = grid.join(mean_errors(tests, thresholds), "threshold", "left")
    pool = eligible(grid, trade_floor(tests, least_trades), **limits)
    return grid, best_joint(pool) if joint else best_single(pool)
