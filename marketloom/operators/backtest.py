"""The trading rule as a table operator: bars with probabilities in, trades and flagged bars out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.batches import doubles, series_cuts
from marketloom.functions.windows import growth, running
from marketloom.schemas import HOLD, STOP_LOSS, TAKE_PROFIT
from marketloom.session import shared_folder

PROBABILITY = "prob_trade_success"


@dataclass
class OpenTrade:
    """The open trade of a series: where it began, its deadline and the middle of the last bar seen in its window."""

    entry: int
    price: float
    deadline: int
    middle: float


class Walker:
    """State of one series between batches: at most one open trade, whatever the series' length."""

    def __init__(self, hold: int, profit: float, stop: float) -> None:
        self.hold, self.profit, self.stop = hold, profit, stop
        self.open: OpenTrade | None = None
        self.last = -1

    def _expired(self, at: int) -> tuple:
        """The end of a trade at its deadline; one whose bar there has no price ends at its own price."""
        t = self.open
        middle = t.middle if np.isfinite(t.middle) else t.price
        ret = middle / t.price - 1 if t.price > 1e-12 else 0.0
        return t.entry, at, t.price, middle, ret, False

    def feed(self, i: np.ndarray, close: np.ndarray, high: np.ndarray, low: np.ndarray, middle: np.ndarray, signal: np.ndarray) -> list[tuple]:
        """Trades that end in these bars. Missing prices hit nothing."""
        done, up, down = [], 1 + self.profit, 1 - self.stop
        for at, price, top, bottom, mid, on in zip(*(x.tolist() for x in (i, close, high, low, middle, signal)), strict=True):
            t = self.open
            if t is not None:
                if at > t.deadline:
                    ended = self._expired(t.deadline)
                elif top >= t.price * up:
                    ended = t.entry, at, t.price, t.price * up, self.profit, True
                elif bottom <= t.price * down:
                    ended = t.entry, at, t.price, t.price * down, -self.stop, False
                else:
                    ended = None
                    # a signal in an open trade renews its deadline; the middle is that of the last bar in its window
                    t.middle = mid
                    if on:
                        t.deadline = at + self.hold
                if ended:
                    done.append(ended)
                    self.open = None
            if on and self.open is None:
                self.open = OpenTrade(at, price, at + self.hold, mid)
        if len(i):
            self.last = int(i[-1])
        return done

    def finish(self) -> list[tuple]:
        """A trade that is open at the series' end, which is no later than its deadline's bar."""
        return [self._expired(min(self.open.deadline, self.last))] if self.open else []


def numbered(bars: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Bars with i, their 0-based place in each series: by ts, and among equal times by row_seq where there is one."""
    by = order or ("ts", *(c for c in ("row_seq",) if c in bars.columns))
    return bars.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1)


def middle_price() -> Column:
    """The middle of high and low where both are finite numbers, else a finite close, else null."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite("high") & finite("low"), (F.col("high") + F.col("low")) / 2).when(finite("close"), F.col("close"))


def trades(bars: DataFrame, keys: list[str], threshold: Column | str, hold: int = HOLD, profit: float = TAKE_PROFIT, stop: float = STOP_LOSS) -> DataFrame:
    """(keys, entry_i, exit_i, entry_price, exit_price, trade_return, hit) for each closed trade.

    bars: keys, i, close, high, low, prob_trade_success, one series for each key. At most one trade
    is open: a probability over the threshold opens one at the close or renews its deadline of hold
    bars; the profit is tested before the stop from the next bar on, a trade past its deadline ends
    at the middle of the deadline's bar (or its close, or its own price where the bar has none), one
    left open at the series' end likewise.
    Series come sorted, batch after batch, and leave one open trade as state between batches.
    """
    level = F.col(threshold) if isinstance(threshold, str) else threshold
    signal = F.coalesce(F.col(PROBABILITY) > level, F.lit(False))
    rows = bars.select(*keys, "i", "close", "high", "low", middle_price().alias("__middle"), signal.alias("__signal"))
    own = [rows.schema[k] for k in keys]
    types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
    names = ["entry_i", "exit_i", "entry_price", "exit_price", "trade_return", "hit"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walker, kinds = None, Walker(hold, profit, stop), None

        def emit(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * (len(keys) + len(names))
            arrays = [pa.array(c, t, from_pandas=True) for c, t in zip(columns, [*kinds, *types], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [*keys, *names])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            found: list[tuple] = []
            at = np.asarray(batch.column("i"))
            values = doubles(batch, "close", "high", "low", "__middle")
            signals = batch.column("__signal").to_numpy(zero_copy_only=False)
            for lo, hi in series_cuts(batch, keys):
                key = tuple(batch.column(k)[lo].as_py() for k in keys)
                if key != now:
                    found += [(*now, *t) for t in walker.finish()] if now is not None else []
                    now, walker = key, Walker(hold, profit, stop)
                found += [(*now, *t) for t in walker.feed(at[lo:hi], *(v[lo:hi] for v in values), signals[lo:hi])]
            yield emit(found)
        if now is not None:
            yield emit([(*now, *t) for t in walker.finish()])

    fields = [T.StructField(n, t) for n, t in zip(names, [T.IntegerType()] * 2 + [T.DoubleType()] * 3 + [T.BooleanType()], strict=True)]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "i").mapInArrow(walk, T.StructType([*own, *fields]))


def trades_at(bars: DataFrame, keys: list[str], levels: list[float], hold: int = HOLD, profit: float = TAKE_PROFIT, stop: float = STOP_LOSS) -> DataFrame:
    """(keys, threshold, entry_ts, trade_return, hit): the trades of each series at every one of several thresholds.

    A series is dealt out, sorted (by ts, and by row_seq where there is one) and read once, however many
    thresholds there are: one open trade for each of them is the state between batches. The rule is that of trades().
    """
    order = ["ts", *(c for c in ("row_seq",) if c in bars.columns)]
    rows = bars.select(*keys, *order, "close", "high", "low", middle_price().alias("__middle"), F.col(PROBABILITY).cast("double").alias("__p"))
    own = [rows.schema[k] for k in keys]
    schema = T.StructType([*own, T.StructField("threshold", T.DoubleType()), rows.schema["ts"], T.StructField("trade_return", T.DoubleType()), T.StructField("hit", T.BooleanType())])
    names = [*keys, "threshold", "ts", "trade_return", "hit"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walkers, seen = None, [], 0
        # the instants of the bars in which open trades began
        began: dict[int, int] = {}
        for batch in batches:
            found: list[tuple] = []
            stamps = batch.column("ts").cast(pa.int64()).to_pylist()
            values = doubles(batch, "close", "high", "low", "__middle")
            p = np.nan_to_num(doubles(batch, "__p")[0], nan=-np.inf)
            for lo, hi in series_cuts(batch, keys):
                key = tuple(batch.column(k)[lo].as_py() for k in keys)
                if key != now:
                    found += ends(now, walkers, began)
                    now, walkers, seen, began = key, [Walker(hold, profit, stop) for _ in levels], 0, {}
                at = np.arange(seen, seen + hi - lo)
                instant = lambda i, lo=lo, seen=seen: began[i] if i < seen else stamps[lo + i - seen]  # noqa: B023, E731
                for level, walker in zip(levels, walkers, strict=True):
                    found += [(*now, level, instant(t[0]), t[4], t[5]) for t in walker.feed(at, *(v[lo:hi] for v in values), p[lo:hi] > level)]
                began = {w.open.entry: instant(w.open.entry) for w in walkers if w.open}
                seen += hi - lo
            yield packed(batch, found)
        if now is not None:
            yield packed(batch, ends(now, walkers, began))

    def ends(now: tuple | None, walkers: list[Walker], began: dict[int, int]) -> list[tuple]:
        return [(*now, level, began[t[0]], t[4], t[5]) for level, w in zip(levels, walkers, strict=True) for t in w.finish()] if now is not None else []

    def packed(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        kinds = [batch.schema.field(k).type for k in keys]
        columns = list(zip(*found, strict=True)) or [()] * len(names)
        types = [*kinds, pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        arrays[len(keys) + 1] = arrays[len(keys) + 1].cast(batch.schema.field("ts").type)
        return pa.RecordBatch.from_arrays(arrays, names)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(walk, schema).withColumnRenamed("ts", "entry_ts")


def flagged(bars: DataFrame, found: DataFrame, keys: list[str], threshold: Column | str) -> DataFrame:
    """Bars with signal, strategy_return at the entry's bar, entry and exit flags and prices where flagged."""
    level = F.col(threshold) if isinstance(threshold, str) else threshold
    entries = found.select(*keys, F.col("entry_i").alias("i"), F.col("trade_return").alias("strategy_return"), "entry_price", F.lit(1).alias("entry_trade"))
    # a bar may be the deadline of a trade and the exit of another: the later trade's price stays
    exits = found.groupBy(*keys, F.col("exit_i").alias("i")).agg(F.max_by("exit_price", "entry_i").alias("exit_price"), F.lit(1).alias("exit_trade"))
    out = bars.join(entries, [*keys, "i"], "left").join(exits, [*keys, "i"], "left")
    out = out.withColumn("signal", F.coalesce(F.col(PROBABILITY) > level, F.lit(False)).cast("int"))
    return out.na.fill(0.0, ["strategy_return"]).na.fill(0, ["entry_trade", "exit_trade"])


def equity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, portfolio_return, cum_strategy_return): mean return of all symbols at each instant, compounded; 0 from a total loss on."""
    return compounded(rows.groupBy(*keys, "ts").agg(F.avg("strategy_return").alias("portfolio_return")), keys)


def compounded(means: DataFrame, keys: list[str]) -> DataFrame:
    """Instants' portfolio returns with their running product; 0 from a total loss on."""
    r = F.col("portfolio_return")
    out = running(means, keys, {"__logs": (F.sum, F.when(r > -1, F.log1p(r)).otherwise(0.0)), "__lost": (F.max, (r <= -1).cast("int"))})
    return out.withColumn("cum_strategy_return", F.when(F.col("__lost") == 1, 0.0).otherwise(F.exp("__logs"))).drop("__logs", "__lost")


def drawdown(curve: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, max_drawdown, cum_return) of a curve with one row for each instant."""
    out = running(curve, keys, {"__peak": (F.max, F.col("cum_strategy_return"))})
    down = F.when(F.col("__peak") > 1e-12, (F.col("cum_strategy_return") - F.col("__peak")) / F.col("__peak")).otherwise(0.0)
    return out.withColumn("__down", down).groupBy(*keys).agg(F.min("__down").alias("max_drawdown"), F.max_by("cum_strategy_return", "ts").alias("cum_return"))


def market_curve(bars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, market): the mean over symbols of close / first close."""
    w = Window.partitionBy(*keys, "symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("close").over(w)
    normed = bars.withColumn("__n", F.when(first > 1e-12, F.col("close") / first).otherwise(1.0))
    return normed.groupBy(*keys, "ts").agg(F.avg("__n").alias("market"))


def market_growth(bars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cum_market_return): the market curve's last value, the growth of an equal holding of all symbols."""
    return market_curve(bars, keys).groupBy(*keys).agg(F.max_by("market", "ts").alias("cum_market_return"))


def on_market_curve(bars: DataFrame, curve: DataFrame) -> DataFrame:
    """Bars with the curve's value of their instant, carried forward, then back, then 1; and its change."""
    forth = Window.partitionBy("symbol").orderBy("ts")
    joined = bars.join(curve, "ts", "left")
    filled = F.coalesce(
        F.last("market", ignorenulls=True).over(forth.rowsBetween(Window.unboundedPreceding, 0)),
        # the next value, looked for backwards so that the frame only grows
        F.last("market", ignorenulls=True).over(Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)),
        F.lit(1.0),
    )
    out = joined.withColumn("cum_market_return", filled)
    return out.withColumn("market_return", F.coalesce(F.try_divide("cum_market_return", F.lag("cum_market_return").over(forth)) - 1, F.lit(0.0))).drop("market")


def trade_metrics(found: DataFrame, keys: list[str]) -> DataFrame:
    """Win rate, profit factor (999 without losses), expectancy (which is the average trade return), hits and their percentage of trades."""
    r = F.col("trade_return")
    gains = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0))
    losses = F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)))
    factor = F.when(losses > 1e-12, gains / losses).when(gains > 0, 999.0).otherwise(0.0)
    return found.groupBy(*keys).agg(
        F.count("*").alias("strategy_trade_count"), F.sum(F.col("hit").cast("int")).alias("strategy_directional_hits"),
        F.avg((r > 0).cast("int")).alias("win_rate"), factor.alias("profit_factor"), F.avg(r).alias("expectancy"), F.avg(r).alias("average_trade_return"),
        (F.avg(F.col("hit").cast("int")) * 100).alias("directional_accuracy"),
    )


METRICS = {"strategy_trade_count": 0, "strategy_directional_hits": 0, "win_rate": 0.0, "profit_factor": 0.0, "expectancy": 0.0, "average_trade_return": 0.0, "directional_accuracy": 0.0}


def backtest(bars: DataFrame, threshold: Column | str = "threshold", keys: list[str] | None = None, by_symbol: bool = False, market: DataFrame | None = None) -> DataFrame:
    """One row of metrics for each key (and symbol): trades, equity, drawdown and the market's buy and hold.

    bars: keys, symbol, ts, close, high, low, prob_trade_success and the threshold's column. market
    (some of the keys, cum_market_return) replaces the market's growth over the bars.
    """
    keys = keys or []
    own = [*keys, "symbol"]
    rows = numbered(bars, own)
    found = trades(rows, own, threshold)
    groups = own if by_symbol else keys
    metrics = trade_metrics(found, groups)
    flags = flagged(rows, found, own, threshold)
    curve = drawdown(equity(flags, groups), groups)
    on = groups if market is None else [c for c in groups if c in market.columns]
    if market is None:
        market = market_growth(bars, groups)
    if groups:
        return curve.join(metrics, groups, "left").join(market, on).na.fill(METRICS).withColumn("max_drawdown", F.when(F.col("strategy_trade_count") > 0, F.col("max_drawdown")).otherwise(0.0))
    return curve.join(metrics).join(market).na.fill(METRICS)


def grid_backtest(bars: DataFrame, keys: list[str], levels: list[float]) -> DataFrame:
    """The metrics of backtest() for each key and each of several thresholds, in one pass over the bars.

    Trades are few beside bars: they are written once, and equity, drawdown and metrics come from them.
    An instant's portfolio return is the sum of the trades that begin there over its number of bars;
    instants without one leave the curve as it is, so only a key's first instant stands for them.
    """
    spark = bars.sparkSession
    shared_folder(spark)
    found = trades_at(bars, [*keys, "symbol"], levels).checkpoint()
    groups = [*keys, "threshold"]
    instants = bars.groupBy(*keys, "ts").agg(F.count("*").alias("__n"))
    sums = found.groupBy(*groups, F.col("entry_ts").alias("ts")).agg(F.sum("trade_return").alias("__sum"))
    means = sums.join(instants, [*keys, "ts"]).select(*groups, "ts", (F.col("__sum") / F.col("__n")).alias("portfolio_return"))
    first = with_threshold(bars.groupBy(*keys).agg(F.min("ts").alias("ts")), levels).select(*groups, "ts", F.lit(0.0).alias("portfolio_return"))
    whole = means.unionByName(first).groupBy(*groups, "ts").agg(F.sum("portfolio_return").alias("portfolio_return"))
    curve = drawdown(compounded(whole, groups), groups)
    return curve.join(trade_metrics(found, groups), groups, "left").join(market_growth(bars, keys), keys).na.fill(METRICS)


def with_threshold(bars: DataFrame, thresholds: list[float]) -> DataFrame:
    """Each bar once for each threshold: the grid is a small literal array, exploded where the bars are."""
    return bars.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds))))


def pnl_table(flags: DataFrame) -> DataFrame:
    """Trades paired from flagged bars: each exit with the oldest entry still pending, an exit before an entry of its bar.

    A symbol's nth exit closes its nth entry. Trades with a null or infinite return are left out
    after pairing; prices come from the flags, else the close and entry * (1 + return).
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    entries = flags.where("entry_trade = 1").select(
        "symbol", F.row_number().over(w).alias("n"), F.col("ts").alias("entry_ts"),
        F.coalesce("entry_price", "close").alias("entry_price"), F.col("strategy_return").alias("trade_return"),
    )
    exits = flags.where("exit_trade = 1").select("symbol", F.row_number().over(w).alias("n"), F.col("ts").alias("exit_ts"))
    paired = entries.join(exits, ["symbol", "n"]).where(F.col("trade_return").isNotNull() & ~F.isnan("trade_return") & (F.abs("trade_return") < float("inf")))
    order = Window.partitionBy("symbol").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    out = paired.withColumn("exit_price", F.col("entry_price") * (1 + F.col("trade_return")))
    return out.withColumn("equity", growth(F.col("trade_return"), order))


