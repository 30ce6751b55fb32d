"""Exponential smoothing of sorted series: batch by batch with a fixed amount of state, or block by block in parallel."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketloom.functions.batches import doubles, series_cuts
from marketloom.functions.windows import running

SPANS = (10, 20, 50, 100, 200)
#: Bars after which every recursion has begun: from there on a state is a fixed list of numbers.
WARM_UP = 34
SMOOTHED = [*(f"ema_{s}" for s in SPANS), "ema_slope_20", "rsi_14", "rsi_21", "macd", "macd_signal", "atr_14"]


def recursion(x: np.ndarray, alpha: float, before: float) -> np.ndarray:
    """y = (1 - alpha) * (y before) + alpha * x."""
    return pd.Series(np.concatenate([[before], x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


class Smoother:
    """State of one series between batches; a series may be of any length."""

    def __init__(self) -> None:
        self.rows = 0
        self.last: dict[Any, float] = {}
        self.tail = np.zeros(0)
        self.close = np.nan
        self.ranges: list[float] = []

    def _run(self, key: Any, x: np.ndarray, alpha: float, start: float) -> np.ndarray:
        y = recursion(x, alpha, self.last.get(key, start))
        self.last[key] = y[-1]
        return y

    def feed(self, close: np.ndarray, high: np.ndarray, low: np.ndarray) -> dict[str, np.ndarray]:
        n, done = len(close), self.rows
        row = np.arange(done + 1, done + n + 1)
        out: dict[str, np.ndarray] = {}
        for span in SPANS:
            # weights of all rows so far, normed: the mean that starts with the first row
            alpha = 2 / (span + 1)
            out[f"ema_{span}"] = self._run(span, close, alpha, 0.0) / (1 - (1 - alpha) ** row)
        back = np.concatenate([self.tail, out["ema_20"]])
        early = min(n, 5 - len(self.tail))
        before = np.concatenate([np.full(early, np.nan), back[: n - early]])
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (out["ema_20"] - before) / before
        out["ema_slope_20"] = np.where(np.isfinite(slope), slope, np.nan)
        self.tail = back[-5:]

        previous = np.concatenate([[self.close], close[:-1]])
        step = np.nan_to_num(close - previous)
        for length in (14, 21):
            up = self._run(("up", length), np.maximum(step, 0.0), 1 / length, 0.0)
            down = self._run(("down", length), np.maximum(-step, 0.0), 1 / length, 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                strength = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
            out[f"rsi_{length}"] = np.where(row >= length, strength, np.nan)

        fast, slow = (self._run(("macd", s), close, 2 / (s + 1), close[0]) for s in (12, 26))
        out["macd"] = np.where(row >= 26, fast - slow, np.nan)
        signal = np.full(n, np.nan)
        known = row >= 26
        if known.any():
            first = out["macd"][known]
            signal[known] = self._run("signal", first, 2 / 10, first[0])
        out["macd_signal"] = np.where(row >= 34, signal, np.nan)

        true_range = np.nanmax(np.stack([high - low, np.abs(high - previous), np.abs(low - previous)]), axis=0)
        atr = np.zeros(n)
        early = max(0, min(n, 14 - done))
        self.ranges += true_range[:early].tolist()
        if early and done + early == 14:
            atr[early - 1] = self.last["atr"] = float(np.mean(self.ranges))
        if early < n:
            atr[early:] = self._run("atr", true_range[early:], 1 / 14, 0.0)
        out["atr_14"] = atr
        self.rows, self.close = done + n, close[-1]
        return out


    #: Recursions that follow the close from 0 on, their weights, and all that make up a state.
    CLOSES = [*((s, 2 / (s + 1)) for s in SPANS), (("macd", 12), 2 / 13), (("macd", 26), 2 / 27)]
    STEPS = [((way, length), 1 / length) for length in (14, 21) for way in ("up", "down")]
    KEYS = [*(k for k, _ in CLOSES), *(k for k, _ in STEPS), "signal", "atr"]

    def state(self) -> list[float]:
        """The state as numbers: rows, last close, KEYS and the last five ema_20; behind the warm-up alone."""
        return [float(self.rows), float(self.close), *(float(self.last[k]) for k in self.KEYS), *self.tail.tolist()]

    @classmethod
    def resumed(cls, state: list[float]) -> Smoother:
        own, n = cls(), len(cls.KEYS)
        own.rows, own.close = int(state[0]), state[1]
        own.last, own.tail = dict(zip(cls.KEYS, state[2 : 2 + n], strict=True)), np.array(state[2 + n :])
        return own


#: Weight of the macd signal.
SIGNAL = 2 / 10


def block_offsets(close: np.ndarray, high: np.ndarray, low: np.ndarray) -> list[float]:
    """What a block of rows adds to a state of zeros, in the order of KEYS; the first row's change and range are not known here and count as 0."""
    fold = lambda x, alpha: recursion(x, alpha, 0.0)
    step = np.diff(close, prepend=close[0])
    ranges = np.maximum(high[1:] - low[1:], np.maximum(np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])))
    of_close = [fold(close, alpha) for _, alpha in Smoother.CLOSES]
    of_step = [fold(np.maximum(step if way == "up" else -step, 0.0), alpha)[-1] for (way, _), alpha in Smoother.STEPS]
    signal = fold(of_close[-2] - of_close[-1], SIGNAL)[-1]
    return [*(float(y[-1]) for y in of_close), *map(float, of_step), float(signal), float(fold(np.append(0.0, ranges), 1 / 14)[-1])]


def carried(state: list[float], n: int, first: list[float], last: list[float], offsets: list[float]) -> list[float]:
    """The state behind a block of n rows. first: its first close, high and low; last: its last five closes, at least.

    Every recursion is an affine map of the state: it shrinks by the block's decay and the block's own part is
    added. The signal follows two of them and takes in what is left of both.
    """
    rows, before = int(state[0]), state[1]
    own = dict(zip(Smoother.KEYS, state[2:], strict=False))
    add = dict(zip(Smoother.KEYS, offsets, strict=True))
    close, high, low = first
    decayed = lambda key, alpha, head=0.0: (1 - alpha) ** n * own[key] + add[key] + alpha * (1 - alpha) ** (n - 1) * head
    out = {key: decayed(key, alpha) for key, alpha in Smoother.CLOSES}
    out |= {(way, length): decayed((way, length), alpha, max(close - before if way == "up" else before - close, 0.0)) for (way, length), alpha in Smoother.STEPS}
    g = 1 - SIGNAL
    left = lambda d: d * (g**n - d**n) / (g - d)
    out["signal"] = g**n * own["signal"] + add["signal"] + SIGNAL * (own["macd", 12] * left(1 - 2 / 13) - own["macd", 26] * left(1 - 2 / 27))
    out["atr"] = decayed("atr", 1 / 14, max(high - low, abs(high - before), abs(low - before)))
    alpha, y, tail = 2 / 21, out[20], []
    for back, x in enumerate(reversed(last[-5:])):
        tail.append(y / (1 - (1 - alpha) ** (rows + n - back)))
        y = (y - alpha * x) / (1 - alpha)
    return [float(rows + n), last[-1], *(out[k] for k in Smoother.KEYS), *reversed(tail)]


def with_smoothing_in_blocks(bars: DataFrame, block: int = 1 << 16) -> DataFrame:
    """with_smoothing() with tasks that are bounded by blocks of rows, not by series.

    Bars are numbered by calendar units and cut in blocks. Each block adds up its own part of every
    recursion, all at once; one row a block then passes through its series in order, which gives each block
    the state it starts from; blocks are smoothed from there, again all at once. No task holds more than a block.
    """
    if block < 64:
        raise ValueError("a block must have 64 rows at least: the first one holds the warm-up")
    there = F.lit(True)
    for c in ("close", "high", "low"):
        x = F.col(c).cast("double")
        there = there & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    numbered = running(bars.withColumn("__there", there), ["symbol"], {"__i": (F.sum, F.col("__there").cast("long"))})
    cut = numbered.withColumn("__block", F.floor(F.greatest(F.col("__i") - 1, F.lit(0)) / block))
    keys = ["symbol", "__block"]
    kind = bars.schema["symbol"]
    summary = T.StructType([kind, T.StructField("__block", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("first", "last", "offsets", "state"))])
    states = T.StructType([kind, T.StructField("__block", T.LongType()), T.StructField("state", T.ArrayType(T.DoubleType()))])

    def arranged(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[np.ndarray]]:
        """The block in order, the places of its complete rows, and these rows' prices."""
        table = table.combine_chunks().sort_by([("__i", "ascending"), ("ts", "ascending")])
        at = np.flatnonzero(np.asarray(table.column("__there")))
        prices = [pc.cast(table.column(c), pa.float64()).to_numpy()[at] for c in ("close", "high", "low")]
        return table, at, prices

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        _, at, (close, high, low) = arranged(table)
        state: list[float] | None = None
        offsets: list[float] | None = None
        if len(at) and key[1].as_py() == 0:
            own = Smoother()
            own.feed(close, high, low)
            state = own.state() if len(at) >= WARM_UP else None
        elif len(at):
            offsets = block_offsets(close, high, low)
        first = [float(x[0]) for x in (close, high, low)] if len(at) else None
        row = {"symbol": key[0].as_py(), "__block": key[1].as_py(), "n": len(at), "first": first, "last": close[-5:].tolist(), "offsets": offsets, "state": state}
        return pa.Table.from_pylist([row], schema=to_arrow_schema(summary))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol: str | None = None
        state: list[float] | None = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["__block"] == 0 or r["symbol"] != symbol:
                    symbol, state = r["symbol"], r["state"]
                    continue
                out.append({"symbol": symbol, "__block": r["__block"], "state": state})
                state = carried(state, r["n"], r["first"], r["last"], r["offsets"])
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(states))

    added = T.StructType([T.StructField(c, T.DoubleType()) for c in SMOOTHED])
    schema = T.StructType([*bars.schema.fields, *added.fields])

    def smoothed(key: tuple, table: pa.Table, starts: pa.Table) -> pa.Table:
        table, at, prices = arranged(table)
        own = Smoother.resumed(starts.column("state")[0].as_py()) if starts.num_rows else Smoother()
        found = own.feed(*prices) if len(at) else {}
        for c in SMOOTHED:
            y = np.full(table.num_rows, np.nan)
            if len(at):
                y[at] = found[c]
            table = table.append_column(c, pa.array(y, from_pandas=True))
        return table.select(schema.names)

    blocks = cut.select(*keys, "ts", "__i", "__there", "close", "high", "low").groupBy(*keys).applyInArrow(summed, summary)
    starts = blocks.repartition("symbol").sortWithinPartitions("symbol", "__block").mapInArrow(carry, states)
    return cut.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInArrow(smoothed, schema)


def with_smoothing(bars: DataFrame) -> DataFrame:
    """Add SMOOTHED to bars (symbol, ts, close, high, low, ...).

    The recursions need each symbol's bars in order. Behind a window over (symbol, ts) the sort and
    the exchange asked for here are there already, so that this adds no shuffle. Batches of a
    series follow each other and leave a few numbers of state, whatever the series' length. Bars
    with a null price leave the state as it is and get nulls.
    """
    return _smoothed(bars, resumed=False)


def with_resumed_smoothing(bars: DataFrame) -> DataFrame:
    """Add SMOOTHED and new_state to bars that go on where earlier ones of their symbol ended.

    bars: as for with_smoothing(), with state (of the earlier bars, the same in all rows of a symbol) and
    seen, true for earlier bars that are here for windows' sake. A symbol with a state is smoothed from it
    and its seen bars get nulls; one without, which has fewer than 34 earlier bars, is smoothed from all of them.
    new_state is there on some rows; the one of a symbol's last such row is the state behind its bars.
    """
    return _smoothed(bars, resumed=True)


def _smoothed(bars: DataFrame, resumed: bool) -> DataFrame:
    added = T.StructType([T.StructField(c, T.DoubleType()) for c in SMOOTHED])
    more = [T.StructField("new_state", T.ArrayType(T.DoubleType()))] if resumed else []
    schema = T.StructType([*bars.schema.fields, *added.fields, *more])

    def begun(batch: pa.RecordBatch, at: int) -> Smoother:
        state = batch.column("state")[at].as_py() if resumed else None
        return Smoother.resumed(state) if state else Smoother()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, state = None, Smoother()
        for batch in batches:
            values = np.stack(doubles(batch, "close", "high", "low"))
            there = np.isfinite(values).all(axis=0)
            if resumed:
                # what a state holds already is not fed again
                there &= ~(batch.column("seen").to_numpy(zero_copy_only=False) & batch.column("state").is_valid().to_numpy(zero_copy_only=False))
            out = np.full((len(SMOOTHED), batch.num_rows), np.nan)
            states: list[list[float] | None] = [None] * batch.num_rows
            for lo, hi in series_cuts(batch, ["symbol"]):
                now = batch.column("symbol")[lo].as_py()
                if now != symbol:
                    symbol, state = now, begun(batch, lo)
                whole = lo + np.flatnonzero(there[lo:hi])
                if len(whole):
                    found = state.feed(*values[:, whole])
                    for at, c in enumerate(SMOOTHED):
                        out[at, whole] = found[c]
                if state.rows >= WARM_UP:
                    states[hi - 1] = state.state()
            columns = [*batch.columns, *(pa.array(y, from_pandas=True) for y in out)]
            if resumed:
                columns.append(pa.array(states, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return bars.repartition("symbol").sortWithinPartitions("symbol", "ts").mapInArrow(run, schema)
