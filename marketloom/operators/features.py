"""Technical features of bars and the row z-score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.smoothing import with_smoothing
from marketloom.functions.windows import change, gated, last_rows, rolling_mean, series
from marketloom.schemas import KEY, PRICES, VALUES, z
from marketloom.session import shared_folder
from marketloom.sources.keyed import KeyedStore


def numeric(bars: DataFrame) -> DataFrame:
    """Prices and volume as doubles; what is no number becomes null."""
    return bars.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in PRICES})


def window_features(bars: DataFrame) -> DataFrame:
    """The features that frames over each symbol's bars express; one exchange and one sort serve them all."""
    wo = series()
    step = bars.withColumns({f"return_{n}d": change("close", n, wo) for n in (1, 5, 10, 20)})
    high10, low10 = F.max("high").over(last_rows(10)), F.min("low").over(last_rows(10))
    high14, low14 = F.max("high").over(last_rows(14)), F.min("low").over(last_rows(14))
    k = F.try_divide(100 * (F.col("close") - low14), high14 - low14)
    w20 = last_rows(20)
    middle, spread = F.avg("close").over(w20), F.stddev_pop("close").over(w20)
    step = step.withColumns(
        {f"sma_{n}": rolling_mean("close", n) for n in (5, 10, 20, 50, 100, 200)}
        | {f"volatility_{n}": gated(F.stddev_samp("return_1d").over(last_rows(n)), "return_1d", last_rows(n), n) for n in (5, 10, 20, 50, 100)}
        | {f"lag_{n}": F.lag("close", n).over(wo) for n in (1, 2)}
        | {f"roc_{n}": 100 * change("close", n, wo) for n in (5, 10)}
        | {
            "stochastic_k": gated(k, "close", last_rows(14), 14),
            "close_vs_high_10": gated(F.try_divide(F.col("close") - high10, high10), "high", last_rows(10), 10),
            "close_vs_low_10": gated(F.try_divide(F.col("close") - low10, low10), "low", last_rows(10), 10),
            "bb_mavg_20": gated(middle, "close", w20, 20),
            "bb_hband_20": gated(middle + 2 * spread, "close", w20, 20),
            "bb_lband_20": gated(middle - 2 * spread, "close", w20, 20),
        }
    )
    return step.withColumns(
        {
            "stochastic_d": rolling_mean("stochastic_k", 3),
            "volatility_ratio": F.try_divide("volatility_20", "volatility_50"),
            "bb_width_20": F.try_divide(100 * (F.col("bb_hband_20") - F.col("bb_lband_20")), F.col("bb_mavg_20")),
            "bb_pband_20": F.try_divide(F.col("close") - F.col("bb_lband_20"), F.col("bb_hband_20") - F.col("bb_lband_20")),
        }
    )


def compute_features(bars: DataFrame) -> DataFrame:
    """(symbol, ts, close, 45 features) for bars (symbol, ts, open, high, low, close, volume), one row each.

    Values without enough history are null; ratios with a zero below are null.
    """
    return with_trend(with_smoothing(window_features(numeric(bars)))).select(*KEY, *VALUES)


def with_trend(smooth: DataFrame) -> DataFrame:
    bull = (F.col("ema_20") > F.col("sma_50")) & (F.col("ema_50") > F.col("ema_100"))
    return smooth.withColumn("ema_trend_bull", F.when(F.coalesce(bull, F.lit(False)), 1.0).otherwise(0.0))


def row_z_scores(features: DataFrame, columns: list[str]) -> DataFrame:
    """Add <c>_z for each column: (x - mean) / population deviation over the columns of one row.

    Nulls are left out of mean and deviation; a deviation of zero or null counts as 1.
    """
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))

    def moments(there: Column) -> Column:
        def spread(mean: Column) -> Column:
            deviation = F.sqrt(F.try_divide(total(there, lambda x: (x - mean) * (x - mean)), F.size(there)))
            return F.struct(mean.alias("__mean"), F.coalesce(F.nullif(deviation, F.lit(0.0)), F.lit(1.0)).alias("__sd"))

        return F.get(F.transform(F.array(F.try_divide(total(there, lambda x: x), F.size(there))), spread), F.lit(0))

    there = F.filter(F.array(*columns), lambda x: x.isNotNull())
    # generated columns are computed once a row; plain ones would be written out in every score
    named = features.select("*", F.inline(F.transform(F.array(there), moments)))
    scores = {c_z: (F.col(c) - F.col("__mean")) / F.col("__sd") for c, c_z in zip(columns, z(columns), strict=True)}
    return named.withColumns(scores).drop("__mean", "__sd")


def complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in every column."""
    return rows.na.drop("any", subset=columns)


def feature_tables(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, z-scores): complete rows only; the z-scores of a complete row are complete."""
    features = complete(compute_features(bars), VALUES)
    return features, row_z_scores(features, VALUES).select(*KEY, *z(VALUES))


def refill(store: KeyedStore, computed: DataFrame, columns: list[str]) -> int:
    """Purge stored rows that lack a value and insert the complete computed rows that are not stored; gives the number purged.

    Only symbols with a complete computed row are purged: of all others the stored rows stay as they are.
    Stored complete rows stay too, whatever was computed (first writer wins).
    """
    shared_folder(computed.sparkSession)
    fresh = complete(computed, columns).checkpoint()
    symbols = [r["symbol"] for r in fresh.select("symbol").distinct().collect()]
    lacks = F.lit(False)
    for c in columns:
        lacks = lacks | F.col(c).isNull()
    purged = store.delete(lacks & F.col("symbol").isin(symbols))
    store.insert(fresh)
    return purged


def parity(features: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: both tables' numbers of rows and how many keys only one of them has."""
    a, b = features.select(*KEY, F.lit(1).alias("a")), scores.select(*KEY, F.lit(1).alias("b"))
    both = a.join(b, KEY, "full_outer")
    return both.agg(F.count("a").alias("features"), F.count("b").alias("scores"), F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("unmatched"))


def latest(rows: DataFrame, *keys: str, n: int = 1) -> DataFrame:
    """The last n rows of each key by ts."""
    back = Window.partitionBy(*(keys or ("symbol",))).orderBy(F.desc("ts"))
    return rows.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= n).drop("__back")


def symbols_from(rows: DataFrame, start: str, universe: DataFrame) -> DataFrame:
    """Rows of symbols from start on in alphabetical order; start must be in the universe."""
    start = start.strip().upper()
    if universe.where(F.upper("symbol") == start).isEmpty():
        raise ValueError(f"{start} is not in the universe")
    return rows.where(F.col("symbol") >= start)
