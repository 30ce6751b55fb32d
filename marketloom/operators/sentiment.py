"""Leakage-free news sentiment of bars and daily rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.windows import rolling_z
from marketloom.operators.context import by_instant
from marketloom.schemas import SENTIMENT_ALL
from marketloom.sources.keyed import keep_last

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Trailing windows by name; all are whole hours.
TRAILING = {"h1": HOUR, "h24": DAY, "d3": 3 * DAY}
#: The stretch of time (whole hours) in which a symbol's articles meet cuts: its rows are many groups.
STRETCH = HOUR
NEWS = "published_at"


def neutral(bars: DataFrame) -> DataFrame:
    return bars.withColumns({c: F.lit(0.0) for c in SENTIMENT_ALL})


def _pieces(probes: DataFrame, articles: DataFrame, sizes: list[int]) -> DataFrame:
    """(symbol, us, probe, n, total, m2): the articles after the cut before, up to the cut us; m2 is their sum of squared deviations.

    Cuts are the probes, the starts of their windows and the last microsecond of each hour that has articles.
    Articles meet the cuts of their stretch alone, in one pass.
    """
    starts = F.array(*(F.col("us") - size for size in (0, *sizes)))
    cuts = probes.select("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).distinct().select("symbol", F.posexplode(starts).alias("place", "us"))
    cuts = cuts.select("symbol", "us", F.col("us").alias("cut"), (F.col("place") == 0).alias("probe"), F.lit(None).cast("double").alias("score"))
    news = articles.select("symbol", F.unix_micros(F.col(NEWS).cast("timestamp")).alias("us"), F.lit(None).cast("long").alias("cut"), F.lit(False).alias("probe"), F.coalesce("finbert_scalar", F.lit(0.0)).alias("score"))
    rows = cuts.unionByName(news).where("symbol is not null and us is not null").withColumn("stretch", F.floor(F.col("us") / STRETCH))
    # the least cut at or after a row, looked for backwards so that the frame only grows
    back = Window.partitionBy("symbol", "stretch").orderBy(F.desc("us"))
    rows = rows.withColumn("cut", F.least(F.min("cut").over(back), (F.floor(F.col("us") / HOUR) + 1) * HOUR - 1))
    n = F.count("score")
    found = rows.groupBy("symbol", "stretch", "cut").agg(F.max("probe").alias("probe"), n.alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"), F.coalesce(F.var_pop("score") * n, F.lit(0.0)).alias("m2"))
    return found.select("symbol", F.col("cut").alias("us"), "probe", "n", "total", "m2")


def _between(n: Column, total: Column, m: Column, sum_: Column) -> Column:
    """What two groups' squared deviations lack of those of both together; no difference of large sums is taken."""
    return F.when((n > 0) & (m > 0), (total / n - sum_ / m) ** 2 * (n * (m / (n + m)))).otherwise(0.0)


def _running(pieces: DataFrame, keys: list[str], order: Column, name: str) -> DataFrame:
    """Pieces with <name>_n, _total and _m2 of all pieces of their keys up to and with their own."""
    w = Window.partitionBy(*keys).orderBy(order)
    now, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    m, sum_ = F.coalesce(F.sum("n").over(before), F.lit(0)), F.coalesce(F.sum("total").over(before), F.lit(0.0))
    out = pieces.withColumns({"__m": m, "__sum": sum_})
    out = out.withColumn("__step", F.col("m2") + _between(F.col("n"), F.col("total"), F.col("__m"), F.col("__sum")))
    out = out.withColumns({f"{name}_n": F.col("__m") + F.col("n"), f"{name}_total": F.col("__sum") + F.col("total"), f"{name}_m2": F.sum("__step").over(now)})
    return out.drop("__m", "__sum", "__step")


PARTS = ("n", "total", "m2")


def _stats(parts: dict[str, Column], prefix: str) -> dict[str, Column]:
    n, total, m2 = (parts[p] for p in PARTS)
    return {
        f"{prefix}_mean": F.when(n > 0, total / n).otherwise(0.0),
        f"{prefix}_n": n.cast("double"),
        f"{prefix}_sd": F.when(n > 1, F.sqrt(m2 / (n - 1))).otherwise(0.0),
    }


def _as_of(probes: DataFrame, articles: DataFrame, trailing: dict[str, int]) -> DataFrame:
    """(symbol, ts, <name>_mean, _n, _sd) of each distinct probe: trailing windows, open at their start, and day, from midnight (UTC) on.

    Time is cut in blocks as long as the window, counted from midnight: a window is the end of one block and the
    beginning of the next. Both are running aggregates over pieces, so no article is added twice to one of them and none is
    taken away again; a block has as many rows as cuts, however many its articles are.
    """
    blocks = {"day": DAY, **trailing}
    rows = _pieces(probes, articles, list(trailing.values()))
    at = F.col("us")
    for name, size in blocks.items():
        rows = rows.withColumn("block", F.floor(at / size))
        rows = _running(rows, ["symbol", "block"], at.asc(), f"{name}_head")
        if name in trailing:
            # what follows a cut in its block is what the next cut's tail holds
            rows = _running(rows, ["symbol", "block"], at.desc(), f"{name}_next")
            later = Window.partitionBy("symbol", "block").orderBy(at.desc())
            rows = rows.withColumns({f"{name}_tail_{p}": F.coalesce(F.lag(f"{name}_next_{p}").over(later), F.lit(0)) for p in PARTS})
    heads = [f"{name}_head_{p}" for name in blocks for p in PARTS]
    tails = {name: [f"{name}_tail_{p}" for p in PARTS] for name in trailing}
    every = [*heads, *(c for t in tails.values() for c in t)]
    # a start's tail goes to the probe whose window begins there
    part = lambda shift, own, probe: F.struct((at + shift).alias("us"), probe.alias("probe"), *(F.when(F.lit(c in own), F.col(c)).alias(c) for c in every))
    parts = [part(0, heads, F.col("probe")), *(part(size, tails[name], F.lit(False)) for name, size in trailing.items())]
    met = rows.select("symbol", F.inline(F.array(*parts))).groupBy("symbol", "us").agg(F.max("probe").alias("probe"), *(F.max(c).alias(c) for c in every)).where("probe")
    found = _stats({p: F.col(f"day_head_{p}") for p in PARTS}, "day")
    for name in trailing:
        (n, total, m2), (m, sum_, rest) = ([F.col(f"{name}_{side}_{p}") for p in PARTS] for side in ("head", "tail"))
        found |= _stats({"n": n + m, "total": total + sum_, "m2": m2 + rest + _between(n, total, m, sum_)}, name)
    return met.select("symbol", F.timestamp_micros("us").alias("ts"), *(c.alias(k) for k, c in found.items()))


def as_of_sentiment(bars: DataFrame, articles: DataFrame, market: str = "SPY") -> DataFrame:
    """Bars with SENTIMENT_ALL, from articles published at or before each bar alone.

    Trailing windows are open at their start. The day's statistics run from midnight (UTC). A null
    score counts as 0; no articles give 0. Articles are added up between the bars' instants first, so that the work
    grows with articles and bars, not with the articles of a window; the market's own statistics are computed once for each instant.
    """
    own = _as_of(bars, articles, TRAILING).select(
        "symbol", "ts",
        F.col("h24_mean").alias("news_sentiment_mean_z"), F.col("h1_mean").alias("sentiment_1h"), F.col("h24_mean").alias("sentiment_24h"),
        F.col("d3_mean").alias("sentiment_3d"), F.col("h24_n").alias("news_volume"), F.col("d3_sd").alias("sentiment_volatility"),
        F.col("day_mean").alias("sym_sentiment_d1"), F.col("day_n").alias("sym_news_volume_d1"), F.col("day_sd").alias("sym_sentiment_vol_d1"),
    )
    instants = bars.select(F.lit(market).alias("symbol"), "ts").distinct()
    spy = _as_of(instants, articles.where(F.col("symbol") == market), {})
    spy = spy.select("ts", F.col("day_mean").alias("spy_sentiment_d1"), F.col("day_n").alias("spy_news_volume_d1"), F.col("day_sd").alias("spy_sentiment_vol_d1"))
    return by_instant(bars.join(own, ["symbol", "ts"], "left"), spy)


def daily_sentiment(bars: DataFrame, daily: DataFrame, day_col: str = "as_of_date", order: str = "row_seq") -> DataFrame:
    """Bars with SENTIMENT_ALL of their symbol's day; the last of several rows counts, missing values are 0."""
    there = [c for c in SENTIMENT_ALL if c in daily.columns]
    rows = keep_last(daily.withColumn("__day", F.to_date(day_col)), ["symbol", "__day"], order).select("symbol", "__day", *there)
    out = bars.withColumn("__day", F.to_date("ts")).join(rows, ["symbol", "__day"], "left").drop("__day")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in there else F.lit(0.0) for c in SENTIMENT_ALL})


def attach_sentiment(bars: DataFrame, articles: DataFrame | None = None, gold: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """The first source that has rows: articles, the daily table, the cache; else neutral."""
    if articles is not None and not articles.isEmpty():
        return as_of_sentiment(bars, articles)
    if gold is not None and not gold.isEmpty():
        return daily_sentiment(bars, gold)
    if cache is not None and not cache.isEmpty():
        return daily_sentiment(bars, cache, day_col="ts")
    return neutral(bars)


def daily_rollup(days: DataFrame, articles: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """(symbol, as_of_date, ...) for every feature day: means to the day's end, article count and rolling z-scores.

    Trailing windows end at the next midnight and are open at their start; the article count is of
    the calendar day. z-scores run over each symbol's days (volume as log(1 + n)); rows before the
    cutoff serve as history only.
    """
    ends = days.select("symbol", F.col("as_of_date")).distinct().withColumn("ts", F.date_add("as_of_date", 1).cast("timestamp"))
    rows = _as_of(ends, articles, TRAILING).withColumn("as_of_date", F.date_sub(F.to_date("ts"), 1))
    per_day = articles.groupBy("symbol", F.to_date(NEWS).alias("as_of_date")).agg(F.count("*").alias("article_count"), F.avg(F.coalesce("finbert_scalar", F.lit(0.0))).alias("mean_score"))
    rows = rows.join(per_day, ["symbol", "as_of_date"], "left").na.fill(0, ["article_count"]).na.fill(0.0, ["mean_score"])
    rows = rows.withColumn("ts", F.col("as_of_date"))
    raw = {"news_sentiment_mean_z": F.col("mean_score"), "sentiment_1h": F.col("h1_mean"), "sentiment_24h": F.col("h24_mean"), "sentiment_3d": F.col("d3_mean"), "news_volume": F.log1p("h24_n"), "sentiment_volatility": F.col("d3_sd")}
    scored = rows.withColumns({f"{c}__raw": v for c, v in raw.items()})
    scored = scored.withColumns({c: rolling_z(F.col(f"{c}__raw"), f"{c}__raw") for c in raw})
    out = scored.select("symbol", "as_of_date", "article_count", *raw)
    return out if cutoff is None else out.where(F.col("as_of_date") >= cutoff)


#: Days of history that the rolling z-scores need at least (fixed value).
ROLL_DAYS = 60


def incremental_rollup(days: DataFrame, articles: DataFrame, stored: DataFrame, lookback: int) -> DataFrame:
    """The daily rollup's rows to write anew: from so many days (ROLL_DAYS at least) before each symbol's last stored day on.

    Symbols without a stored day get all of their rows; z-scores run over the full history either way.
    """
    last = stored.groupBy("symbol").agg(F.date_sub(F.max("as_of_date"), max(lookback, ROLL_DAYS)).alias("__cutoff"))
    rows = daily_rollup(days, articles).join(last, "symbol", "left")
    return rows.where(F.col("__cutoff").isNull() | (F.col("as_of_date") >= F.col("__cutoff"))).drop("__cutoff")


def sentiment_cache(days: DataFrame, articles: DataFrame, last: int | None = None) -> DataFrame:
    """(symbol, ts, news_sentiment_mean_z, sentiment_24h, news_volume) of each symbol's (last) days: mean daily score and its rolling z."""
    per_day = articles.groupBy("symbol", F.to_date(NEWS).alias("as_of_date")).agg(F.avg("finbert_scalar").alias("sentiment_24h"), F.count("*").alias("news_volume"))
    rows = days.select("symbol", "as_of_date").distinct()
    if last is not None:
        back = Window.partitionBy("symbol").orderBy(F.desc("as_of_date"))
        rows = rows.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= last).drop("__n")
    rows = rows.join(per_day, ["symbol", "as_of_date"], "left").na.fill(0.0, ["sentiment_24h"]).na.fill(0, ["news_volume"]).withColumnRenamed("as_of_date", "ts")
    return rows.withColumn("news_sentiment_mean_z", rolling_z(F.col("sentiment_24h"), "sentiment_24h"))
