"""Ingest windows, cleaning and audits of prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.schemas import KEY, PRICES, VALUES
from marketloom.sources.keyed import keep_last, last_wins

#: Symbols that trade without volume.
WITHOUT_VOLUME = ["^VIX"]


def watermarks(rows: DataFrame, ts: str = "ts", name: str = "watermark") -> DataFrame:
    """The latest instant of each symbol."""
    return rows.groupBy("symbol").agg(F.max(ts).alias(name))


def new_rows(source: DataFrame, stored: DataFrame, today: Column, backfill: bool = False) -> DataFrame:
    """Source rows from the day after each symbol's watermark to today; all up to today without one."""
    until = source.where(F.col("ts") < F.date_add(today, 1))
    if backfill:
        return until
    marked = until.join(watermarks(stored), "symbol", "left")
    return marked.where(F.col("watermark").isNull() | (F.col("ts") >= F.date_add(F.to_date("watermark"), 1))).drop("watermark")


def history_from(rows: DataFrame, starts: DataFrame, days: int = 400) -> DataFrame:
    """Rows from so many calendar days before each symbol's start; all rows of symbols without one."""
    marked = rows.join(starts.select("symbol", F.col("watermark").alias("__from")), "symbol", "left")
    return marked.where(F.col("__from").isNull() | (F.col("ts") >= F.col("__from") - F.make_dt_interval(F.lit(days)))).drop("__from")


def valid_bar() -> Column:
    """All prices there and positive, and the volume too but for symbols that have none."""
    prices = [F.col(c).isNotNull() & (F.col(c) > 0) for c in PRICES[:-1]]
    waived = F.col("symbol").isin(WITHOUT_VOLUME)
    ok = F.col("volume").isNotNull() & (waived | (F.col("volume") > 0)) | waived
    for p in prices:
        ok = ok & p
    return F.coalesce(ok, F.lit(False))


def clean_prices(raw: DataFrame, stored: DataFrame | None = None, order: str = "row_seq") -> DataFrame:
    """Silver prices: the last raw row of each key, bad ones left out after that.

    Stored rows give way to raw ones of their key, even where the raw one is bad.
    """
    rows = raw.select(*KEY, *PRICES, order)
    merged = keep_last(rows, KEY, order) if stored is None else last_wins(stored.select(*KEY, *PRICES), rows, KEY, order)
    return merged.where(valid_bar()).select(*KEY, *PRICES)


def audit(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows before and after cleaning for each symbol."""
    before = raw.groupBy("symbol").agg(F.count("*").alias("raw_rows"))
    after = clean.groupBy("symbol").agg(F.count("*").alias("clean_rows"))
    return before.join(after, "symbol", "left").na.fill(0, ["clean_rows"])


def incomplete(features: DataFrame) -> DataFrame:
    """Stored feature rows that lack a value and are to be computed anew."""
    return features.join(features.na.drop("any", subset=VALUES).select(*KEY), KEY, "left_anti")


def coverage(expected: DataFrame, clean: DataFrame, features: DataFrame) -> DataFrame:
    """One row: symbols expected, with clean rows, with features, those without, and whether none is missing."""
    has = lambda t, name: t.select("symbol").distinct().withColumn(name, F.lit(True))
    rows = expected.select("symbol").distinct().join(has(clean, "c"), "symbol", "left").join(has(features, "f"), "symbol", "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("f").isNull(), F.col("symbol"))))
    return rows.agg(
        F.count("*").alias("expected"), F.count("c").alias("with_clean"), F.count("f").alias("with_features"),
        F.array_join(missing, ",").alias("missing"), (F.count("*") == F.count("f")).alias("passed"),
    )
