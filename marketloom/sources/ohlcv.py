"""Price histories as their provider writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.schemas import KEY, PRICES

#: The provider's column names (fixed values), in the order of PRICES behind the date.
PROVIDED = ["Open", "High", "Low", "Close", "Volume"]


def as_prices(rows: DataFrame, symbol: str | None = None) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume): renamed, times as UTC instants; other columns go.

    Date may be a time, a day or text, with an offset or in UTC; text that is no time becomes null.
    symbol names all rows where they have no such column.
    """
    kind = rows.schema["Date"].dataType.simpleString()
    ts = F.try_to_timestamp("Date") if kind == "string" else F.col("Date").cast("timestamp")
    name = F.col("symbol") if symbol is None else F.lit(symbol)
    return rows.select(name.alias(KEY[0]), ts.alias(KEY[1]), *(F.col(a).alias(b) for a, b in zip(PROVIDED, PRICES, strict=True)))


def read_prices(spark: SparkSession, path: str, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Prices of Parquet or CSV files (by suffix), from start on and before end."""
    file = spark.read.parquet(path) if path.endswith((".parquet", ".pq")) else spark.read.option("header", True).option("inferSchema", True).csv(path)
    out = as_prices(file, symbol)
    out = out if start is None else out.where(F.col("ts") >= start)
    return out if end is None else out.where(F.col("ts") < end)
