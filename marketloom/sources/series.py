"""Series tables that are joined by their key without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.schemas import KEY

#: Symbols that are written into the filter, which the files' statistics serve; more are met in a broadcast of theirs.
LISTED = 1000
#: Most symbols that are broadcast.
BROADCAST_SYMBOLS = 100_000


class SeriesTable:
    """A table of (symbol, ts) rows in buckets of both, each bucket sorted by both.

    Two tables with as many buckets meet by their key bucket by bucket, and a symbol with a third of all rows
    is in all buckets. Filters on symbols and instants reach the files, whose statistics leave out what
    cannot match. The table is external: its files are in a folder that all executors share.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64) -> None:
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def save(self, rows: DataFrame) -> None:
        """Replace the table. One file a bucket: rows are dealt as the buckets are."""
        dealt = rows.repartition(self.buckets, *KEY)
        dealt.write.mode("overwrite").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.path).saveAsTable(self.name)

    def read(self, symbols: list[str] | DataFrame | None = None, end: str | None = None) -> DataFrame:
        """The rows of some symbols (trimmed, upper case, each once) up to and with an end instant."""
        rows = self.spark.table(self.name)
        if end is not None:
            rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp"))
        if symbols is None:
            return rows
        if isinstance(symbols, list):
            names = sorted({s.strip().upper() for s in symbols if s and s.strip()})
            if len(names) <= LISTED:
                return rows.where(F.col("symbol").isin(names))
            symbols = self.spark.createDataFrame([(n,) for n in names], "symbol string")
        wanted = symbols.select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
        few = wanted.limit(BROADCAST_SYMBOLS + 1).count() <= BROADCAST_SYMBOLS
        return rows.join(F.broadcast(wanted) if few else wanted, "symbol", "left_semi")


def joined(prices: SeriesTable, features: SeriesTable, symbols: list[str] | DataFrame | None = None, end: str | None = None) -> DataFrame:
    """Clean prices with their feature rows, for some symbols up to an end instant; prices come from the prices' table."""
    own = prices.read(symbols, end).select(*KEY, "open", "high", "low", "close", "volume")
    more = features.read(symbols, end).drop("open", "high", "low", "close", "volume")
    return own.join(more, KEY)
