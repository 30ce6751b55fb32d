"""Symbol universes: list files, page tables and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.schemas import MARKETS

#: Fewer constituents than this on a page are refused.
LEAST_CONSTITUENTS = 400


def ticker(c: Column) -> Column:
    """Trimmed, upper case, dots as dashes."""
    return F.translate(F.upper(F.trim(c)), ".", "-")


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a list file, one a line; blank lines and lines with # in front are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).select(ticker(F.col("line")).alias("symbol")).distinct()


def write_symbols(symbols: DataFrame, path: str) -> None:
    symbols.select("symbol").distinct().orderBy("symbol").coalesce(1).write.mode("overwrite").text(path)


def first_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """Each table row's first cell as a symbol: tags stripped, cut at a footnote's bracket, normalised, distinct."""
    cells = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>"), F.lit(1))
    symbols = pages.select(F.explode(cells).alias("cell")).withColumn("cell", F.regexp_replace("cell", "<[^>]*>", "")).select(ticker(F.split("cell", r"\[")[0]).alias("symbol"))
    return symbols.where("symbol <> ''").distinct()


def constituents(pages: DataFrame, html: str = "html", least: int = LEAST_CONSTITUENTS) -> DataFrame:
    symbols = first_cells(pages, html)
    found = symbols.count()
    if found < least:
        raise ValueError(f"only {found} constituents found, {least} are expected")
    return symbols


def resolve(symbols: DataFrame) -> DataFrame:
    """The ingestion universe: a file's symbols and the market indices."""
    spark = symbols.sparkSession
    return symbols.select("symbol").unionByName(spark.createDataFrame([(m,) for m in MARKETS], "symbol string")).distinct()


def training_pool(symbols: DataFrame, fallback: list[str]) -> DataFrame:
    """The universe without the market indices; the fallback list if nothing is left."""
    pool = symbols.where(~F.col("symbol").isin(MARKETS)).select("symbol").distinct()
    return symbols.sparkSession.createDataFrame([(s,) for s in fallback], "symbol string") if pool.isEmpty() else pool


def overlap(present: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: how many of the expected symbols are present, their share, and whether it is at least 0.95."""
    both = expected.select("symbol").distinct().join(present.select("symbol").distinct().withColumn("__there", F.lit(1)), "symbol", "left")
    share = F.try_divide(F.count("__there"), F.count("*"))
    return both.agg(F.count("__there").alias("overlap"), F.count("*").alias("expected"), share.alias("ratio"), (share >= 0.95).alias("passed"))
