"""Backtest artifacts and experiment logs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marketloom.schemas import THRESHOLD


def save_splits(rows: DataFrame, path: str) -> None:
    """Rows by split, sorted by symbol and ts within each file, as CSV."""
    rows.repartition("split").sortWithinPartitions("split", "symbol", "ts").write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def load_split(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """All splits, or one; the split's folders are partitions, so that others are not read."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return rows if split is None else rows.where(F.col("split") == split)


def splits(spark: SparkSession, path: str) -> list[int]:
    return [r["split"] for r in load_split(spark, path).select("split").distinct().orderBy("split").collect()]


def heads(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows of each split and part."""
    order = Window.partitionBy("split", "part").orderBy("ts", "symbol")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def save_grid(grid: DataFrame, path: str) -> None:
    grid.write.mode("overwrite").json(path)


def best_threshold(spark: SparkSession, path: str) -> float:
    """The stored best threshold; the default where none is stored."""
    try:
        row = spark.read.json(path).select("threshold").first()
    except AnalysisException:
        row = None
    return float(row["threshold"]) if row and row["threshold"] is not None else THRESHOLD


def log_experiment(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).orderBy(F.desc("directional_accuracy"), "logged_at")
