"""Structured Streaming: prices and news from landed files into keyed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marketloom.operators.incremental import FeatureStore
from marketloom.sources.keyed import keep_last


def files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run what has landed and stop; offsets in the checkpoint are the watermark of the next run."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """Each batch appends its last row of each key under its number; a batch that runs again replaces itself."""

    def handle(batch: DataFrame, number: int) -> None:
        keep_last(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def current(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The upserted table: of each key the row of the latest batch, then the last by the order column."""
    return keep_last(spark.read.option("basePath", path).parquet(path), keys, "batch", order).drop("batch")


def without_copies(stream: DataFrame, key: str = "content_sha256", time: str = "published_at", delay: str = "3 days") -> DataFrame:
    """Items once each: copies that come within the delay are dropped, and the state with them."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str = "published_at", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Articles and mean score of each symbol in tumbling windows."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), "symbol").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def features_into(store: FeatureStore) -> Callable[[DataFrame, int], None]:
    """Each batch of bars goes on where the last one ended; a batch that runs again adds nothing twice."""

    def handle(batch: DataFrame, number: int) -> None:
        store.advance(batch)

    return handle
