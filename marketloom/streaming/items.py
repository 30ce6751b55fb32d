"""News items from a stream into raw and clean tables, with scores and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.vectors import score_texts
from marketloom.session import shared_folder
from marketloom.sources import news
from marketloom.sources.keyed import keep_first, keep_last
from marketloom.streaming import ingest

RAW_KEY = ["source", "external_id"]
#: What marks a delivery as one that was there before: the same item with the same content.
DELIVERY = [*RAW_KEY, "content_sha256"]


class NewsStore:
    """Raw items (the last delivery of each source and external id) and clean ones (each content once, the first).

    Every batch appends its part of each table under its number and replaces it if it runs again; readers
    take what counts. A batch reads of the earlier clean items their content hashes alone.
    """

    def __init__(self, spark: SparkSession, path: str, make_model: Callable | None = None) -> None:
        self.spark, self.path, self.make_model = spark, path, make_model

    def _read(self, name: str, before: int | None = None) -> DataFrame | None:
        try:
            rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return rows if before is None else rows.where(F.col("batch") < before)

    def raw(self) -> DataFrame:
        return keep_last(self._read("raw"), RAW_KEY, "batch", "row_seq").drop("batch")

    def clean(self) -> DataFrame:
        return self._read("clean").drop("batch")

    def counts(self) -> DataFrame:
        """(batch, items, raw_added, clean_added, scored) of each batch: its items, the raw keys and the contents that are new, and how many of these have a score."""
        return self._read("counts")

    def add(self, items: DataFrame, number: int) -> None:
        """One batch: raw upsert, then scores of what has new content alone, then the clean insert.

        items: news.ITEM and source. Titles and summaries are cut in the clean table; a blank text has no score, and
        without a model none has. Copies within a batch count once: the first by row_seq is the clean one.
        """
        shared_folder(self.spark)
        items = items.checkpoint()
        if items.isEmpty():
            # a stream runs a batch without items when its watermark moves
            return
        own = f"batch={number}"
        raw = keep_last(items, RAW_KEY, "row_seq").checkpoint()
        stored = self._read("raw", number)
        added = raw if stored is None else raw.join(stored.select(*RAW_KEY).distinct(), RAW_KEY, "left_anti")
        clean = self._read("clean", number)
        fresh = news.silver(items.limit(0) if clean is None else clean, items)
        fresh = score_texts(fresh, self.make_model) if self.make_model else fresh.withColumn("score", F.lit(None).cast("double"))
        # the hash is the item's name: a serial number would need one writer
        fresh = fresh.withColumn("article_id", F.xxhash64("content_sha256")).checkpoint()
        counts = items.agg(F.count("*").alias("items")).join(added.agg(F.count("*").alias("raw_added"))).join(fresh.agg(F.count("*").alias("clean_added"), F.count("score").alias("scored")))
        for name, rows in (("raw", raw), ("clean", fresh), ("counts", counts.checkpoint())):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/{own}")


def run(stream: DataFrame, store: NewsStore, offsets: str, delay: str = "3 days") -> None:
    """Take up all items that have landed since the last run and stop.

    A delivery that comes again unchanged within the delay is dropped by what the stream remembers, before anything is
    read or scored; what comes again later meets the stored items. Time here is that of arrival: items are never
    too late, however old their dates.
    """
    arrived = stream.withColumn("arrived", F.current_timestamp())
    known = arrived.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(DELIVERY).drop("arrived")
    ingest.start(known, offsets, store.add).awaitTermination()


def united(providers: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(items, counts) of several providers: one item for each external id and content, of the first provider that has it, then its first row.

    counts: (provider, fetched, kept) by the providers' places.
    """
    rows = None
    for place, own in enumerate(providers):
        tagged = own.select(*news.ITEM).withColumn("provider", F.lit(place))
        rows = tagged if rows is None else rows.unionByName(tagged)
    items = keep_first(rows, ["external_id", "content_sha256"], "provider", "row_seq")
    fetched = rows.groupBy("provider").agg(F.count("*").alias("fetched"))
    left = items.groupBy("provider").agg(F.count("*").alias("kept"))
    return items, fetched.join(left, "provider", "left").na.fill(0, ["kept"])
