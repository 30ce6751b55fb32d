"""Keyed tables on plain files: last writer wins, first writer wins, and stores that rewrite what a write touches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.session import shared_folder


def keep_last(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the last by the order columns; without any, by all other columns."""
    order = order or tuple(c for c in rows.columns if c not in keys)
    back = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(o) for o in order))
    return rows.withColumn("__n", F.row_number().over(back)).where("__n = 1").drop("__n")


def keep_first(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the first by the order columns; without any, by all other columns."""
    order = order or tuple(c for c in rows.columns if c not in keys)
    forth = Window.partitionBy(*keys).orderBy(*(F.asc_nulls_last(o) for o in order))
    return rows.withColumn("__n", F.row_number().over(forth)).where("__n = 1").drop("__n")


def last_wins(stored: DataFrame, incoming: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The table after an upsert: incoming rows replace stored ones, later incoming ones earlier ones."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, "__new", *order).drop("__new")


def first_wins(stored: DataFrame, incoming: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows to append: of keys that are not stored yet, the first incoming one."""
    return keep_first(incoming.join(stored.select(*keys).distinct(), keys, "left_anti"), keys, *order)


class KeyedStore:
    """A keyed Parquet table whose writes rewrite the touched partitions alone, each as a new version.

    Rows lie in data/<partition>=.../version=.../; a manifest lists each partition's version. A write
    puts new versions beside the old ones and then commits them with the next manifest: a reader sees all of a
    write or nothing of it, untouched partitions are neither read nor copied, and a write that is cut off leaves
    the table as it was. Of two writers that begin with one manifest the second one fails. Old versions stay,
    so that a commit can be read again. path is a folder that all executors share.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], partition: str) -> None:
        self.spark, self.path, self.keys, self.partition = spark, path, keys, partition

    @property
    def commits(self) -> list[int]:
        """Numbers of the committed manifests."""
        try:
            found = self.spark.read.schema("commit int").parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r["commit"] for r in found.select("commit").distinct().collect())

    def _manifest(self, commit: int | None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest/commit={commit}").where("version is not null")

    def _data(self) -> DataFrame:
        """All versions of all rows; an empty file keeps the columns, as a table may have no rows."""
        columns = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(T.StructType([*columns.fields, T.StructField("version", T.StringType())])).parquet(f"{self.path}/data")

    def read(self, commit: int | None = None) -> DataFrame | None:
        """The rows as of a commit (else the last one); None before the first. Only listed versions are read."""
        commits = self.commits
        if not commits:
            return None
        live = self._manifest(commits[-1] if commit is None else commit)
        rows = self._data()
        shared = F.broadcast(live.withColumnRenamed(self.partition, "__p").withColumnRenamed("version", "__v"))
        return rows.join(shared, F.col(self.partition).cast("string").eqNullSafe(F.col("__p")) & (F.col("version") == F.col("__v")), "left_semi").drop("version")

    def _commit(self, rows: DataFrame, touched: DataFrame, before: int | None) -> None:
        """Write the touched partitions' rows and make them the table's. touched: all partitions that rows replace, those left empty included."""
        version = uuid.uuid4().hex
        if before is None:
            rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")
        rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy(self.partition, "version").parquet(f"{self.path}/data")
        name = F.col(self.partition).cast("string").alias(self.partition)
        there = self._data().where(F.col("version") == version).select(name, "version").distinct()
        # a row without a version stands for the commit itself: a table may be empty
        live = there.unionByName(self.spark.range(1).select(F.lit(None).cast("string").alias(self.partition), F.lit(None).cast("string").alias("version")))
        if before is not None:
            gone = touched.select(name.alias("__p")).distinct()
            kept = self._manifest(before).join(F.broadcast(gone), F.col(self.partition).eqNullSafe(F.col("__p")), "left_anti")
            live = live.unionByName(kept)
        live.coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/commit={(before or 0) + 1}")

    def _write(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        shared_folder(self.spark)
        incoming = incoming.checkpoint()
        commits = self.commits
        before = commits[-1] if commits else None
        touched = incoming.select(self.partition).distinct()
        stored = self.read(before)
        near = incoming.limit(0) if stored is None else stored.join(F.broadcast(touched.withColumnRenamed(self.partition, "__t")), F.col(self.partition).cast("string").eqNullSafe(F.col("__t").cast("string")), "left_semi").select(*(F.col(c).cast(t) if c == self.partition else F.col(c) for c, t in incoming.select(stored.columns).dtypes))
        self._commit(merge(near, incoming), touched, before)

    def upsert(self, incoming: DataFrame, *order: str) -> None:
        """Last writer wins: incoming rows replace stored ones of their key, later incoming ones earlier ones. Rows of one key must be in one partition."""
        self._write(incoming, lambda stored, rows: last_wins(stored, rows, self.keys, *order))

    def insert(self, incoming: DataFrame, *order: str) -> None:
        """First writer wins: rows of keys that are stored already are left out, and later incoming ones of a key."""
        self._write(incoming, lambda stored, rows: stored.unionByName(first_wins(stored, rows, self.keys, *order), allowMissingColumns=True))

    def delete(self, which: Column) -> int:
        """Remove the rows for which the condition is true; gives their number."""
        commits = self.commits
        if not commits:
            return 0
        shared_folder(self.spark)
        stored = self.read(commits[-1])
        counts = stored.where(which).groupBy(self.partition).agg(F.count("*").alias("n")).checkpoint()
        gone = counts.agg(F.sum("n")).first()[0] or 0
        if gone:
            same = F.col(self.partition).eqNullSafe(F.col("__t"))
            near = stored.join(F.broadcast(counts.select(F.col(self.partition).alias("__t"))), same, "left_semi")
            self._commit(near.where(~F.coalesce(which, F.lit(False))), counts, commits[-1])
        return gone
