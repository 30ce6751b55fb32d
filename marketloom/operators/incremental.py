"""Features of new bars from what is kept of each symbol, without its history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.smoothing import with_resumed_smoothing
from marketloom.operators.features import complete, numeric, window_features, with_trend
from marketloom.schemas import KEY, PRICES, VALUES
from marketloom.session import shared_folder
from marketloom.sources.keyed import KeyedStore, keep_last

#: Bars of a symbol that are kept for the frames over the next ones: the widest has 200, and a return looks back one more.
KEPT = 201
#: Buckets of symbols; only those that a batch touches are rewritten.
BUCKETS = 64


class FeatureStore:
    """Features by year, and for each symbol the state that its next bars need.

    The state of a symbol is one row: its last instant, the numbers of its recursions (once it has 34 bars)
    and its last 201 bars. A batch reads the states and touched rows of its own symbols alone, whatever their
    history: no bar is read twice. Features are inserted first (a row that is there stays), then all states are
    committed at once: a batch that fails in between is simply run again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.states = KeyedStore(spark, f"{path}/states", ["symbol"], "bucket")
        self.features = KeyedStore(spark, f"{path}/features", KEY, "year")

    def advance(self, bars: DataFrame) -> int:
        """Add the features of new bars (symbol, ts, PRICES); gives the number of complete rows among them.

        Of bars with one key the last by all their columns counts. Bars that are not behind their symbol's
        last instant are left out: history is not rewritten bar by bar. Bars without a symbol or instant play no part.
        """
        shared_folder(self.spark)
        rows = numeric(bars.where("symbol is not null and ts is not null").select(*KEY, *PRICES))
        states = self.states.read()
        if states is None:
            tail = ", ".join(f"{c} double" for c in PRICES)
            states = self.spark.createDataFrame([], f"symbol string, last_ts timestamp, state array<double>, tail array<struct<ts timestamp, {tail}>>, bucket int")
        touched = rows.select("symbol").distinct()
        # the batch is read several times, and its states before they are replaced
        states = states.join(touched, "symbol", "left_semi").checkpoint()
        fresh = keep_last(rows, KEY).join(states.select("symbol", "last_ts"), "symbol", "left").where("last_ts is null or ts > last_ts").drop("last_ts")
        fresh = fresh.checkpoint()
        old = states.select("symbol", F.inline("tail"))
        both = fresh.withColumn("seen", F.lit(False)).unionByName(old.withColumn("seen", F.lit(True)))
        both = both.join(states.select("symbol", "state"), "symbol", "left")
        found = with_trend(with_resumed_smoothing(window_features(both))).checkpoint()
        features = complete(found.where("not seen"), VALUES).select(*KEY, *VALUES, F.year("ts").alias("year"))
        self.features.insert(features)
        back = Window.partitionBy("symbol").orderBy(F.desc("ts"))
        last = found.select("symbol", F.struct("ts", *PRICES).alias("bar"), "ts").withColumn("n", F.row_number().over(back)).where(F.col("n") <= KEPT)
        tails = last.groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.array_sort(F.collect_list("bar")).alias("tail"))
        new = found.where("new_state is not null").groupBy("symbol").agg(F.max_by("new_state", "ts").alias("new_state"))
        moved = tails.join(new, "symbol", "left").join(states.select("symbol", "state"), "symbol", "left").join(fresh.select("symbol").distinct(), "symbol", "left_semi")
        bucket = F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)).cast("int").alias("bucket")
        self.states.upsert(moved.select("symbol", "last_ts", F.coalesce("new_state", "state").alias("state"), "tail", bucket))
        return features.count()
