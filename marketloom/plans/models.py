"""Queries of models, vectors and streams; SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.windows import last_rows
from marketloom.operators import experiments, forests, models, scanner, vectors
from marketloom.operators.features import numeric, window_features
from marketloom.operators.incremental import FeatureStore
from marketloom.operators.labels import chronological, trade_labels, walk_forward
from marketloom.plans import sql
from marketloom.plans.context import LABELS
from marketloom.plans.features import DAY, rounded
from marketloom.session import shared_folder
from marketloom.sources import tables
from marketloom.streaming import ingest

STREAMED = ["close", "return_20d", "sma_200", "ema_200", "ema_slope_20", "rsi_21", "macd_signal", "atr_14", "volatility_100", "stochastic_d", "bb_pband_20"]
INPUTS = ["return_1d", "return_5d", "roc_10", "bb_pband_20", "stochastic_k", "volatility_10"]


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = trade_labels(window_features(numeric(tables.bars_daily(spark, sf_dir)))).na.drop("any", subset=INPUTS)
    return walk_forward(bars, 1500, 250, 250).select("symbol", "ts", "split", "part", "open", "high", "low", "close", "trade_success", *INPUTS)


def walk_forward_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rounds of the fit read their rows again: they are computed once, in the shared folder
    shared_folder(spark)
    scored = experiments.logistic_scores(_splits(spark, sf_dir).checkpoint(), INPUTS)
    return scored.select("split", "symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), "trade_success", "prob_trade_success")


def walk_forward_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits, scores, errors, the threshold grid and the summary at the best threshold, with the chosen row's place in it."""
    found = experiments.run_experiment(_splits(spark, sf_dir), INPUTS)
    whole = found.summary.join(found.best.select(F.col("threshold").alias("best_threshold"), "selection_score", "tier"))
    numbers = [c for c, t in whole.dtypes if t == "double"]
    return whole.select(*(c for c in whole.columns if c not in numbers), *rounded(numbers))


def _forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a label and the forest's nodes, fitted to each symbol's first rows."""
    shared_folder(spark)
    rows = chronological(trade_labels(window_features(numeric(tables.bars_daily(spark, sf_dir)))).na.drop("any", subset=INPUTS)).checkpoint()
    model = models.estimator("random_forest", INPUTS).fit(rows.where("part = 'train'"))
    scored = models.with_probability(model, rows.where("part = 'test'").drop("prob_trade_success"))
    return scored, forests.forest_nodes(model, INPUTS)


def forest_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the forest splits by, with its held-out errors."""
    scored, nodes = _forest(spark, sf_dir)
    errors = models.evaluation(scored).select(*rounded(["accuracy", "prob_mean"]))
    return forests.forest_importances(nodes).select("feature", F.round("importance", 6).alias("importance"), "splits").join(errors)


def forest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's last decision by the forest, explained by its own importances."""
    scored, nodes = _forest(spark, sf_dir)
    rows = scored.withColumns({"probability": F.col("prob_trade_success"), "volume_sma_20": F.avg("volume").over(last_rows(20)), "ema_10": F.col("sma_10"), "ema_20": F.col("sma_20"), "macd": F.lit(0.0), "macd_signal": F.lit(0.0), "rsi_14": F.lit(50.0), "sym_sentiment_d1": F.lit(None).cast("double"), "spy_sentiment_d1": F.lit(None).cast("double")})
    out = scanner.explained_decisions(rows, 0.33, INPUTS, forests.forest_importances(nodes), magnitudes=3, bars=30)
    names = lambda c: F.array_join(F.col(f"{c}.feature"), ",").alias(c)
    return out.select("symbol", "should_trade", "reason", names("top_feature_magnitudes"), names("global_feature_importance"), F.size("chart_history").alias("bars"))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = trade_labels(tables.bars_daily(spark, sf_dir))
    return models.evaluation(scored).select(*rounded(["mae", "directional_accuracy", "accuracy", "prob_min", "prob_max", "prob_mean"]))


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "embeddings").withColumn("symbol", F.concat(F.lit("U"), F.col("label").cast("string")))
    points = rows.select("symbol", F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))
    queries = rows.where("vec_id % 100 = 0").select("symbol", F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.most_similar(queries, points).withColumn("score", F.round("score", 6))


def streamed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines streamed from their file and upserted by (symbol, ts)."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # a stream reads folders; one that is split in files lands batch by batch
    landed = f"{folder}/landed"
    lines.select(F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("symbol"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("close"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("line")).write.parquet(landed)
    stream = ingest.files(spark, landed, spark.read.parquet(landed).schema, 1)
    ingest.start(stream, f"{folder}/offsets", ingest.upsert_into(f"{folder}/table", ["symbol", "ts"], "line")).awaitTermination()
    return ingest.current(spark, f"{folder}/table", ["symbol", "ts"], "line").groupBy("symbol").agg(F.count("*").alias("bars"))


def incremental_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that land in three parts, each streamed into features from the states that the earlier ones left."""
    folder = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    bars = tables.bars_daily(spark, sf_dir).select("symbol", "ts", "open", "high", "low", "close", "volume")
    landed, store = f"{folder}/landed", FeatureStore(spark, f"{folder}/store")
    for part in ("ts < '1997-06-01'", "ts >= '1997-06-01' and ts < '2000-01-15'", "ts >= '2000-01-15'"):
        bars.where(part).write.mode("append").parquet(landed)
        ingest.start(ingest.files(spark, landed, bars.schema, 10_000), f"{folder}/offsets", ingest.features_into(store)).awaitTermination()
    return store.features.read().select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), *rounded(STREAMED))


QUERIES = {
    "t3_incremental_features": incremental_features,
    "m17_walk_forward_logistic": walk_forward_logistic,
    "m17_experiment": walk_forward_experiment,
    "m05_forest_importances": forest_importances,
    "x9_forest_decisions": forest_decisions,
    "m12_evaluation": evaluation,
    "d3_most_similar": similar,
    "t1_streamed_prices": streamed_prices,
}

ORACLE_SQL = {
    "t3_incremental_features": f"WITH RECURSIVE {sql.BARS}, {sql.features('bars')} SELECT symbol, {DAY}, {sql.rounded(STREAMED)} FROM features",
    "m12_evaluation": f"""WITH {LABELS}, k AS (SELECT prob_trade_success AS p, trade_success AS y FROM bars JOIN labels USING (symbol, ts) WHERE trade_success IS NOT NULL)
        SELECT round(avg(abs(p - y)), 6) AS mae, round(avg(CAST(sign(p) = sign(y) AS INTEGER)), 6) AS directional_accuracy,
          round(avg(CAST(CAST(p > 0.5 AS INTEGER) = y AS INTEGER)), 6) AS accuracy, round(min(p), 6) AS prob_min, round(max(p), 6) AS prob_max, round(avg(p), 6) AS prob_mean FROM k""",
    "d3_most_similar": """WITH e AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, list_cosine_similarity(q.v, p.v) AS score FROM e q JOIN e p ON q.label = p.label WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, point_id, round(score, 6) AS score FROM r WHERE n <= 5""",
    "t1_streamed_prices": """SELECT 'S' || CAST(l_suppkey % 20 AS VARCHAR) AS symbol, count(DISTINCT l_shipdate) AS bars FROM lineitem GROUP BY ALL""",
}
