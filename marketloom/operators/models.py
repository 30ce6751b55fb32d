"""Walk-forward training with pyspark.ml and batch prediction."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.scalars import clamp
from marketloom.schemas import TARGET

#: Estimators by name; each takes feature and label columns.
REGISTRY: dict[str, Callable] = {
    "random_forest": lambda label: RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=200, maxDepth=6, seed=42),
    "logistic_regression": lambda label: LogisticRegression(featuresCol="features", labelCol=label, standardization=False, regParam=1e-4, maxIter=100),
    "linear_regression": lambda label: LinearRegression(featuresCol="features", labelCol=label),
}


def estimator(name: str, columns: list[str], label: str = TARGET, scaled: bool = False) -> Pipeline:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name}; expected one of {', '.join(REGISTRY)}")
    raw = "raw_features" if scaled else "features"
    stages = [VectorAssembler(inputCols=columns, outputCol=raw, handleInvalid="skip")]
    stages += [StandardScaler(inputCol=raw, outputCol="features", withMean=True)] if scaled else []
    return Pipeline(stages=[*stages, REGISTRY[name](label)])


def probability(scored: DataFrame) -> Column:
    """The positive class's probability, else the prediction clamped to 0..1."""
    return vector_to_array(F.col("probability"))[1] if "probability" in scored.columns else clamp(F.col("prediction"), 0.0, 1.0)


def with_probability(model: PipelineModel, rows: DataFrame, name: str = "prob_trade_success") -> DataFrame:
    scored = model.transform(rows)
    added = [c for c in ("raw_features", "features", "rawPrediction", "probability", "prediction") if c in scored.columns]
    return scored.withColumn(name, probability(scored)).drop(*added)


def evaluation(scored: DataFrame, label: str = TARGET, p: str = "prob_trade_success") -> DataFrame:
    """One row: mean absolute error, share of equal signs, accuracy of p > 0.5 and the probabilities' range and mean."""
    same = (F.signum(F.col(p)) == F.signum(F.col(label).cast("double"))).cast("int")
    right = ((F.col(p) > 0.5).cast("int") == F.col(label)).cast("int")
    return scored.agg(F.avg(F.abs(F.col(p) - F.col(label))).alias("mae"), F.avg(same).alias("directional_accuracy"), F.avg(right).alias("accuracy"), F.min(p).alias("prob_min"), F.max(p).alias("prob_max"), F.avg(p).alias("prob_mean"))


def walk_forward_scores(splits: DataFrame, columns: list[str], make: Callable[[], Pipeline]) -> tuple[DataFrame, PipelineModel | None]:
    """Test rows of every split, scored by the model of its training rows, and the last model.

    splits: rows with split and part. The driver loops over splits to fit; each fit is distributed
    and scores stay lazy.
    """
    numbers = [r["split"] for r in splits.select("split").distinct().orderBy("split").collect()]
    scored, model = [], None
    for number in numbers:
        own = splits.where(F.col("split") == number)
        model = make().fit(own.where("part = 'train'"))
        scored.append(with_probability(model, own.where("part = 'test'")))
    return (reduce(DataFrame.unionByName, scored) if scored else splits.limit(0)), model


def importances(model: PipelineModel, columns: list[str], n: int = 12) -> DataFrame:
    """(feature, importance) of a forest, or of the size of linear coefficients."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(c, abs(float(v))) for c, v in zip(columns, values.toArray(), strict=True)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def area(scored: DataFrame, label: str = TARGET, p: str = "prob_trade_success") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=p, labelCol=label).evaluate(scored)


def save_model(model: PipelineModel, columns: list[str], path: str) -> None:
    """The fitted pipeline (a scaler is one of its stages) and the ordered list of its input columns, in a folder that all executors share."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "place int, column string").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def load_model(path: str) -> tuple[PipelineModel, list[str]]:
    columns = SparkSession.active().read.parquet(f"{path}/columns").orderBy("place").collect()
    return PipelineModel.load(f"{path}/model"), [r["column"] for r in columns]


def prediction_table(model: PipelineModel, rows: DataFrame, actual: str, band: float = 0.02) -> DataFrame:
    """(symbol, ts, predicted_return, signal, actual_return): signal is 1 over the band, -1 below it, else 0."""
    p = F.col("prediction")
    sign = F.when(p > band, 1).when(p < -band, -1).otherwise(0)
    return model.transform(rows).select("symbol", "ts", p.alias("predicted_return"), sign.alias("signal"), F.col(actual).alias("actual_return"))


#: Fields of an experiment's record and what of the summary and of the best grid row they hold (fixed values).
SUMMED = {
    "avg_strategy_cum_return": "cum_strategy_return", "avg_market_return": "cum_market_return", "avg_strategy_directional_accuracy": "directional_accuracy_strategy",
    "strategy_total_trades": "strategy_total_trades", "strategy_total_hits": "strategy_total_hits", "avg_win_rate": "avg_win_rate", "avg_profit_factor": "avg_profit_factor", "avg_max_drawdown": "avg_max_drawdown",
}
CHOSEN = {
    "threshold": "best_threshold", "avg_cum_return": "opt_avg_cum_return", "avg_cum_market_return": "opt_avg_cum_market_return",
    "avg_profit_factor": "opt_avg_profit_factor", "avg_win_rate": "opt_avg_win_rate", "total_trades": "opt_total_trades",
}


def experiment_record(model: str, symbol: str, symbols: list[str], summary: DataFrame, best: DataFrame, features: int) -> DataFrame:
    """One row of 22 fields: what was run, its mean errors, the summary at the best threshold and that threshold's grid row.

    summary: of experiments.summary(). best: the chosen row of the threshold grid; it may be empty.
    """
    head = summary.select(
        F.lit(model).alias("model"), F.lit(symbol).alias("symbol"), F.lit(len(symbols)).alias("n_symbols"), F.lit(",".join(symbols)).alias("symbols"),
        F.round("avg_mae", 4).alias("mae"), F.round("avg_directional_accuracy", 4).alias("directional_accuracy"), F.lit(features).alias("features"),
        *(F.col(c).alias(n) for c, n in SUMMED.items()), F.col("avg_market_return").alias("cum_market_return_pooled_eqw"),
    )
    return head.join(best.select(*(F.col(c).alias(n) for c, n in CHOSEN.items())), F.lit(True), "left")


def logged(record: DataFrame, now: datetime.datetime) -> DataFrame:
    """A record with its UTC time, to be appended to the log."""
    return record.select(F.lit(now.isoformat()).alias("logged_at"), "*")
