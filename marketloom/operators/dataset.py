"""Training and scanning datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.context import attach_context
from marketloom.operators.features import latest
from marketloom.operators.labels import trade_labels
from marketloom.operators.scanner import stage_times
from marketloom.operators.sentiment import NEWS, attach_sentiment
from marketloom.schemas import KEY, MODEL_VECTOR
from marketloom.session import shared_folder


def with_scores(features: DataFrame, scores: DataFrame) -> DataFrame:
    return features.join(scores, KEY)


def model_matrix(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keys, the model vector's columns in order and all that the backtest needs; names missing ones."""
    columns = columns or MODEL_VECTOR
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing[:20])}")
    others = [c for c in ("open", "high", "low", "close", "volume", "trade_success") if c in rows.columns]
    return rows.select(*KEY, *others, *columns)


def dataset(features: DataFrame, scores: DataFrame, spy: DataFrame, qqq: DataFrame, vix: DataFrame, articles: DataFrame | None = None, labelled: bool = True) -> DataFrame:
    """Features, z-scores, market context, sentiment and (labelled) trade labels of all symbols at once."""
    whole = attach_sentiment(attach_context(scores, spy, qqq, vix), articles)
    rows = with_scores(features, whole)
    return trade_labels(rows) if labelled else rows


def context_is_shared(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(ts, symbols, same) of instants that several symbols have: whether their context is one and the same."""
    return rows.groupBy("ts").agg(F.countDistinct("symbol").alias("symbols"), (F.countDistinct(F.to_json(F.struct(*columns))) <= 1).alias("same")).where("symbols > 1")


def latest_rows(features: DataFrame, scores: DataFrame, spy: DataFrame, qqq: DataFrame, vix: DataFrame, articles: DataFrame | None = None, gold: DataFrame | None = None, cache: DataFrame | None = None, symbols: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, stages): each symbol's last feature row with its last z-scores, context and sentiment, and how far each stage got.

    Features and z-scores are cut to a row a symbol first: context and sentiment are looked up for
    these alone, in articles of the days that their windows reach. A symbol is in rows only where both last rows are of one
    instant and its context is complete. stages: (symbol, latest_features, latest_scores, latest_context,
    latest_merged) of every symbol that either table has; without symbols all are taken.
    """
    if symbols is not None:
        wanted = symbols.select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
        features, scores = features.join(wanted, "symbol", "left_semi"), scores.join(wanted, "symbol", "left_semi")
    shared_folder(features.sparkSession)
    own, z_rows = latest(features).checkpoint(), latest(scores).checkpoint()
    if articles is not None:
        reach = z_rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
        near = F.col(NEWS).between(F.lit(reach["a"]) - F.expr("INTERVAL 90 DAYS"), F.lit(reach["b"])) if reach["a"] is not None else F.lit(False)
        articles = articles.where(near)
    held = attach_sentiment(attach_context(z_rows, spy, qqq, vix), articles, gold, cache).checkpoint()
    rows = with_scores(own, held)
    return rows, stage_times(own, z_rows, held)
