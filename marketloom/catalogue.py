"""Every query of the market-analytics operators with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketloom.plans import backtest, context, features, ingest, models, news, prices, reports, serving

AREAS = [features, prices, context, backtest, news, models, reports, serving, ingest]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for area in AREAS for name, query in area.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: text for area in AREAS for name, text in area.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["k1_latest_features"](spark, sf_dir)
