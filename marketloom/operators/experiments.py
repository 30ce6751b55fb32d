"""The walk-forward experiment: models of all splits fitted together, scored, backtested and summed up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.batches import doubles
from marketloom.operators import thresholds
from marketloom.operators.backtest import PROBABILITY
from marketloom.schemas import TARGET
from marketloom.session import shared_folder

#: Added to the mean log loss: half of it times the squared weights of scaled columns (not the intercept).
PENALTY = 1e-4
MODEL = T.StructType([T.StructField("split", T.IntegerType()), T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType()), T.StructField("rows", T.LongType()), T.StructField("rounds", T.IntegerType())])


def complete_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a finite number in every column."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    kept = F.lit(True)
    for c in columns:
        kept = kept & finite(c)
    return rows.where(kept)


@dataclass
class Fit:
    """One split's fit while it goes on: the scaling of its columns, its weights (the intercept last) and the loss there."""

    n: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    loss: float = np.inf
    done: bool = False


def _sums(rows: DataFrame, columns: list[str], label: str, fits: dict[int, Fit]) -> dict[int, np.ndarray]:
    """Of every open split: loss, gradient and upper half of the Hessian at its weights, one after another; one job over all rows."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast({k: (f.mean, f.scale, f.weights) for k, f in fits.items() if not f.done})
    p = len(columns) + 1
    upper = np.triu_indices(p)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.stack(doubles(batch, *columns), axis=1)
            split, y = np.asarray(batch.column("split")), doubles(batch, label)[0]
            for key in np.unique(split).tolist():
                if key not in shared.value:
                    continue
                mean, scale, weights = shared.value[key]
                own = split == key
                z = np.append((x[own] - mean) * scale, np.ones((int(own.sum()), 1)), axis=1)
                margin = z @ weights
                chance = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                loss = float(np.sum(np.logaddexp(0, margin) - y[own] * margin))
                hessian = (z * (chance * (1 - chance))[:, None]).T @ z
                sums[key] = sums.get(key, 0) + np.concatenate([[loss], z.T @ (chance - y[own]), hessian[upper]])
        keys = list(sums)
        size = 1 + p + len(upper[0])
        values = np.concatenate([sums[k] for k in keys]) if keys else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, dtype=np.int32), size)), pa.array(np.tile(np.arange(size, dtype=np.int32), len(keys))), pa.array(values)], ["split", "at", "value"])

    found = rows.select("split", label, *columns).mapInArrow(add, "split int, at int, value double").groupBy("split", "at").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for row in found.collect():
        out.setdefault(row["split"], np.zeros(1 + p + len(upper[0])))[row["at"]] = row["value"]
    return out


def fit_logistic(train: DataFrame, columns: list[str], label: str = TARGET, penalty: float = PENALTY, rounds: int = 30, tolerance: float = 1e-9) -> DataFrame:
    """MODEL: a logistic regression for each split, all of them fitted together.

    train: split, label (0 or 1) and the columns. Every round is one job over all rows: tasks add up
    the loss, gradient and Hessian of each split, and the driver solves one small system a split (iteratively
    reweighted least squares, a step that does not lessen the loss is halved). Columns are scaled
    by their mean and sample deviation in the split; one that is constant there gets no weight. Weights are given for
    the columns as they are. Rows without a label or a number in a column are left out; a split with one
    label gets its chance, 0 or 1. A split in which no row is left has no model.
    """
    rows = complete_rows(train, [label, *columns]).select("split", label, *columns)
    moments = rows.groupBy("split").agg(F.count("*").alias("n"), F.sum(label).alias("ones"), *(f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))
    fits: dict[int, Fit] = {}
    ones: dict[int, float] = {}
    for r in moments.collect():
        sd = np.array([r[f"sd_{i}"] or 0.0 for i in range(len(columns))])
        scale = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0)
        fits[r["split"]] = Fit(r["n"], np.array([r[f"mean_{i}"] for i in range(len(columns))]), scale, np.zeros(len(columns) + 1), np.zeros(len(columns) + 1), done=r["ones"] in (0, r["n"]))
        ones[r["split"]] = r["ones"]
    ridge = np.append(np.full(len(columns), penalty), 0.0)
    took = dict.fromkeys(fits, 0)
    for _ in range(rounds):
        if all(f.done for f in fits.values()):
            break
        for key, sums in _sums(rows, columns, label, fits).items():
            _improve(fits[key], sums, ridge, tolerance)
            took[key] += 1
    models = []
    for key, f in sorted(fits.items()):
        own = f.weights[:-1] * f.scale
        chance = ones[key] / f.n
        intercept = float(f.weights[-1] - own @ f.mean) if 0 < chance < 1 else float("inf") * (1 if chance else -1)
        models.append((key, own.tolist(), intercept, f.n, took[key]))
    return train.sparkSession.createDataFrame(models, MODEL)


def _improve(fit: Fit, sums: np.ndarray, ridge: np.ndarray, tolerance: float) -> None:
    """One Newton step from the sums at the present weights; back by half a step where the loss there is no better."""
    p = len(ridge)
    loss = sums[0] / fit.n + 0.5 * float(ridge @ fit.weights**2)
    if loss > fit.loss + 1e-12 * abs(fit.loss):
        fit.step = fit.step / 2
        fit.weights = fit.weights - fit.step
        fit.done = bool(np.abs(fit.step).max() < tolerance)
        return
    fit.loss = loss
    half = np.zeros((p, p))
    half[np.triu_indices(p)] = sums[1 + p :]
    hessian = (half + np.triu(half, 1).T) / fit.n + np.diag(ridge)
    gradient = sums[1 : 1 + p] / fit.n + ridge * fit.weights
    # a constant column has neither gradient nor curvature: the least solution leaves it at 0
    fit.step = -np.linalg.lstsq(hessian, gradient, rcond=1e-13)[0]
    fit.weights = fit.weights + fit.step
    fit.done = bool(np.abs(fit.step).max() < tolerance)


def scored_by(models: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Test rows with the probability that their split's model gives them; rows without a number in a column or without a model are left out.

    models has one row a split, made by the driver: it is broadcast.
    """
    own = complete_rows(test, columns).drop(PROBABILITY).join(F.broadcast(models.select("split", "weights", "intercept")), "split")
    margin: Column = F.col("intercept")
    for i, c in enumerate(columns):
        margin = margin + F.get("weights", F.lit(i)) * F.col(c)
    return own.withColumn(PROBABILITY, 1 / (1 + F.exp(-margin))).drop("weights", "intercept")


def logistic_scores(splits: DataFrame, columns: list[str], label: str = TARGET) -> DataFrame:
    """Test rows of all splits, scored by logistic regressions of their splits' training rows."""
    models = fit_logistic(splits.where("part = 'train'"), columns, label)
    return scored_by(models, splits.where("part = 'test'").drop("part"), columns)


def split_errors(scored: DataFrame, label: str = TARGET) -> DataFrame:
    """(split, mae, directional_accuracy, prob_min, prob_max, prob_mean) of the classes: a probability over 0.5 is 1."""
    said = (F.col(PROBABILITY) > 0.5).cast("int")
    same = (F.signum(said.cast("double")) == F.signum(F.col(label).cast("double"))).cast("int")
    p = PROBABILITY
    return scored.groupBy("split").agg(F.avg(F.abs(said - F.col(label))).alias("mae"), F.avg(same).alias("directional_accuracy"), F.min(p).alias("prob_min"), F.max(p).alias("prob_max"), F.avg(p).alias("prob_mean"))


@dataclass
class Experiment:
    """scored: test rows with probabilities; errors, metrics: by split (and threshold); grid: by threshold; best: its chosen row; summary: one row."""

    scored: DataFrame
    errors: DataFrame
    metrics: DataFrame
    grid: DataFrame
    best: DataFrame
    summary: DataFrame


def evaluated(scored: DataFrame, levels: list[float] | None = None, label: str = TARGET, **choice) -> Experiment:
    """All that follows the scores: errors, the trading rule at every threshold, the choice of one and the summary there.

    scored: split, symbol, ts, close, high, low, the label and the probability. The rule is not run again at the
    chosen threshold: the grid has each split's metrics there. choice goes to thresholds.optimise().
    """
    shared_folder(scored.sparkSession)
    errors = split_errors(scored, label)
    metrics = thresholds.grid_metrics(scored, levels).checkpoint()
    grid, best = thresholds.optimise(scored, thresholds=levels, metrics=metrics, **choice)
    best = best.checkpoint()
    return Experiment(scored, errors, metrics, grid, best, summary(errors, metrics, best))


def summary(errors: DataFrame, metrics: DataFrame, best: DataFrame) -> DataFrame:
    """One row: mean errors over splits, and over the splits' metrics at the best threshold their means, all trades and the share of them that hit."""
    mean = lambda c, name, default=0.0: F.coalesce(F.avg(thresholds.finite(c)), F.lit(default)).alias(name)
    own = metrics.join(F.broadcast(best.select("threshold")), "threshold", "left_semi").agg(
        mean("cum_return", "avg_strategy_cum_return", 1.0), mean("cum_market_return", "avg_market_return", 1.0),
        F.coalesce(100 * F.try_divide(F.sum("strategy_directional_hits"), F.sum("strategy_trade_count")), F.lit(0.0)).alias("avg_strategy_directional_accuracy"),
        F.coalesce(F.sum("strategy_trade_count"), F.lit(0)).alias("strategy_total_trades"), F.coalesce(F.sum("strategy_directional_hits"), F.lit(0)).alias("strategy_total_hits"),
        mean("win_rate", "avg_win_rate"), mean("profit_factor", "avg_profit_factor"), mean("max_drawdown", "avg_max_drawdown"),
    )
    return errors.agg(F.avg("mae").alias("avg_mae"), F.avg("directional_accuracy").alias("avg_directional_accuracy")).join(own)


def run_experiment(splits: DataFrame, columns: list[str], score: Callable[[DataFrame, list[str]], DataFrame] = logistic_scores, levels: list[float] | None = None, label: str = TARGET, **choice) -> Experiment:
    """Fit, score, evaluate and backtest all splits, search the threshold and sum up.

    splits: rows with split and part, as labels.walk_forward() gives them. score makes the test rows' scores
    of all splits; models.walk_forward_scores() serves for estimators that are fitted one after another.
    """
    shared_folder(splits.sparkSession)
    return evaluated(score(splits.checkpoint(), columns).checkpoint(), levels, label, **choice)
