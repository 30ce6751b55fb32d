"""The walk-forward experiment against plain Python: fits, one-pass grid, summary, missing prices."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import backtest, experiments, models, thresholds

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "split int, part string, symbol string, ts timestamp, close double, high double, low double, trade_success int, a double, b double, c double"


def rows(splits=3, days=40, symbols=3, seed=8):
    r = random.Random(seed)
    out = []
    for split in range(splits):
        for s in range(symbols):
            price = 100.0
            for d in range(days):
                price *= 1 + r.uniform(-0.04, 0.04)
                a, b = r.gauss(split, 2), r.gauss(0, 0.01)
                y = int(r.random() < 1 / (1 + math.exp(-(0.8 * (a - split) - 40 * b + 0.2))))
                high, low = price * (1 + r.uniform(0, 0.03)), price * (1 - r.uniform(0, 0.03))
                out.append((split, "train" if d < days * 2 // 3 else "test", f"S{s}", DAY + dt.timedelta(days=d + 7 * split), price, high, low, y, a, b, 5.0))
    return out


def descent(x, y, penalty):
    """The same optimum by Newton steps on scaled columns, in plain numpy."""
    mean, sd = x.mean(0), x.std(0, ddof=1)
    scale = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0)
    z = np.append((x - mean) * scale, np.ones((len(x), 1)), 1)
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], penalty), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        g = z.T @ (p - y) / len(y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(ridge)
        w -= np.linalg.pinv(h) @ g
    own = w[:-1] * scale
    return own, w[-1] - own @ mean


def test_all_splits_are_fitted_together(spark):
    data = rows()
    data += [(3, "train", "S0", DAY, 1.0, 1.0, 1.0, 1, float(i), 0.0, 1.0) for i in range(5)]  # one label
    data += [(0, "train", "S0", DAY, 1.0, 1.0, 1.0, 1, None, 0.0, 1.0), (0, "train", "S0", DAY, 1.0, 1.0, 1.0, 0, math.nan, 0.0, 1.0), (4, "test", "S0", DAY, 1.0, 1.0, 1.0, 0, 1.0, 0.0, 1.0)]
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = {r.split: r for r in experiments.fit_logistic(frame.where("part = 'train'"), ["a", "b", "c"]).collect()}
    assert sorted(found) == [0, 1, 2, 3] and found[3].intercept == math.inf and found[0].rounds < 20
    for split in range(3):
        own = [x for x in data if x[0] == split and x[1] == "train" and x[8] is not None and x[8] == x[8]]
        weights, intercept = descent(np.array([x[8:11] for x in own]), np.array([x[7] for x in own]), experiments.PENALTY)
        assert found[split].weights == pytest.approx(weights.tolist(), abs=1e-6) and found[split].intercept == pytest.approx(intercept, abs=1e-6)
        assert found[split].weights[2] == 0.0 and found[split].rows == len(own)
    scored = experiments.logistic_scores(frame, ["a", "b", "c"]).collect()
    assert {r.split for r in scored} == {0, 1, 2}
    for r in scored:
        m = found[r.split]
        assert r.prob_trade_success == pytest.approx(1 / (1 + math.exp(-(m.intercept + m.weights[0] * r.a + m.weights[1] * r.b))))
    # the estimator of the registry, fitted split by split, comes to the same scores
    one, _ = models.walk_forward_scores(frame.where("split < 3 and a is not null and not isnan(a)"), ["a", "b", "c"], lambda: models.estimator("logistic_regression", ["a", "b", "c"], scaled=True))
    key = lambda r: (r.split, r.symbol, r.ts)
    assert [r.prob_trade_success for r in sorted(one.collect(), key=key)] == pytest.approx([r.prob_trade_success for r in sorted(scored, key=key)], abs=2e-3)
    assert experiments.fit_logistic(frame.limit(0), ["a"]).collect() == []


def test_grid_in_one_pass_equals_one_threshold_at_a_time(spark):
    r = random.Random(3)
    data = [(x[0], x[2], x[3], x[4] if r.random() < 0.95 else None, x[5] if r.random() < 0.95 else math.nan, x[6] if r.random() < 0.95 else None, r.choice([None, r.random(), r.random()])) for x in rows(days=60)]
    data += [data[3], data[10]]
    frame = spark.createDataFrame([(*x, n) for n, x in enumerate(data)], "split int, symbol string, ts timestamp, close double, high double, low double, prob_trade_success double, row_seq int").repartition(4)
    levels = [0.1, 0.5, 0.8, 1.0]
    got = backtest.grid_backtest(frame, ["split"], levels)
    want = backtest.backtest(backtest.with_threshold(frame, levels), "threshold", ["split", "threshold"])
    assert sorted(got.columns) == sorted(want.columns) and got.count() == 12
    names = sorted(want.columns)
    rounded = lambda frame: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in (x[c] for c in ["split", "threshold", *names])) for x in frame.collect()])
    assert rounded(got) == rounded(want)


@pytest.mark.parametrize(("bar", "price"), [((102.0, 103.0, 99.0), 101.0), ((102.0, math.nan, 99.0), 102.0), ((102.0, None, None), 102.0), ((None, None, None), 100.0), ((math.nan, 103.0, math.nan), 100.0)])
def test_a_deadline_without_prices(spark, bar, price):
    """The middle of high and low, else the close, else the entry's price."""
    series = [(100.0, 101.0, 99.0, 0.9)] + [(100.0, 102.0, 99.0, 0.0)] * 14 + [(*bar, 0.0)] + [(100.0, 102.0, 99.0, 0.0)] * 3
    frame = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), *x) for i, x in enumerate(series)], "symbol string, ts timestamp, close double, high double, low double, prob_trade_success double")
    got = backtest.trades(backtest.numbered(frame, ["symbol"]), ["symbol"], F.lit(0.5)).collect()
    assert [(x.exit_i, x.exit_price, round(x.trade_return, 9)) for x in got] == [(15, price, round(price / 100 - 1, 9))]


def test_the_summary_is_that_of_the_best_threshold(spark):
    frame = spark.createDataFrame(rows(days=60), SCHEMA)
    found = experiments.run_experiment(frame, ["a", "b"], levels=[0.2, 0.4, 0.6], least_trades=1)
    best = found.best.collect()[0]
    own = [m for m in found.metrics.collect() if m.threshold == best.threshold]
    s = found.summary.collect()[0]
    mean = lambda c: sum(m[c] for m in own) / len(own)
    trades, hits = sum(m.strategy_trade_count for m in own), sum(m.strategy_directional_hits for m in own)
    assert (s.strategy_total_trades, s.strategy_total_hits) == (trades, hits) and s.avg_strategy_directional_accuracy == pytest.approx(100 * hits / trades)
    for c, name in (("cum_return", "avg_strategy_cum_return"), ("cum_market_return", "avg_market_return"), ("win_rate", "avg_win_rate"), ("profit_factor", "avg_profit_factor"), ("max_drawdown", "avg_max_drawdown")):
        assert s[name] == pytest.approx(mean(c))
    again = {r.split: r for r in backtest.backtest(found.scored.withColumn("t", F.lit(best.threshold)), "t", ["split"]).collect()}
    assert {m.split: round(m.cum_return, 9) for m in own} == {k: round(r.cum_return, 9) for k, r in again.items()}
    errors = {}
    for x in found.scored.collect():
        said = int(x.prob_trade_success > 0.5)
        errors.setdefault(x.split, []).append((abs(said - x.trade_success), said == x.trade_success))
    assert s.avg_mae == pytest.approx(sum(sum(e for e, _ in v) / len(v) for v in errors.values()) / len(errors))
    assert s.avg_directional_accuracy == pytest.approx(sum(sum(d for _, d in v) / len(v) for v in errors.values()) / len(errors))


def test_nothing_to_sum_up(spark):
    frame = spark.createDataFrame([], SCHEMA)
    found = experiments.run_experiment(frame, ["a"])
    assert found.best.collect() == [] and found.grid.collect() == []
    row = found.summary.collect()[0]
    assert (row.avg_mae, row.avg_strategy_cum_return, row.strategy_total_trades, row.avg_strategy_directional_accuracy) == (None, 1.0, 0, 0.0)
    assert thresholds.mean_errors(frame.withColumn("prob_trade_success", F.lit(0.5))).collect() == []


def _tied(spark):
    """Tests of three splits, and metrics of two thresholds with the same trades whose returns are added in another order."""
    tests = spark.createDataFrame([(s, "A", dt.datetime(2024, 1, 1 + s), 100.0, 101.0, 99.0, 0.9, 1) for s in range(3)], "split int, symbol string, ts timestamp, close double, high double, low double, prob_trade_success double, trade_success int")
    returns = {0.05: (0.3, 0.2, 0.1), 0.1: (0.1, 0.2, 0.3)}
    rows = [(s, t, r, 1.0, 2.0, -0.1, 0.5, 0.01, 50.0, 9, 4) for t, own in returns.items() for s, r in enumerate(own)]
    names = "split int, threshold double, cum_return double, cum_market_return double, profit_factor double, max_drawdown double, win_rate double, expectancy double, directional_accuracy double, strategy_trade_count long, strategy_directional_hits long"
    return tests, spark.createDataFrame(rows, names).coalesce(1)


def test_the_least_of_equal_thresholds_is_best(spark):
    tests, metrics = _tied(spark)
    assert thresholds.optimise(tests, "avg_cum_return", metrics=metrics, thresholds=[0.05, 0.1])[1].first().threshold == 0.05


def test_an_experiment_keeps_the_least_of_equal_thresholds(spark, monkeypatch):
    tests, metrics = _tied(spark)
    monkeypatch.setattr(thresholds, "grid_metrics", lambda *_: metrics)
    found = experiments.evaluated(tests, [0.05, 0.1], objective="avg_cum_return")
    assert found.best.first().threshold == 0.05 and found.summary.first().strategy_total_trades == 27
