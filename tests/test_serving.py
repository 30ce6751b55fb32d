"""Decisions, records, stored models and calendars on small tables with nulls, ties and repeats."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import calendars, scalars
from marketloom.operators import backtest, models, reports, scanner
from marketloom.schemas import CHART, FEATURES, MODEL_VECTOR
from marketloom.sources import ohlcv, tables

DAY = datetime.datetime(2024, 1, 2)


def test_model_vector():
    assert len(FEATURES) == 45 and len(MODEL_VECTOR) == 71 and len(CHART) == 17


def test_clamp_keeps_null(spark):
    rows = spark.createDataFrame([(None,), (-9.0,), (0.5,), (9.0,)], "x double")
    assert [r.c for r in rows.select(scalars.clamp(F.col("x"), -1.0, 1.0).alias("c")).collect()] == [None, -1.0, 0.5, 1.0]


def test_a_null_sentiment_is_neutral(spark):
    rows = spark.createDataFrame(
        [("A", 0.6, 0.5, None, None, False, False, None, []), ("B", None, 0.5, 0.1, "RISK_OFF", True, True, "x" * 300, ["a", "b", "c", "d"]), ("C", 0.6, 0.5, -0.9, None, False, True, "t", ["one"])],
        "symbol string, probability double, threshold double, sentiment double, regime string, has_news boolean, has_hits boolean, titles string, tags array<string>",
    )
    a, b, c = scanner.trade_analysis(rows).orderBy("symbol").collect()
    assert a.sentiment_adjustment == 0.0 and a.risk_flags == ["limited_symbol_news"] and a.insufficient_evidence and a.confidence == 0.35
    assert a.rationale_brief == "Signal above threshold; sentiment=mixed/weak; technical=none; news=No recent symbol headlines."
    assert b.adjusted_score is None and b.risk_flags == ["risk_off_regime"]
    assert b.rationale_brief.endswith("technical=a, b, c; news=" + "x" * 120) and len(b.rationale_brief) <= 280
    assert c.sentiment_adjustment == pytest.approx(-0.036) and c.risk_flags == ["negative_sentiment", "limited_symbol_news"] and not c.insufficient_evidence


def test_a_decision_overrides(spark):
    text = '{"conviction_score": 3, "adjustment": -0.5, "risk_flags": ["r"], "rationale": " ' + "y" * 400 + '"}'
    rows = spark.createDataFrame([("A", 0.6, 0.5, 0.0, None, True, True, text), ("B", 0.6, 0.5, 0.0, None, True, True, "[]")], "symbol string, probability double, threshold double, sentiment double, regime string, has_news boolean, has_hits boolean, raw string")
    a, b = scanner.trade_analysis(rows.withColumn("d", scalars.decision(F.col("raw"))), "d").orderBy("symbol").collect()
    assert (a.conviction_score, a.final_adjustment, a.risk_flags, a.rationale_brief) == (1.0, -0.1, ["r"], "y" * 280)
    assert b.conviction_score == pytest.approx(0.15) and b.risk_flags == []


def test_headlines(spark):
    rows = [("A", DAY, 1, "old"), ("A", DAY, 2, " "), ("A", DAY, 3, "tie"), ("A", DAY + datetime.timedelta(1), 0, " new "), ("B", DAY, 1, None)]
    got = {r.symbol: (r.titles, r.articles) for r in scanner.headline_digest(spark.createDataFrame(rows, "symbol string, published_at timestamp, article_id long, title string")).collect()}
    # blank titles take a place among the newest three
    assert got == {"A": ("new | tie", 4), "B": (scanner.NO_NEWS, 1)}
    hits = spark.createDataFrame([("A",), ("A",), ("C",)], "symbol string")
    digest = spark.createDataFrame([("A", "new | tie", 4), ("B", scanner.NO_NEWS, 1)], "symbol string, titles string, articles long")
    assert sorted(map(tuple, scanner.evidence(digest, hits).collect())) == [("A", "new | tie", True, 2, True), ("B", scanner.NO_NEWS, True, 0, False), ("C", scanner.NO_NEWS, False, 1, True)]


def test_refresh_takes_the_stale_or_all(spark):
    fresh = spark.createDataFrame([("A", True), ("B", False)], "symbol string, stale boolean")
    assert [r.symbol for r in scanner.to_refresh(fresh).collect()] == ["A"]
    assert sorted(r.symbol for r in scanner.to_refresh(fresh.withColumn("stale", F.lit(False))).collect()) == ["A", "B"]


def test_first_symbols(spark):
    pool = spark.createDataFrame([("B",), ("A",), ("C",), ("A",)], "symbol string")
    assert [r.symbol for r in scanner.first_symbols(pool, 2).collect()] == ["A", "B"] and scanner.first_symbols(pool, None).count() == 3


def test_last_close_keeps_equal_probes(spark):
    table = calendars.sessions(spark, "2024-01-01", "2024-01-31", ["2024-01-15"], ["2024-01-24"])
    probes = spark.createDataFrame([(1, DAY), (1, DAY), (2, datetime.datetime(2024, 1, 24, 18)), (3, datetime.datetime(2023, 12, 1)), (4, None), (5, datetime.datetime(2024, 2, 14, 12)), (6, datetime.datetime(2024, 2, 20))], "id int, now timestamp")
    got = sorted((r.id, str(r.last_close)) for r in calendars.last_close(probes, table).collect())
    assert got == [(1, "2024-01-01 21:00:00")] * 2 + [(2, "2024-01-24 18:00:00"), (3, "None"), (4, "None"), (5, "2024-01-31 21:00:00"), (6, "None")]


def test_explained_rows_fall_back_to_the_other_score(spark):
    rows = spark.createDataFrame([("A", DAY, 1, None, 0.7), ("B", DAY, 0, 0.2, 0.7)], "symbol string, ts timestamp, signal int, prob_trade_success double, probability_trade_success double")
    a, b = reports.explained(rows.withColumn("probability", F.lit(0.1)), 0.5).orderBy("symbol").collect()
    assert "0.7000 is above" in a.reason and "0.2000 is below" in b.reason


def test_prices_of_a_provider(spark, tmp_path):
    text = spark.createDataFrame([("2024-01-02 00:00:00-05:00", 1.0, 2.0, 0.5, 1.5, 10, 0.0), ("never", None, None, None, None, None, 0.0)], "Date string, Open double, High double, Low double, Close double, Volume long, Dividends double")
    got = ohlcv.as_prices(text, "A").orderBy(F.desc_nulls_last("ts")).collect()
    assert [tuple(r) for r in got] == [("A", datetime.datetime(2024, 1, 2, 5), 1.0, 2.0, 0.5, 1.5, 10), ("A", None, None, None, None, None, None)]
    days = spark.createDataFrame([(datetime.date(2024, 1, d), 1.0, 1.0, 1.0, float(d), 1) for d in (2, 3, 4)], "Date date, Open double, High double, Low double, Close double, Volume long")
    days.write.parquet(f"{tmp_path}/a.parquet")
    days.write.option("header", True).csv(f"{tmp_path}/a.csv")
    for suffix in ("parquet", "csv"):
        assert [r.close for r in ohlcv.read_prices(spark, f"{tmp_path}/a.{suffix}", "A", "2024-01-03", "2024-01-04").collect()] == [3.0]


def test_models_are_stored(spark, tmp_path):
    r = random.Random(1)
    rows = spark.createDataFrame([(f"S{n % 3}", DAY + datetime.timedelta(n), r.random(), r.random(), int(r.random() < 0.5)) for n in range(60)], "symbol string, ts timestamp, a double, b double, trade_success int")
    for name, scaled in (("logistic_regression", True), ("linear_regression", False)):
        model = models.estimator(name, ["b", "a"], scaled=scaled).fit(rows)
        models.save_model(model, ["b", "a"], f"{tmp_path}/{name}")
        again, columns = models.load_model(f"{tmp_path}/{name}")
        assert columns == ["b", "a"]
        score = lambda m: sorted((x.symbol, x.ts, x.prob_trade_success) for x in models.with_probability(m, rows).collect())
        assert score(again) == score(model) and all(0 <= p <= 1 for _, _, p in score(model))
    with pytest.raises(ValueError):
        models.estimator("none", ["a"])
    table = models.prediction_table(again, rows, "trade_success", band=0.5).collect()
    assert {x.signal for x in table} <= {-1, 0, 1} and all((x.predicted_return > 0.5) == (x.signal == 1) for x in table)


def test_an_experiment_without_a_best_row(spark):
    summary = "avg_mae double, avg_directional_accuracy double, avg_strategy_cum_return double, avg_market_return double, avg_strategy_directional_accuracy double, strategy_total_trades long, strategy_total_hits long, avg_win_rate double, avg_profit_factor double, avg_max_drawdown double"
    best = "threshold double, avg_cum_return double, avg_cum_market_return double, avg_profit_factor double, avg_win_rate double, total_trades long"
    one = spark.createDataFrame([(0.123456, 0.5, 1.1, 1.0, 50.0, 10, 5, 0.5, 2.0, -0.1)], summary)
    row = models.experiment_record("random_forest", "pooled", ["A", "B"], one, spark.createDataFrame([], best), 71).collect()[0]
    assert len(row) == 22 and row.mae == 0.1235 and row.symbols == "A,B" and row.strategy_total_hits == 5 and row.best_threshold is None
    assert models.logged(spark.createDataFrame([tuple(row)[:2]], "a string, b string"), DAY).columns[0] == "logged_at"


def test_running_aggregates_by_units(spark):
    from marketloom.functions.windows import running

    r = random.Random(3)
    rows = [(r.choice(["a", None]), DAY + datetime.timedelta(days=n * 3), r.choice([None, 1.0, -2.0, 5.0])) for n in range(80)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp, x double")
    for keys in ([], ["k"]):
        got = running(frame, keys, {"total": (F.sum, F.col("x")), "most": (F.max, F.col("x")), "last": (F.last, F.col("x"))})
        assert got.columns == ["k", "ts", "x", "total", "most", "last"]
        seen = {}
        for row in sorted(got.collect(), key=lambda row: row.ts):
            own = seen.setdefault(row.k if keys else None, [])
            own += [] if row.x is None else [row.x]
            assert (row.total, row.most, row.last) == ((sum(own), max(own), own[-1]) if own else (None, None, None))


def test_market_override(spark):
    bars = spark.createDataFrame([(1, "A", DAY + datetime.timedelta(n), 100.0 + n, 101.0 + n, 99.0 + n, 0.9 if n == 1 else 0.1) for n in range(20)], "split int, symbol string, ts timestamp, close double, high double, low double, prob_trade_success double")
    own = backtest.backtest(backtest.with_threshold(bars, [0.5]), "threshold", ["split", "threshold"]).collect()[0]
    assert own.cum_market_return == pytest.approx(1.19)
    market = spark.createDataFrame([(1, 3.0)], "split int, cum_market_return double")
    other = backtest.backtest(backtest.with_threshold(bars, [0.5]), "threshold", ["split", "threshold"], market=market).collect()[0]
    assert other.cum_market_return == 3.0 and other.cum_return == own.cum_return


def test_rows_are_explained_alike_whatever_the_order_of_their_lines(spark):
    discounts = [n / 100 for n in (10, 6, 8, 3, 10, 8, 7, 3, 8, 10, 0, 6, 10, 9, 5, 10)]  # ten times their mean: 0.70625
    rows = [(s, i, 100.0, 1.0, d) for s, own in (("A", discounts), ("B", discounts[::-1])) for i, d in enumerate(own)]
    lines = spark.createDataFrame(rows, "symbol string, line int, price double, l_quantity double, l_discount double").coalesce(1)
    bars = tables.as_bars(lines, "symbol").withColumns({"ts": F.lit(0).cast("timestamp"), "signal": F.lit(0)})
    reasons = {r.reason for r in reports.explained(bars, 0.8).collect()}
    assert reasons == {"Signal omitted: model score 0.7063 is below/equal threshold 0.8000 (margin -0.0937)."}
