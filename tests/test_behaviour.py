"""Behaviour of single operators on small hand-made tables."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import calendars, scalars
from marketloom.operators import backtest, context, labels, prices, scanner, sentiment, thresholds, vectors
from marketloom.operators.features import compute_features, row_z_scores
from marketloom.schemas import FEATURES, MODEL_VECTOR, VALUES
from marketloom.sources import artifacts, news, tables, universe
from marketloom.streaming import ingest

UTC = dt.UTC


def bars(spark, series, symbol="A"):
    series = [tuple(map(float, x)) for x in series]
    rows = [(symbol, dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(days=i), c, h, lo, c, 100, p) for i, (c, h, lo, p) in enumerate(series)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume long, prob_trade_success double")


def walk(series, threshold, hold=15):
    """The rule, bar by bar."""
    out, at, price, deadline = [], None, 0.0, -1
    last = len(series) - 1
    middle = lambda i: (series[i][1] + series[i][2]) / 2
    for t, (close, high, low, p) in enumerate(series):
        if at is not None:
            if t > deadline:
                out.append((at, deadline, middle(deadline) / price - 1))
                at = None
            elif high >= price * 1.08:
                out.append((at, t, 0.08))
                at = None
            elif low <= price * 0.96:
                out.append((at, t, -0.04))
                at = None
            elif p > threshold:
                deadline = min(t + hold, last)
        if at is None and p > threshold:
            at, price, deadline = t, close, min(t + hold, last)
    return out + ([(at, deadline, middle(deadline) / price - 1)] if at is not None else [])


def test_trades_follow_the_rule(spark):
    r = random.Random(1)
    frame, want = None, {}
    for n in range(12):
        price, series = 100.0, []
        for _ in range(r.randint(1, 120)):
            price *= 1 + r.uniform(-0.03, 0.03)
            series.append((price, price * (1 + r.uniform(0, 0.02)), price * (1 - r.uniform(0, 0.02)), r.random()))
        one = bars(spark, series, f"S{n}")
        frame = one if frame is None else frame.unionByName(one)
        want[f"S{n}"] = walk(series, 0.8)
    got = backtest.trades(backtest.numbered(frame, ["symbol"]), ["symbol"], F.lit(0.8)).collect()
    for symbol, own in want.items():
        mine = sorted((x.entry_i, x.exit_i, round(x.trade_return, 9)) for x in got if x.symbol == symbol)
        assert mine == sorted((a, b, round(c, 9)) for a, b, c in own)


def test_a_trade_ends_at_the_middle_of_its_deadline(spark):
    series = [(100.0, 101.0, 99.0, 0.9)] + [(100.0, 102.0, 99.0, 0.0)] * 20
    got = backtest.trades(backtest.numbered(bars(spark, series), ["symbol"]), ["symbol"], F.lit(0.5)).collect()
    assert [(x.entry_i, x.exit_i, round(x.trade_return, 6)) for x in got] == [(0, 15, 0.005)]


def test_features_match_pandas(spark):
    r = np.random.default_rng(2)
    close = 100 * np.cumprod(1 + r.normal(0, 0.01, 260))
    frame = bars(spark, [(c, c * 1.01, c * 0.99, 0.5) for c in close])
    got = compute_features(frame).orderBy("ts").toPandas()
    s = pd.Series(close)
    assert list(got.columns) == ["symbol", "ts", *VALUES] and len(FEATURES) == 45 and len(MODEL_VECTOR) == 71
    pd.testing.assert_series_equal(got["sma_200"], s.rolling(200).mean(), check_names=False)
    for span in (10, 20, 50, 100, 200):
        pd.testing.assert_series_equal(got[f"ema_{span}"], s.ewm(span=span).mean(), check_names=False)
    macd = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    macd[:25] = np.nan
    pd.testing.assert_series_equal(got["macd"], macd, check_names=False)
    signal = macd.ewm(span=9, adjust=False, min_periods=9).mean()
    pd.testing.assert_series_equal(got["macd_signal"], signal, check_names=False)
    pd.testing.assert_series_equal(got["volatility_20"], s.pct_change().rolling(20).std(), check_names=False)
    step = s.diff().fillna(0)
    up, down = (x.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (step, -step))
    pd.testing.assert_series_equal(got["rsi_14"], 100 - 100 / (1 + up / down), check_names=False)


def test_smoothing_does_not_depend_on_batches(spark):
    series = [(100 + i % 7, 102.0 + i % 7, 98.0, 0.5) for i in range(90)]
    whole = compute_features(bars(spark, series)).orderBy("ts").toPandas()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = compute_features(bars(spark, series)).orderBy("ts").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    pd.testing.assert_frame_equal(whole, cut)


def test_row_scores(spark):
    rows = spark.createDataFrame([(5.0, 5.0, 5.0), (1.0, 2.0, 3.0), (0.0, None, 10.0)], "a double, b double, c double")
    got = [tuple(None if v is None else round(v, 6) for v in x[3:]) for x in row_z_scores(rows, ["a", "b", "c"]).collect()]
    assert got == [(0, 0, 0), (-1.224745, 0, 1.224745), (-1, None, 1)]


def test_labels(spark):
    series = [(100.0, 100.5, 99.0, 0), (101.0, 110.0, 100.0, 0), (102.0, 103.0, 101.0, 0), (103.0, 104.0, 90.0, 0)]
    assert [r.trade_success for r in labels.trade_labels(bars(spark, series), keep_open=True).orderBy("ts").collect()] == [1, 0, 0, None]
    flat = [(100.0, 101.0, 99.0, 0)] * 20
    assert [r.trade_success for r in labels.trade_labels(bars(spark, flat)).collect()] == [0] * 5


def test_walk_forward_embargo(spark):
    frame = bars(spark, [(1.0, 1.0, 1.0, 0)] * 20)
    got = labels.walk_forward(frame, 10, 5, 5, embargo=2).groupBy("split", "part").count().collect()
    assert {(r.split, r.part): r["count"] for r in got} == {(0, "train"): 10, (0, "test"): 3, (1, "train"): 10, (1, "test"): 3}


def test_walk_forward_logistic_tests_every_instant_once(spark, monkeypatch):
    from marketloom.plans import models as plans

    days = [dt.datetime(2000, 1, 1, tzinfo=UTC) + dt.timedelta(days=i) for i in range(2260)]
    frame = spark.createDataFrame([("A", d, *[1.0] * 4, 0, *[0.5] * len(plans.INPUTS)) for d in days], ["symbol", "ts", "open", "high", "low", "close", "trade_success", *plans.INPUTS])
    monkeypatch.setattr(plans.tables, "bars_daily", lambda spark, sf_dir: frame)
    for step in ("numeric", "window_features", "trade_labels"):
        monkeypatch.setattr(plans, step, lambda rows: rows)
    tested = plans._splits(spark, "").where("part = 'test'").groupBy("ts").count().collect()
    assert len(tested) == 750 and {r["count"] for r in tested} == {1}


def test_combined_news_keeps_documents_of_any_id(spark, monkeypatch):
    from marketloom.plans import news as plans

    ids = [0, 1, 99_515, 99_516, 250_000, 300_000_000]
    frame = spark.createDataFrame([(i, "src1", f"text {i}") for i in ids], "doc_id long, source string, text string")
    monkeypatch.setattr(plans.tables, "table", lambda spark, sf_dir, name: frame)
    got = plans.combined(spark, "").collect()
    assert sum(r["items"] for r in got if r.file_seq == 0) == len(ids) and sum(r["row_sum"] for r in got if r.file_seq == 0) == sum(ids)


def test_news_after_a_bar_is_not_seen(spark):
    t = dt.datetime(2024, 5, 1, 15, tzinfo=UTC)
    one = spark.createDataFrame([("A", t)], "symbol string, ts timestamp")
    news_rows = [("A", t, 0.5), ("A", t + dt.timedelta(microseconds=1), 1.0), ("A", t - dt.timedelta(hours=1), 0.9), ("SPY", t - dt.timedelta(hours=2), -0.5), ("A", t - dt.timedelta(hours=30), None)]
    articles = spark.createDataFrame(news_rows, "symbol string, published_at timestamp, finbert_scalar double")
    r = sentiment.as_of_sentiment(one, articles).first()
    assert (r.sentiment_1h, r.sentiment_24h, r.news_volume, r.spy_sentiment_d1) == (0.5, 0.7, 2.0, -0.5)
    assert round(r.sentiment_3d, 6) == round(1.4 / 3, 6) and r.sym_news_volume_d1 == 2.0
    calm = sentiment.attach_sentiment(one, articles.limit(0)).first()
    assert calm.sentiment_24h == 0.0 and calm.spy_sentiment_d1 == 0.0


def test_as_of_takes_equal_instants(spark):
    t = [dt.datetime(2024, 1, d, tzinfo=UTC) for d in range(1, 6)]
    probes = spark.createDataFrame([(x,) for x in t], "ts timestamp")
    vix = spark.createDataFrame([(t[1], 1.0), (t[3], 2.0)], "ts timestamp, v double")
    assert [r.v for r in context.as_of(probes, vix).orderBy("ts").collect()] == [None, 1.0, 1.0, 2.0, 2.0]


def test_cleaning(spark):
    t = dt.datetime(2024, 1, 2, tzinfo=UTC)
    rows = [("A", t, 1, 1.0, 1.0, 1.0, 1.0, 5), ("A", t, 2, 1.0, 1.0, 1.0, None, 5), ("B", t, 1, 1.0, 1.0, 1.0, 1.0, 0), ("^VIX", t, 1, 1.0, 1.0, 1.0, 1.0, None), ("C", t, 1, 1.0, 2.0, 0.5, 1.0, 9)]
    raw = spark.createDataFrame(rows, "symbol string, ts timestamp, row_seq int, open double, high double, low double, close double, volume long")
    assert sorted(r.symbol for r in prices.clean_prices(raw).collect()) == ["C", "^VIX"]


def test_threshold_choice(spark):
    rows = [(0.1, 1.2, -0.2, 50, 1.5), (0.2, 1.3, -0.5, 50, 0.8), (0.3, 1.9, -0.1, 2, 3.0)]
    grid = spark.createDataFrame(rows, "threshold double, avg_cum_return double, avg_max_drawdown double, total_trades int, avg_profit_factor double")
    grid = grid.withColumns({"median_cum_return": F.lit(1.0), "min_cum_return": F.lit(1.0)}).withColumn("selection_score", thresholds.selection_score("calmar_proxy"))
    floor = spark.createDataFrame([(100, 5)], "trading_days int, min_trades int")
    best = lambda **limits: thresholds.best_single(thresholds.eligible(grid, floor, **limits)).first().threshold
    assert best() == 0.1 and best(least_factor=1.0) == 0.1 and best(least_factor=9.0) == 0.1
    joint = thresholds.best_joint(grid, ["avg_cum_return", "avg_max_drawdown"]).first()
    assert (joint.threshold, joint.k) == (0.3, 3)
    with pytest.raises(ValueError, match="unknown objective"):
        thresholds.selection_score("best")


def test_payload(spark):
    import json

    rows = spark.createDataFrame([("A", None, dt.datetime(2024, 1, 2, 3, 4, 5), 'say "é"\n')], "a string, b string, ts timestamp, `odd.name` string")
    got = json.loads(rows.select(news.payload(rows, "k", "u", "p", "s")).first()[0])
    assert got == {"dataset_key": "k", "dataset_source_url": "u", "dataset_path": "p", "dataset_sha256": "s", "row": {"a": "A", "b": None, "ts": "2024-01-02T03:04:05.000", "odd.name": 'say "é"\n'}}
    assert rows.where("false").select(news.payload(rows, "k", "u", "p", "s")).count() == 0


def test_news_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ticker,published_at,headline,summary,text,url\nAAPL,2024-03-01T10:00:05Z,Up,nan,Body,http://x\nMSFT,2024-03-01,No,,,\nAAPL,bad,No,,,\n")
    (tmp_path / "b.csv").write_text("Title,Date\nUP,2024-03-01 10:00:40\nOther,2024-03-02\n")
    wanted = spark.createDataFrame([("aapl",)], "symbol string")
    first = news.mapped(news.read_file(spark, f"{tmp_path}/a.csv"), news.MAPPINGS["ticker_news"], wanted, "2024-01-01", "2024-12-31")
    second = news.mapped(news.read_file(spark, f"{tmp_path}/b.csv"), news.MAPPINGS["market_headlines"], wanted, "2024-01-01", "2024-12-31")
    row = first.first()
    assert (first.count(), row.symbol, row.summary, row.text_for_score) == (1, "AAPL", "Body", "Up Body")
    assert news.combined([first, second]).count() == 3
    assert news.combined([first.withColumn("url", F.lit(None).cast("string")), second]).count() == 2


def test_filings_articles_and_ids(spark):
    rows = spark.createDataFrame([("aapl", "0000320193", (["8-K", "4"], ["2024-02-01", "2024-02-02"], ["0001-24-1", "x"], ["a.htm", "b.htm"]))], "symbol string, cik string, recent struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>>")
    r = news.filings(rows, "2024-01-01", "2024-12-31").collect()
    assert [(x.title, x.url) for x in r] == [("AAPL SEC 8-K filing", "https://www.sec.gov/Archives/edgar/data/320193/0001241/a.htm")]
    ids = spark.createDataFrame([('{"0": {"ticker": "aapl", "cik_str": 320193}}',)], "value string")
    assert tuple(news.company_ids(ids).first()) == ("AAPL", "0000320193")
    lists = spark.createDataFrame([("AAPL", [("AAPL earnings rise", "2026-03-27T12:34:56Z", "u1"), ("AAPL", "2026-03-27T12:34:56Z", "u2"), ("AAPL stock", None, "u3")])], "symbol string, articles array<struct<title:string,seendate:string,url:string>>")
    assert [x.url for x in news.article_list(lists).collect()] == ["u1"]
    nested = spark.createDataFrame([("A", 1, ("T", "S", "2024-01-01T00:00:00Z", ("u",))), ("A", 2, ("T", "S", None, ("v",)))], "symbol string, row_seq long, content struct<title:string,summary:string,pubDate:string,canonicalUrl:struct<url:string>>")
    assert [x.text_for_score for x in news.ticker_news(nested).collect()] == ["T. S"]


def test_universe_files_and_pages(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\n brk.b \n\nAAPL\naapl\n")
    assert sorted(r.symbol for r in universe.read_symbols(spark, f"{tmp_path}/list.txt").collect()) == ["AAPL", "BRK-B"]
    page = "<table>" + "".join(f"<tr><td><a>T{i}</a>[1]</td><td>x</td></tr>" for i in range(401)) + "</table>"
    pages = spark.createDataFrame([(page,)], "html string")
    assert universe.constituents(pages).count() == 401
    with pytest.raises(ValueError, match="constituents"):
        universe.constituents(pages, least=500)
    assert {r.symbol for r in universe.resolve(universe.read_symbols(spark, f"{tmp_path}/list.txt")).collect()} >= {"QQQ", "SPY", "^VIX"}


def test_session_calendar(spark):
    table = calendars.sessions(spark, "2026-06-20", "2026-12-01", ["2026-07-03", "2026-11-26"], ["2026-11-27"])
    now = [(dt.datetime(2026, 7, 3, 22, tzinfo=UTC),), (dt.datetime(2026, 11, 27, 20, tzinfo=UTC),)]
    got = calendars.last_close(spark.createDataFrame(now, "now timestamp"), table).orderBy("now").select(F.date_format("last_close", "yyyy-MM-dd HH")).collect()
    assert [r[0] for r in got] == ["2026-07-02 20", "2026-11-27 18"]


def test_decisions(spark):
    good = '{"conviction_score": 3, "adjustment": -1, "risk_flags": ["x"], "rationale": " r "}'
    rows = [(good,), ('{"conviction_score": 1}',), ("no json",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "raw string").select(scalars.decision(F.col("raw"))).collect()]
    assert (got[0].conviction_score, got[0].adjustment, got[0].risk_flags, got[0].rationale) == (1.0, -0.1, ["x"], "r") and got[1:] == [None] * 3


def test_ranking_breaks_ties_by_name(spark):
    rows = spark.createDataFrame([("AAPL", 0.8), ("MSFT", 0.3), ("NVDA", 0.9), ("ABT", 0.8)], "symbol string, probability double")
    assert [r.symbol for r in scanner.ranked(rows, 3).collect()] == ["NVDA", "AAPL", "ABT"]


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([(0, "A", 1, 0.5), (1, "B", 2, 0.7)], "split int, symbol string, ts int, p double")
    artifacts.save_splits(rows, f"{tmp_path}/rows")
    assert artifacts.splits(spark, f"{tmp_path}/rows") == [0, 1] and artifacts.load_split(spark, f"{tmp_path}/rows", 1).first().symbol == "B"
    assert artifacts.best_threshold(spark, f"{tmp_path}/none") == 0.33
    artifacts.save_grid(spark.createDataFrame([(0.4,)], "threshold double"), f"{tmp_path}/best")
    assert artifacts.best_threshold(spark, f"{tmp_path}/best") == 0.4


def test_stream_drops_copies(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, tzinfo=UTC)
    items = spark.createDataFrame([("a", t, "A", 0.5), ("a", t + dt.timedelta(hours=1), "A", 0.5), ("b", t, "B", 1.0)], "content_sha256 string, published_at timestamp, symbol string, score double")
    items.write.parquet(f"{tmp_path}/in")
    stream = ingest.without_copies(ingest.files(spark, f"{tmp_path}/in", items.schema, 1))
    ingest.start(stream, f"{tmp_path}/offsets", lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/out")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_scoring_and_points(spark):
    def make():
        return lambda texts: np.array([float(len(t)) for t in texts])

    rows = spark.createDataFrame([(1, "A", "abc"), (2, "A", " "), (3, "A", None), (4, "B", "x" * 501)], "article_id long, symbol string, text string")
    got = {r.article_id: r.score for r in vectors.score_texts(rows, make, "text").collect()}
    assert got == {1: 3.0, 2: None, 3: None, 4: 501.0}
    assert sorted(r.point_id for r in vectors.chunk_points(rows).collect()) == [10000, 40000, 40001]


def test_a_probability_half_way_between_two_is_rounded_up_in_any_order(spark):
    discounts = [n / 100 for n in (10, 6, 8, 3, 10, 8, 7, 3, 8, 10, 0, 6, 10, 9, 5, 10)]  # 1.13 over 16 rows: 0.70625
    orders = [discounts, discounts[::-1], sorted(discounts)]
    rows = [(f"o{n}", i, 100.0 + i, 1.0, d) for n, o in enumerate(orders) for i, d in enumerate(o)]
    frame = spark.createDataFrame(rows, "symbol string, line int, price double, l_quantity double, l_discount double").coalesce(1)
    assert {r.symbol: r.prob_trade_success for r in tables.as_bars(frame, "symbol").collect()} == {"o0": 0.7063, "o1": 0.7063, "o2": 0.7063}
    # what is no decimal under 100 is added as it is
    odd = spark.createDataFrame([("a", None), ("b", float("nan")), ("c", 1e9), ("c", 1.0), ("d", 0.05), ("d", None)], "symbol string, l_discount double")
    got = {r.symbol: r.p for r in odd.groupBy("symbol").agg(tables.tenfold_mean("l_discount").alias("p")).collect()}
    assert got["a"] is None and got["b"] != got["b"] and got["c"] == 5000000005.0 and got["d"] == 0.5


def test_equal_thresholds_tie_whatever_the_last_place_of_their_sums(spark):
    """Several thresholds below all probabilities: the same trades, sums of doubles in another order."""
    noise = [2.5323613468592874, 2.5323613468592914, 2.5323613468592914, 1.5]
    rows = [(0.05 * (n + 1), x, x + 1e-15 * n, x, x, x, x, 0.64 - 1e-16 * n, 60) for n, x in enumerate(noise)]
    pool = spark.createDataFrame(rows, ["threshold", "selection_score", *thresholds.METRICS, "total_trades"])
    assert thresholds.best_single(pool).first().threshold == 0.05
    best = thresholds.best_joint(pool, thresholds.METRICS[:5]).first()
    assert best.threshold == 0.05 and best.max_rank == 1 and best.mean_rank == 1.0
    # differences that are no noise still count, missing and infinite scores keep their places
    other = spark.createDataFrame([(0.1, 1e-7), (0.2, 1.01e-7), (0.3, None), (0.4, 0.0)], "threshold double, selection_score double")
    assert thresholds.best_single(other).first().threshold == 0.2
    assert thresholds.best_single(other.where("threshold = 0.3 or threshold = 0.4")).first().threshold == 0.4
    assert thresholds.best_single(other.withColumn("selection_score", F.lit(float("inf")))).first().threshold == 0.1
