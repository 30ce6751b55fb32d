"""Similarity in blocks, series tables, news windows over stretches of time, and the scanner's latest rows."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marketloom.operators import dataset, sentiment, vectors
from marketloom.sources.series import SeriesTable, joined

DAY = dt.datetime(2024, 1, 1)


def cosine(a, b):
    dot, x, y = sum(i * j for i, j in zip(a, b, strict=True)), sum(i * i for i in a), sum(j * j for j in b)
    return dot / math.sqrt(x) / math.sqrt(y) if x and y else None


@pytest.mark.parametrize("sizes", [(4096, 1024), (7, 3), (1, 1)])
def test_similarity_in_blocks(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "POINTS", sizes[0])
    monkeypatch.setattr(vectors, "QUERIES", sizes[1])
    r = random.Random(14)
    n = 60 if sizes[0] > 1 else 14
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b"]), i, [r.gauss(0, 1) for _ in range(5)]) for i in range(n)]
    rows += [("hot", n + i, rows[0][2]) for i in range(6)]  # ties
    rows += [("a", n + 10, [0.0] * 5), ("a", n + 11, [1.0, 2.0]), ("a", n + 12, None), (None, n + 13, [1.0] * 5), ("only", n + 14, [1.0] * 5)]
    points = spark.createDataFrame(rows, "symbol string, point_id long, vector array<double>").withColumn("p", F.lit(1)).repartition(3)
    queries = points.where("point_id % 3 = 0").select("symbol", F.col("point_id").alias("query_id"), F.col("vector").alias("query"))
    want = {}
    for s, i, q in rows:
        if i % 3 == 0 and s and q:
            scores = [(-cosine(q, v), j) for t, j, v in rows if t == s and v and len(v) == len(q) and cosine(q, v) is not None]
            want[i] = [j for _, j in sorted((round(a, 12), j) for a, j in scores)[:5]]
    got = {}
    for x in sorted(vectors.most_similar(queries, points).collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append(x.point_id)
    assert got == {k: v for k, v in want.items() if v}
    assert vectors.most_similar(queries.limit(0), points).collect() == []


def test_stored_series_meet_without_a_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(f"S{i % 3}", DAY + dt.timedelta(days=i // 3), float(i), float(i), float(i), float(i), i) for i in range(60)], "symbol string, ts timestamp, open double, high double, low double, close double, volume long")
    prices, features = (SeriesTable(spark, f"{n}_{tmp_path.name.replace('-', '_')}", f"{tmp_path}/{n}", 4) for n in ("p", "f"))
    prices.save(rows)
    features.save(rows.where("volume % 2 = 0").withColumn("f", F.col("close") * 2))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = joined(prices, features, [" s1", "S2 ", "S2", ""], "2024-01-10")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert re.search(r"PushedFilters: \[.*In\(symbol, \[S1,S2\]\)", plan) and "LessThanOrEqual(ts," in plan
        assert sorted((x.symbol, x.volume, x.f) for x in found.collect()) == sorted((f"S{i % 3}", i, 2.0 * i) for i in range(0, 30, 2) if i % 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert joined(prices, features, rows.select(F.lower("symbol").alias("symbol"))).count() == 30 and joined(prices, features).count() == 30
    prices.save(rows.limit(0))
    assert joined(prices, features).count() == 0


def test_news_windows_over_stretches(spark):
    """Stretches of four days against every article of a symbol."""
    r = random.Random(15)
    at = lambda: DAY + dt.timedelta(seconds=r.randrange(40 * 86400))
    news = [(r.choice(["A", "SPY"]), at(), r.choice([None, r.uniform(-1, 1)])) for _ in range(400)]
    # at the very edges of stretches and windows
    edge = dt.datetime(1970, 1, 1) + dt.timedelta(days=4 * 4932)
    news += [("A", edge - dt.timedelta(days=3) + dt.timedelta(microseconds=n), 0.5) for n in (-1, 0, 1)] + [("A", edge, 1.0)]
    bars = [(s, t) for s in ("A", "SPY", "none") for t in [at() for _ in range(40)] + [edge, edge + dt.timedelta(microseconds=1), edge - dt.timedelta(microseconds=1)]]
    frame = spark.createDataFrame(bars, "symbol string, ts timestamp")
    articles = spark.createDataFrame(news, "symbol string, published_at timestamp, finbert_scalar double")
    whole, sentiment.STRETCH = sentiment.STRETCH, 4 * sentiment.DAY
    try:
        got = sentiment.as_of_sentiment(frame, articles).collect()
    finally:
        sentiment.STRETCH = whole
    assert len(got) == len(bars)
    for x in got:
        scores = lambda span, x=x: [s or 0.0 for sym, t, s in news if sym == x.symbol and x.ts - span < t <= x.ts]
        h1, h24, d3 = (scores(dt.timedelta(hours=h)) for h in (1, 24, 72))
        mean = lambda v: sum(v) / len(v) if v else 0.0
        assert x.sentiment_1h == pytest.approx(mean(h1)) and x.sentiment_24h == pytest.approx(mean(h24)) and x.sentiment_3d == pytest.approx(mean(d3)) and x.news_volume == len(h24)
        sd = math.sqrt(sum((v - mean(d3)) ** 2 for v in d3) / (len(d3) - 1)) if len(d3) > 1 else 0.0
        assert x.sentiment_volatility == pytest.approx(sd, abs=1e-9)


def test_sentiment_sources_in_turn(spark):
    """Articles, then the daily table, then the cache, then zeros."""
    bars = spark.createDataFrame([("A", DAY + dt.timedelta(hours=20))], "symbol string, ts timestamp")
    articles = spark.createDataFrame([("A", DAY + dt.timedelta(hours=19, minutes=30), 0.5)], "symbol string, published_at timestamp, finbert_scalar double")
    gold = spark.createDataFrame([("A", DAY.date(), 0.25, 1)], "symbol string, as_of_date date, sentiment_24h double, row_seq int")
    cache = spark.createDataFrame([("A", DAY, 0.125, 1)], "symbol string, ts timestamp, sentiment_24h double, row_seq int")
    score = lambda **sources: sentiment.attach_sentiment(bars, **sources).collect()[0].sentiment_24h
    assert score(articles=articles, gold=gold, cache=cache) == 0.5
    assert score(articles=articles.limit(0), gold=gold, cache=cache) == 0.25
    assert score(gold=gold.limit(0), cache=cache) == 0.125 and score() == 0.0


def test_latest_rows_are_cut_first(spark):
    from marketloom.schemas import CONTEXT, VALUES, z

    n = {"A": 3, "B": 2, "gone": 1}
    rows = [(s, DAY + dt.timedelta(days=i), float(i)) for s, k in n.items() for i in range(k)]
    base = spark.createDataFrame(rows, "symbol string, ts timestamp, v double")
    features = base.select("symbol", "ts", *(F.col("v").alias(c) for c in VALUES))
    scores = base.where("symbol <> 'gone' and not (symbol = 'B' and v = 1)").select("symbol", "ts", *(F.col("v").alias(c) for c in z(VALUES)))
    index = lambda name: spark.range(60).select(F.lit(name).alias("symbol"), (F.lit(DAY) - F.make_dt_interval(F.lit(57) - F.col("id").cast("int"))).alias("ts"), *(F.lit(1.0).alias(c) for c in z(VALUES)))
    found, stages = dataset.latest_rows(features, scores, index("SPY"), index("QQQ"), index("^VIX"), symbols=spark.createDataFrame([(" a",), ("B",), ("GONE",)], "symbol string"))
    kept = found.collect()
    assert [(x.symbol, x.ts, x.close, x.close_z) for x in kept] == [("A", DAY + dt.timedelta(days=2), 2.0, 2.0)] and set(CONTEXT) < set(found.columns)
    last = {x.symbol: (x.latest_features, x.latest_scores, x.latest_context, x.latest_merged) for x in stages.collect()}
    two, one = DAY + dt.timedelta(days=2), DAY + dt.timedelta(days=1)
    assert last == {"A": (two, two, two, two), "B": (one, DAY, DAY, None)}


@pytest.mark.parametrize("few", [200_000, 0])
def test_as_of_in_one_window_or_by_units(spark, monkeypatch, few):
    from marketloom.operators import context

    monkeypatch.setattr(context, "BROADCAST_ROWS", few)
    r = random.Random(17)
    at = lambda: DAY + dt.timedelta(hours=r.randrange(3000))
    rows = [(k, at(), r.choice([None, float(n)])) for n, k in enumerate(r.choices("ab", k=60))]
    rows = list({(k, t): (k, t, v) for k, t, v in rows}.values())
    probes = [(r.choice("abc"), at()) for _ in range(80)] + [rows[0][:2], rows[0][:2]]
    got = context.as_of(spark.createDataFrame(probes, "k string, ts timestamp"), spark.createDataFrame(rows, "k string, ts timestamp, v double"), ["k"])
    want = {}
    for k, t in probes:
        before = [(u, v) for j, u, v in rows if j == k and u <= t]
        want[k, t] = max(before)[1] if before else None
    assert {(x.k, x.ts): x.v for x in got.collect()} == want and got.count() == len(want)


def test_no_window_takes_articles_out_again(spark):
    """A time frame that slides costs all of a window's articles for each article."""
    times = [DAY + dt.timedelta(minutes=7 * i) for i in range(700)]
    articles = spark.createDataFrame([("A", t, 0.3) for t in times] + [("SPY", DAY, None)], "symbol string, published_at timestamp, finbert_scalar double")
    now = DAY + dt.timedelta(days=3, seconds=61)
    bars = spark.createDataFrame([("A", now), ("A", DAY)], "symbol string, ts timestamp")
    found = sentiment.as_of_sentiment(bars, articles)
    for frame in (found, sentiment.daily_rollup(bars.select("symbol", F.to_date("ts").alias("as_of_date")), articles)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition" in plan and "specifiedwindowframe(RangeFrame, -" not in plan
    early, late = found.orderBy("ts").collect()
    assert early.news_volume == 1.0 and late.news_volume == sum(now - dt.timedelta(days=1) < t <= now for t in times)
    assert late.sym_news_volume_d1 == 0.0 and late.sentiment_3d == pytest.approx(0.3) and late.sentiment_volatility == pytest.approx(0.0, abs=1e-12)


def test_sentiment_from_articles_takes_none_out_again(spark):
    articles = spark.createDataFrame([("A", DAY + dt.timedelta(hours=i), 0.25) for i in range(30)], "symbol string, published_at timestamp, finbert_scalar double")
    bars = spark.createDataFrame([("A", DAY + dt.timedelta(hours=29)), ("B", DAY)], "symbol string, ts timestamp")
    found = sentiment.attach_sentiment(bars, articles, None, None).groupBy("symbol").agg(F.sum("news_volume").alias("news"), F.sum("sentiment_24h").alias("score"))
    assert "specifiedwindowframe(RangeFrame, -" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("A", 24.0, 0.25), ("B", 0.0, 0.0)}
