"""Queries of sources, sinks, upserts and model functions with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions import scalars
from marketloom.operators import backtest as trading
from marketloom.operators import prices, reports, sentiment, vectors
from marketloom.operators.features import compute_features, refill
from marketloom.plans import sql
from marketloom.plans.backtest import _FLAGS
from marketloom.plans.features import DAY, day, rounded
from marketloom.schemas import VALUES
from marketloom.session import shared_folder
from marketloom.sources import artifacts, keyed, news, tables, universe
from marketloom.streaming import ingest, items


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def symbol_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = tables.bars_daily(spark, sf_dir).select(F.concat(F.lit(" "), F.lower("symbol")).alias("symbol"))
    extra = tables.table(spark, sf_dir, "region").select(F.explode(F.array(F.lit("# note"), F.lit(""), F.lit(" brk.b "))).alias("symbol"))
    path = f"{_folder(spark)}/symbols"
    universe.write_symbols(symbols.unionByName(extra), path)
    return universe.read_symbols(spark, path)


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 100000 * 60)
    return tables.table(spark, sf_dir, "documents").select(F.upper("source").alias("symbol"), "doc_id", number.alias("number"), at.alias("at"))


def ticker_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _news(spark, sf_dir).select("symbol", F.col("doc_id").alias("row_seq"), F.struct(
        F.concat(F.lit(" Title "), "number").alias("title"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("S "), "number")).alias("summary"),
        F.when(F.col("doc_id") % 5 != 0, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("pubDate"),
        F.struct(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://ex/"), "number")).alias("url")).alias("canonicalUrl"),
    ).alias("content"))
    return news.ticker_news(rows).select("row_seq", "external_id", "content_sha256", scalars.iso(F.col("published_at")).alias("published_at"), "text_for_score", "url")


def article_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    article = lambda title, n: F.struct(title.alias("title"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("seendate"), F.concat(F.lit("u"), "number", F.lit(n)).alias("url"))
    named = F.concat("symbol", F.when(F.col("doc_id") % 2 == 0, F.lit(" stock ")).otherwise(F.lit(" ")), "number")
    rows = _news(spark, sf_dir).select("symbol", F.array(article(named, "a"), article(F.lit("other stock"), "b"), article(F.concat(named, F.lit("!")), "a")).alias("articles"))
    return news.article_list(rows).select("symbol", "external_id", "content_sha256", "title", "row_seq")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _news(spark, sf_dir).select(F.concat(F.lit('{"0": {"ticker": "'), F.lower("symbol"), F.lit('", "cik_str": 32'), F.substring("symbol", -1, 1), F.lit("}}")).alias("value")).distinct()
    recent = F.struct(
        F.array(F.lit("8-K"), F.lit("4"), F.lit(" 10-Q ")).alias("form"), F.array(F.date_format("at", "yyyy-MM-dd"), F.lit("2024-01-05"), F.lit("never")).alias("filingDate"),
        F.array(F.concat(F.lit("00-"), "number"), F.lit("1"), F.lit("2")).alias("accessionNumber"), F.array(F.lit("a.htm"), F.lit("b"), F.lit("c")).alias("primaryDocument"),
    )
    rows = _news(spark, sf_dir).withColumn("recent", recent).join(news.company_ids(ids), "symbol").select("symbol", "cik", "recent")
    return news.filings(rows, "2024-01-01", "2030-12-31").select("symbol", "external_id", "url", "title", "content_sha256")


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _news(spark, sf_dir).select(F.lit("file").alias("source"), F.floor(F.col("doc_id") / 3).cast("string").alias("external_id"), F.col("doc_id").alias("row_seq"), "symbol")
    return news.bronze(rows.where("row_seq % 2 = 0"), rows.where("row_seq % 2 = 1")).groupBy("symbol").agg(F.count("*").alias("items"), F.sum("row_seq").alias("row_sum"))


def gap_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = tables.articles(spark, sf_dir)
    newest = articles.where("symbol <> 'U3' and published_at < '2024-01-20'").groupBy("symbol").agg(F.max("published_at").alias("newest"))
    latest = articles.select("symbol").distinct().join(newest, "symbol", "left")
    return news.gap_start(latest, F.lit("2024-02-10").cast("date"), 25).select("symbol", F.date_format("start", "yyyy-MM-dd").alias("start"))


def incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.incomplete(compute_features(tables.bars_daily(spark, sf_dir))).groupBy("symbol").agg(F.count("*").alias("rows"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.watermarks(tables.articles(spark, sf_dir), "published_at").select("symbol", F.date_format("watermark", "yyyy-MM-dd HH:mm:ss").alias("watermark"))


def daily_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows by year: those of some days arrive anew and rewrite their years alone; then one symbol's rows go."""
    rows = tables.bars_daily(spark, sf_dir).select("symbol", "ts", F.year("ts").alias("year"), "volume", F.lit(1).alias("row_seq"))
    store = keyed.KeyedStore(spark, f"{_folder(spark)}/daily", ["symbol", "ts"], "year")
    store.upsert(rows, "row_seq")
    store.upsert(rows.where("month(ts) = 2 and year >= 1998").withColumn("volume", F.col("volume") * 2), "row_seq")
    store.delete(F.col("symbol") == "N05")
    return store.read().groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"))


def refilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored features with gaps: rows of a few days lack a value, others are missing; one symbol is not computed anew."""
    computed = compute_features(tables.bars_daily(spark, sf_dir)).withColumn("year", F.year("ts")).checkpoint()
    damaged = computed.withColumn("sma_200", F.when(F.dayofmonth("ts") != 7, F.col("sma_200"))).withColumn("close", F.col("close") + F.when(F.dayofmonth("ts") == 9, 1000).otherwise(0))
    store = keyed.KeyedStore(spark, f"{_folder(spark)}/features", ["symbol", "ts"], "year")
    store.insert(damaged.where(F.dayofyear("ts") % 5 != 0))
    purged = refill(store, computed.where("symbol <> 'N05'"), VALUES)
    out = store.read().groupBy("symbol").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 4).alias("closes"), F.count(F.when(F.col("sma_200").isNull(), 1)).alias("lacking"))
    return out.withColumn("purged", F.lit(purged).cast("long"))


def last_of_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.keep_last(tables.bars_daily(spark, sf_dir), ["ts"], "symbol").select(day(), "symbol")


def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trading.numbered(tables.raw_prices(spark, sf_dir), ["symbol"]).select("symbol", day(), "row_seq", "i")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = trading.numbered(tables.bars_daily(spark, sf_dir), ["symbol"])
    return trading.flagged(bars, trading.trades(bars, ["symbol"], F.lit(0.5)), ["symbol"], F.lit(0.5)).withColumn("split", F.year("ts"))


def split_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged bars stored by split as CSV and read back, with each split's first rows and the stored threshold."""
    folder = _folder(spark)
    artifacts.save_splits(_flags(spark, sf_dir).drop("i"), f"{folder}/splits")
    best = _flags(spark, sf_dir).agg(F.lit(0.45).alias("threshold"), F.lit(50.0).alias("directional_accuracy"), F.lit("2024").alias("logged_at"))
    artifacts.save_grid(best, f"{folder}/grid")
    artifacts.log_experiment(best, f"{folder}/log")
    artifacts.log_experiment(best.withColumn("directional_accuracy", F.lit(60.0)), f"{folder}/log")
    logged = artifacts.experiments(spark, f"{folder}/log").agg(F.max("directional_accuracy").alias("most"), F.count("*").alias("runs"))
    level, fallback = artifacts.best_threshold(spark, f"{folder}/grid"), artifacts.best_threshold(spark, f"{folder}/none")
    number = artifacts.splits(spark, f"{folder}/splits")[-1]
    rows = artifacts.load_split(spark, f"{folder}/splits")
    heads = artifacts.heads(artifacts.load_split(spark, f"{folder}/splits", number).withColumn("part", F.lit("test"))).groupBy("split").agg(F.count("*").alias("heads"))
    out = rows.groupBy("split").agg(F.count("*").alias("bars"), F.sum("entry_trade").alias("entries"), F.round(F.sum("strategy_return"), 4).alias("returns"))
    out = out.join(heads, "split", "left").join(logged).withColumns({"threshold": F.lit(level), "fallback": F.lit(fallback)})
    return out.select(F.col("split").cast("int").alias("split"), "bars", F.col("entries").cast("long").alias("entries"), "returns", "heads", "threshold", "fallback", "most", "runs")


def single_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trading.equity(_flags(spark, sf_dir), ["symbol"]).select("symbol", day(), *rounded(["cum_strategy_return"]))


def trade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of one split with their symbols' compounded equity, and the stored indicators of their entries."""
    flags = _flags(spark, sf_dir).where("split = 1997")
    trades = trading.pnl_table(flags)
    stored = tables.bars_daily(spark, sf_dir).select("symbol", "ts", (F.col("high") - F.col("low")).alias("width"))
    return reports.with_indicators(trades.withColumn("ts", F.col("entry_ts")), stored).select("symbol", "n", day(), *rounded(["equity", "width"]))


def grid_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_daily(spark, sf_dir).withColumn("threshold", F.lit(0.5)).groupBy("threshold", F.year("ts").alias("split")).agg(F.sum("volume").alias("cum_return"), F.count("*").alias("cum_market_return"))
    nested = bars.groupBy("threshold").agg(F.array_sort(F.collect_list(F.struct("split", "cum_return", "cum_market_return"))).alias("per_split"))
    return reports.grid_series(nested)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (F.col("doc_id") % 50 - 25) / 10
    raw = F.format_string('{"conviction_score": %.1f, "adjustment": %.2f, "risk_flags": %s, "rationale": " r%d "}', score, score / 10, F.when(F.col("doc_id") % 4 == 0, '"none"').otherwise('["a", "b"]'), "doc_id")
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit('{"conviction_score": 1}')).otherwise(raw)
    d = tables.table(spark, sf_dir, "documents").select("doc_id", scalars.decision(raw).alias("d"))
    return d.select("doc_id", F.round("d.conviction_score", 6).alias("conviction"), F.round("d.adjustment", 6).alias("adjustment"), F.array_join("d.risk_flags", ",").alias("flags"), "d.rationale")


def _word_model() -> Callable:
    return lambda texts: np.array([len(t.split(" ")) / 1000 for t in texts], dtype=np.float64)


def _shape_model() -> Callable:
    return lambda texts: np.array([[len(t), t.count("a"), 0] for t in texts], dtype=np.float32)


def scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text_for_score"))
    return vectors.score_texts(rows, _word_model).select("doc_id", F.round("score", 6).alias("score"))


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("symbol"), "text")
    points = vectors.chunk_points(articles, size=2000)
    stored = vectors.embed(points.where("article_id % 2 = 0"), _shape_model, points.limit(0).drop("body").selectExpr("*", "cast(null as array<float>) as vector", "point_id as row_seq"))
    out = vectors.embed(points.where("article_id % 3 = 0"), _shape_model, stored)
    length = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    per = out.select("symbol", "chunk_idx", F.get("vector", F.lit(0)).alias("first"), length(F.col("vector")).alias("square"))
    return per.groupBy("symbol").agg(F.count("*").alias("points"), F.max("chunk_idx").alias("last_chunk"), F.round(F.sum("first"), 1).alias("first"), F.round(F.avg("square"), 4).alias("square"))


def streamed_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is run a second time takes up only what has landed since."""
    folder = _folder(spark)
    rows = tables.bars_daily(spark, sf_dir).select("symbol", "ts", "volume")
    rows.where("symbol < 'N10'").write.parquet(f"{folder}/landed")
    for late in (False, True):
        if late:
            rows.where("symbol >= 'N08'").withColumn("volume", F.col("volume") + 1).write.mode("append").parquet(f"{folder}/landed")
        stream = ingest.files(spark, f"{folder}/landed", rows.schema)
        ingest.start(stream, f"{folder}/offsets", ingest.upsert_into(f"{folder}/table", ["symbol", "ts"], "volume")).awaitTermination()
    return ingest.current(spark, f"{folder}/table", ["symbol", "ts"], "volume").groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"))


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of a file: the first characters are the title, the next the summary; three documents in a row share an id."""
    part = lambda a, n: F.trim(F.substring("text", a, n))
    rows = tables.table(spark, sf_dir, "documents").select(
        F.lit("file").alias("source"), F.upper("source").alias("symbol"), F.floor(F.col("doc_id") / 3).cast("string").alias("external_id"), part(1, 60).alias("title"), part(61, 200).alias("summary"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 100000 * 60).alias("published_at"), F.concat(F.lit("https://ex/"), F.col("doc_id").cast("string")).alias("url"), F.col("doc_id").alias("row_seq"),
    )
    rows = rows.withColumns({"title": F.coalesce("title", F.lit("")), "summary": F.coalesce("summary", F.lit(""))})
    return rows.withColumns({"content_sha256": scalars.content_hash(F.col("title"), F.col("summary")), "text_for_score": scalars.headline_text(F.col("title"), F.col("summary"))}).select("source", *news.ITEM)


def streamed_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that land in two parts, the second of which brings some of the first again: what each run counted, and what the tables hold."""
    folder = _folder(spark)
    rows = _slices(spark, sf_dir)
    store = items.NewsStore(spark, f"{folder}/news", _word_model)
    for part in ("row_seq % 2 = 0", "row_seq % 2 = 1 or row_seq % 4 = 0"):
        rows.where(part).write.mode("append").parquet(f"{folder}/landed")
        items.run(ingest.files(spark, f"{folder}/landed", rows.schema, 10_000), store, f"{folder}/offsets")
    # a row a run
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("batch")) - 1
    runs = store.counts().select(F.concat(F.lit("run "), number.cast("string")).alias("what"), "items", "raw_added", "clean_added", "scored")
    chars = lambda name, rows: rows.agg(F.lit(name).alias("what"), F.count("*").alias("items"), F.sum(F.length("title")).alias("raw_added"), F.sum(F.length("summary")).alias("clean_added"))
    held = chars("raw", store.raw()).withColumn("scored", F.lit(None).cast("long"))
    clean = chars("clean", store.clean()).join(store.clean().agg(F.round(F.sum("score") * 1000).cast("long").alias("scored")))
    return runs.unionByName(held).unionByName(clean)


def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two providers in order: the second one's items that the first one has are left out, and each one's counts."""
    rows = _slices(spark, sf_dir)
    second = rows.where("row_seq % 3 <> 1").withColumn("url", F.lit("second"))
    found, counts = items.united([rows.where("row_seq % 2 = 0"), second])
    own = found.groupBy("provider").agg(F.sum("row_seq").alias("row_sum"), F.sum(F.length("title")).alias("title_chars"))
    return counts.join(own, "provider", "left")


def incremental_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = tables.feature_days(spark, sf_dir)
    stored = days.where("symbol <> 'U3'").withColumn("as_of_date", F.date_add("as_of_date", 50))
    out = sentiment.incremental_rollup(days, tables.articles(spark, sf_dir), stored, 30)
    return out.groupBy("symbol").agg(F.count("*").alias("days"), F.date_format(F.min("as_of_date"), "yyyy-MM-dd").alias("first_day"), F.sum("article_count").alias("articles"))


QUERIES = {
    "s08_symbol_file": symbol_file, "s04_ticker_news": ticker_news, "s05_article_list": article_list, "s06_filings": filings, "i11_bronze": bronze, "i14_gap_starts": gap_starts,
    "i07_incomplete": incomplete, "i07_refilled": refilled, "a06_watermarks": watermarks, "i19_daily_upsert": daily_upsert, "u05_last_of_instant": last_of_instant, "k4_stable_order": stable_order,
    "s21_split_artifacts": split_artifacts, "b05_single_equity": single_equity, "x13_trade_rows": trade_rows, "b27_grid_series": grid_series, "f18_decisions": decisions,
    "d1_scored_texts": scored_texts, "d2_embedded_chunks": embedded_chunks, "t2_streamed_again": streamed_again, "t5_streamed_news": streamed_news, "i15_hybrid_union": hybrid_union, "t4_incremental_rollup": incremental_rollup,
}

_NEWS = "n AS (SELECT upper(source) AS symbol, doc_id, CAST(doc_id AS VARCHAR) AS number, TIMESTAMP '2024-01-01' + doc_id % 100000 * INTERVAL 1 MINUTE AS pub FROM documents)"
_ISO = "strftime(pub, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
_ALL_FLAGS = f"{_FLAGS}, f AS (SELECT flags.*, close, high, low, year(flags.ts) AS split FROM flags JOIN bars USING (symbol, ts))"

_SLICES = """s AS (SELECT doc_id, doc_id // 3 AS ext, coalesce(trim(substring(text, 1, 60)), '') AS title, coalesce(trim(substring(text, 61, 200)), '') AS summary FROM documents),
i AS (SELECT *, sha256(title || '|' || summary) AS sha, concat_ws('. ', nullif(trim(title), ''), nullif(trim(summary), '')) AS body FROM s)"""

ORACLE_SQL = {
    "t5_streamed_news": f"""WITH {_SLICES}, d AS (SELECT *, 0 AS run FROM i WHERE doc_id % 2 = 0 UNION ALL SELECT *, 1 FROM i WHERE doc_id % 2 = 1 OR doc_id % 4 = 0),
        k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY ext, sha ORDER BY run, doc_id) = 1),
        raw AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY ext ORDER BY run DESC, doc_id DESC) = 1),
        born AS (SELECT ext, min(run) AS run FROM k GROUP BY ext), clean AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY sha ORDER BY run, doc_id) = 1),
        w AS (SELECT *, CASE WHEN trim(body) <> '' THEN len(string_split(trim(body), ' ')) END AS score FROM clean)
        SELECT 'run ' || run AS what, (SELECT count(*) FROM k WHERE k.run = r.run) AS items, (SELECT count(*) FROM born b WHERE b.run = r.run) AS raw_added,
          (SELECT count(*) FROM clean c WHERE c.run = r.run) AS clean_added, (SELECT count(score) FROM w WHERE w.run = r.run) AS scored FROM (VALUES (0), (1)) r(run)
        UNION ALL SELECT 'raw', count(*), CAST(sum(length(title)) AS BIGINT), CAST(sum(length(summary)) AS BIGINT), NULL FROM raw
        UNION ALL SELECT 'clean', count(*), CAST(sum(length(title)) AS BIGINT), CAST(sum(length(summary)) AS BIGINT), CAST(sum(score) AS BIGINT) FROM w""",
    "i15_hybrid_union": f"""WITH {_SLICES}, d AS (SELECT *, 0 AS provider FROM i WHERE doc_id % 2 = 0 UNION ALL SELECT *, 1 FROM i WHERE doc_id % 3 <> 1),
        k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY ext, sha ORDER BY provider, doc_id) = 1)
        SELECT provider, count(*) AS fetched, (SELECT count(*) FROM k WHERE k.provider = d.provider) AS kept, (SELECT CAST(sum(doc_id) AS BIGINT) FROM k WHERE k.provider = d.provider) AS row_sum,
          (SELECT CAST(sum(length(title)) AS BIGINT) FROM k WHERE k.provider = d.provider) AS title_chars FROM d GROUP BY provider""",
    "t4_incremental_rollup": f"""WITH {sql.EVENTS}, d AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM hourly),
        k AS (SELECT *, max(day) OVER (PARTITION BY symbol) AS last FROM d), a AS (SELECT symbol, CAST(published_at AS DATE) AS day, count(*) AS n FROM articles GROUP BY ALL)
        SELECT symbol, count(*) AS days, strftime(min(day), '%Y-%m-%d') AS first_day, CAST(sum(coalesce(n, 0)) AS BIGINT) AS articles FROM k LEFT JOIN a USING (symbol, day)
        WHERE symbol = 'U3' OR day >= last - 10 GROUP BY symbol""",
    "s08_symbol_file": f"WITH {sql.BARS} SELECT DISTINCT symbol FROM bars UNION ALL SELECT 'BRK-B'",
    "s04_ticker_news": f"""WITH {_NEWS}, i AS (SELECT *, 'Title ' || number AS title, CASE WHEN doc_id % 4 <> 0 THEN 'S ' || number ELSE '' END AS summary,
          CASE WHEN doc_id % 3 <> 0 THEN 'https://ex/' || number END AS url, {_ISO} AS iso FROM n WHERE doc_id % 5 <> 0)
        SELECT doc_id AS row_seq, coalesce(url, substring(sha256(symbol || '|' || title || '|' || iso), 1, 40)) AS external_id,
          sha256(symbol || '|' || title || '|' || summary || '|' || iso) AS content_sha256, iso AS published_at, CASE WHEN summary <> '' THEN title || '. ' || summary ELSE title END AS text_for_score, url FROM i""",
    "s05_article_list": f"""WITH {_NEWS} SELECT symbol, 'u' || number || 'a' AS external_id, sha256(symbol || '|' || symbol || ' stock ' || number || '||' || {_ISO}) AS content_sha256,
        symbol || ' stock ' || number AS title, CAST(0 AS BIGINT) AS row_seq FROM n WHERE doc_id % 2 = 0""",
    "s06_filings": f"""WITH {_NEWS} SELECT symbol, 'sec:00-' || number || ':a.htm' AS external_id, 'https://www.sec.gov/Archives/edgar/data/32' || symbol[-1:] || '/00' || number || '/a.htm' AS url,
        symbol || ' SEC 8-K filing' AS title, sha256(symbol || '|8-K|00-' || number || '|a.htm|' || strftime(pub, '%Y-%m-%d')) AS content_sha256 FROM n""",
    "i11_bronze": f"""WITH {_NEWS}, k AS (SELECT symbol, doc_id FROM n QUALIFY row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id % 2 DESC, doc_id DESC) = 1)
        SELECT symbol, count(*) AS items, CAST(sum(doc_id) AS BIGINT) AS row_sum FROM k GROUP BY symbol""",
    "i14_gap_starts": f"""WITH {sql.EVENTS}, l AS (SELECT symbol, max(published_at) FILTER (symbol <> 'U3' AND published_at < TIMESTAMP '2024-01-20') AS newest FROM articles GROUP BY symbol)
        SELECT symbol, strftime(greatest(coalesce(CAST(newest AS DATE), DATE '2024-01-16'), DATE '2024-01-16'), '%Y-%m-%d') AS start FROM l""",
    "i07_incomplete": f"""WITH {sql.BARS}, {sql.window_features("bars")}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM win)
        SELECT symbol, count(*) AS rows, strftime(max(ts), '%Y-%m-%d') AS last_day FROM r
        WHERE rn < 200 OR stochastic_k IS NULL OR stochastic_d IS NULL OR bb_pband_20 IS NULL OR volatility_ratio IS NULL GROUP BY symbol""",
    "a06_watermarks": f"WITH {sql.EVENTS} SELECT symbol, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') AS watermark FROM articles GROUP BY symbol",
    "i19_daily_upsert": f"""WITH {sql.BARS} SELECT symbol, count(*) AS bars, CAST(sum(CASE WHEN month(ts) = 2 AND year(ts) >= 1998 THEN volume * 2 ELSE volume END) AS BIGINT) AS volume
        FROM bars WHERE symbol <> 'N05' GROUP BY symbol""",
    "i07_refilled": f"""WITH {sql.BARS}, {sql.window_features("bars")}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM win),
        k AS (SELECT symbol, ts, close, rn >= 200 AS mean, rn >= 200 AND stochastic_k IS NOT NULL AND stochastic_d IS NOT NULL AND bb_pband_20 IS NOT NULL AND volatility_ratio IS NOT NULL AS whole,
          dayofyear(ts) % 5 <> 0 AS kept, dayofmonth(ts) = 7 AS hurt, dayofmonth(ts) = 9 AS other FROM r),
        f AS (SELECT *, kept AND NOT (whole AND NOT hurt) AS lacks, symbol <> 'N05' AND bool_or(whole) OVER (PARTITION BY symbol) AS anew FROM k),
        o AS (SELECT symbol, close + CASE WHEN other AND kept AND NOT (lacks AND anew) THEN 1000 ELSE 0 END AS close, NOT mean OR hurt AND NOT anew AS no FROM f
          WHERE CASE WHEN anew THEN kept AND NOT lacks OR whole ELSE kept END)
        SELECT symbol, count(*) AS bars, round(sum(close), 4) AS closes, count(*) FILTER (no) AS lacking, (SELECT count(*) FROM f WHERE lacks AND anew) AS purged FROM o GROUP BY symbol""",
    "u05_last_of_instant": f"WITH {sql.BARS} SELECT {DAY}, max(symbol) AS symbol FROM bars GROUP BY ts",
    "k4_stable_order": f"WITH {sql.RAW} SELECT symbol, {DAY}, CAST(row_seq AS INTEGER) AS row_seq, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts, row_seq) - 1 AS INTEGER) AS i FROM raw",
    "s21_split_artifacts": f"""WITH RECURSIVE {_ALL_FLAGS} SELECT CAST(split AS INTEGER) AS split, count(*) AS bars, CAST(sum(entry_trade) AS BIGINT) AS entries, round(sum(strategy_return), 4) AS returns,
        CASE WHEN split = (SELECT max(split) FROM f) THEN least(count(*), 5) END AS heads, CAST(0.45 AS DOUBLE) AS threshold, CAST(0.33 AS DOUBLE) AS fallback, CAST(60 AS DOUBLE) AS most, CAST(2 AS BIGINT) AS runs FROM f GROUP BY split""",
    "b05_single_equity": f"""WITH RECURSIVE {_ALL_FLAGS} SELECT symbol, {DAY}, round(exp(sum(ln(1 + strategy_return)) OVER (PARTITION BY symbol ORDER BY ts)), 6) AS cum_strategy_return FROM f""",
    "x13_trade_rows": f"""WITH RECURSIVE {_ALL_FLAGS}, o AS (SELECT * FROM f WHERE split = 1997),
        e AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM o WHERE entry_trade = 1),
        x AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM o WHERE exit_trade = 1)
        SELECT symbol, CAST(n AS INTEGER) AS n, {DAY}, round(exp(sum(ln(1 + strategy_return)) OVER (PARTITION BY symbol ORDER BY n)), 6) AS equity, round(high - low, 6) AS width FROM e JOIN x USING (symbol, n)""",
    "b27_grid_series": f"""WITH {sql.BARS} SELECT CAST(0.5 AS DOUBLE) AS threshold, CAST(year(ts) AS INTEGER) AS split, CAST(sum(volume) AS BIGINT) AS cum_return, count(*) AS cum_market_return FROM bars GROUP BY ALL""",
    "f18_decisions": """WITH s AS (SELECT doc_id, round((doc_id % 50 - 25) / 10, 1) AS s, doc_id % 5 <> 0 AND doc_id % 4 <> 0 AS ok FROM documents)
        SELECT doc_id, CASE WHEN ok THEN round(greatest(-1, least(1, s)), 6) END AS conviction, CASE WHEN ok THEN round(greatest(-0.1, least(0.1, round(s / 10, 2))), 6) END AS adjustment,
          CASE WHEN ok THEN 'a,b' END AS flags, CASE WHEN ok THEN 'r' || doc_id END AS rationale FROM s""",
    "d1_scored_texts": """WITH t AS (SELECT doc_id, substring(trim(text), 1, 4000) AS t FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 9 <> 0 AND t <> '' THEN round(len(string_split(t, ' ')) / 1000, 6) END AS score FROM t""",
    "d2_embedded_chunks": """WITH c AS (SELECT source, trim(text) AS t, unnest(range(0, length(trim(text)), 2000)) AS s FROM documents WHERE length(trim(text)) > 0 AND (doc_id % 2 = 0 OR doc_id % 3 = 0)),
        b AS (SELECT source, s // 2000 AS i, substring(t, CAST(s + 1 AS BIGINT), 2000) AS b FROM c), v AS (SELECT *, length(b) AS x, length(b) - length(replace(b, 'a', '')) AS y FROM b)
        SELECT source AS symbol, count(*) AS points, CAST(max(i) AS INTEGER) AS last_chunk, round(sum(x / sqrt(x * x + y * y)), 1) AS first, CAST(1 AS DOUBLE) AS square FROM v GROUP BY source""",
    "t2_streamed_again": f"WITH {sql.BARS} SELECT symbol, count(*) AS bars, CAST(sum(CASE WHEN symbol >= 'N08' THEN volume + 1 ELSE volume END) AS BIGINT) AS volume FROM bars GROUP BY symbol",
}
