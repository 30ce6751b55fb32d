"""News files as one table of items: mapped files, nested ticker news, article lists, filings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import clean_text, content_hash, headline_text, iso, is_relevant, join_parts, lenient_time
from marketloom.sources.keyed import first_wins, last_wins

ITEM = ["symbol", "external_id", "content_sha256", "published_at", "title", "summary", "url", "text_for_score", "row_seq"]
#: Filing forms that are kept (fixed values).
FORMS = ["8-K", "10-Q", "10-K", "6-K"]

#: Most symbols that are broadcast to the rows of a file without symbols.
BROADCAST_SYMBOLS = 10_000


@dataclass(frozen=True)
class Mapping:
    """A file's columns; without a symbol column its rows concern every requested symbol."""

    published_at: str
    title: str
    symbol: str | None = None
    summary: str | None = None
    body: str | None = None
    url: str | None = None
    zone: str = "UTC"


MAPPINGS = {
    # file formats (fixed values)
    "market_headlines": Mapping("Date", "Title"),
    "ticker_news": Mapping("published_at", "headline", "ticker", "summary", "text", "url"),
    "generic": Mapping("published_at", "title", "symbol", "summary", "body", "url"),
    "headline_time_ticker": Mapping("date", "headline", "ticker", "summary", "article", "link"),
}


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by suffix, else CSV with a header."""
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def mapped(rows: DataFrame, mapping: Mapping, symbols: DataFrame, start: str, end: str, row_seq: Column | None = None) -> DataFrame:
    """ITEM rows of a mapped file for some symbols and days (UTC, inclusive), one for each symbol and external id.

    The first row by row_seq stays. Rows without a time or any text are left out.
    """
    part = lambda c: clean_text(F.col(c)) if c else F.lit("")
    seq = F.monotonically_increasing_id() if row_seq is None else row_seq
    wanted = symbols.select(F.upper("symbol").alias("symbol")).distinct()
    base = rows.select(
        part(mapping.symbol).alias("own"), lenient_time(F.col(mapping.published_at), mapping.zone).alias("published_at"),
        part(mapping.title).alias("title"), part(mapping.summary).alias("s"), part(mapping.body).alias("body"), part(mapping.url).alias("url"), seq.alias("row_seq"),
    )
    base = base.where(F.to_date("published_at").between(start, end))
    if mapping.symbol:
        base = base.join(wanted, F.upper("own") == F.col("symbol"))
    else:
        few = wanted.limit(BROADCAST_SYMBOLS + 1).count() <= BROADCAST_SYMBOLS
        base = base.crossJoin(F.broadcast(wanted) if few else wanted)
    items = base.withColumn("text_for_score", join_parts(F.col("title"), F.col("s"), F.col("body"))).where("text_for_score <> ''")
    items = items.withColumn("external_id", F.substring(content_hash(F.col("symbol"), iso(F.col("published_at")), F.col("title"), F.col("url")), 1, 40))
    items = items.withColumn("content_sha256", content_hash(F.col("symbol"), F.col("title"), F.col("s"), F.col("body"), iso(F.col("published_at"))))
    items = items.withColumn("summary", F.when(F.col("s") != "", F.col("s")).otherwise(F.col("body"))).withColumn("url", F.nullif("url", F.lit("")))
    first = Window.partitionBy("symbol", "external_id").orderBy("row_seq")
    return items.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*ITEM)


def payload(rows: DataFrame, key: str, source_url: str, path: str, digest: str) -> Column:
    """A raw item's JSON: where its file comes from and, under row, all of its own columns, nulls included."""
    facts = {"dataset_key": key, "dataset_source_url": source_url, "dataset_path": path, "dataset_sha256": digest}
    own = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")
    return F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in facts.items()), own), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"})


def fingerprint() -> Column:
    text = F.concat(F.lower(F.trim("title")), F.lit("|"), F.lower(F.trim(F.coalesce("url", F.lit("")))))
    return F.substring(F.sha2(text, 256), 1, 16)


def combined(files: list[DataFrame]) -> DataFrame:
    """Items of several files, one for each symbol, minute and title with url: the first file's, then the first row's."""
    tagged = [f.withColumn("file_seq", F.lit(n)) for n, f in enumerate(files)]
    rows = reduce(DataFrame.unionByName, tagged).withColumn("minute", F.date_trunc("minute", "published_at")).withColumn("print", fingerprint())
    first = Window.partitionBy("symbol", "minute", "print").orderBy("file_seq", "row_seq")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "minute", "print")


def ticker_news(rows: DataFrame) -> DataFrame:
    """ITEM rows of nested ticker news (symbol, row_seq, content: title, summary, pubDate, canonicalUrl.url); undated ones go."""
    c = F.col("content")
    items = rows.select("symbol", "row_seq", clean_text(c["title"]).alias("title"), clean_text(c["summary"]).alias("summary"), lenient_time(c["pubDate"]).alias("published_at"), F.nullif(clean_text(c["canonicalUrl"]["url"]), F.lit("")).alias("url"))
    items = items.where("published_at is not null").withColumn("text_for_score", headline_text(F.col("title"), F.col("summary")))
    items = items.withColumn("external_id", F.coalesce("url", F.substring(content_hash(F.col("symbol"), F.col("title"), iso(F.col("published_at"))), 1, 40)))
    return items.withColumn("content_sha256", content_hash(F.col("symbol"), F.col("title"), F.col("summary"), iso(F.col("published_at")))).select(*ITEM)


def article_list(rows: DataFrame) -> DataFrame:
    """ITEM rows of article lists (symbol, articles: title, seendate, url) that name the symbol and a finance term, one for each url."""
    each = rows.select("symbol", F.posexplode("articles").alias("row_seq", "a"))
    items = each.select("symbol", F.col("row_seq").cast("long").alias("row_seq"), clean_text(F.col("a.title")).alias("title"), lenient_time(F.col("a.seendate")).alias("published_at"), F.nullif(clean_text(F.col("a.url")), F.lit("")).alias("url"))
    items = items.where(F.col("published_at").isNotNull() & is_relevant(F.col("symbol"), F.col("title"), F.lit("")))
    items = items.withColumn("external_id", F.coalesce("url", F.substring(content_hash(F.col("symbol"), F.col("title"), iso(F.col("published_at"))), 1, 40)))
    items = items.withColumns({"content_sha256": content_hash(F.upper("symbol"), F.col("title"), F.lit(""), iso(F.col("published_at"))), "summary": F.lit(""), "text_for_score": F.col("title")})
    first = Window.partitionBy("symbol", "external_id").orderBy("row_seq")
    return items.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*ITEM)


def company_ids(rows: DataFrame, json: str = "value") -> DataFrame:
    """(symbol, cik) from a JSON object of objects (ticker, cik_str); ids are padded to ten digits."""
    entries = F.explode(F.map_values(F.from_json(F.col(json), "map<string,struct<ticker:string,cik_str:bigint>>")))
    return rows.select(entries.alias("e")).select(F.upper("e.ticker").alias("symbol"), F.lpad(F.col("e.cik_str").cast("string"), 10, "0").alias("cik"))


def filings(rows: DataFrame, start: str, end: str) -> DataFrame:
    """ITEM rows of filings (symbol, cik, recent: parallel arrays) of FORMS between two days."""
    r = F.col("recent")
    fields = ["form", "filingDate", "accessionNumber", "primaryDocument"]
    each = rows.select("symbol", "cik", F.posexplode(F.arrays_zip(*(r[f].alias(f) for f in fields))).alias("row_seq", "f"))
    day = F.expr("try_to_date(f.filingDate)")
    kept = each.withColumn("day", day).where(F.col("day").between(start, end) & F.trim("f.form").isin(FORMS) & (F.trim("f.accessionNumber") != "") & (F.trim("f.primaryDocument") != ""))
    number, doc, form = F.trim("f.accessionNumber"), F.trim("f.primaryDocument"), F.trim("f.form")
    items = kept.withColumn("title", F.concat(F.upper("symbol"), F.lit(" SEC "), form, F.lit(" filing")))
    items = items.withColumns({
        "external_id": F.concat(F.lit("sec:"), number, F.lit(":"), doc),
        "content_sha256": content_hash(F.col("symbol"), form, number, doc, F.date_format("day", "yyyy-MM-dd")),
        "url": F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("long").cast("string"), F.lit("/"), F.replace(number, F.lit("-"), F.lit("")), F.lit("/"), doc),
        "published_at": F.col("day").cast("timestamp"), "summary": F.lit(""), "text_for_score": F.col("title"),
    })
    return items.withColumn("row_seq", F.col("row_seq").cast("long")).withColumn("symbol", F.upper("symbol")).select(*ITEM)


def bronze(stored: DataFrame, items: DataFrame) -> DataFrame:
    """Raw items, the last one of each source and external id."""
    return last_wins(stored, items, ["source", "external_id"], "row_seq")


def silver(stored: DataFrame, items: DataFrame) -> DataFrame:
    """Clean items to append: new content alone, titles and summaries cut."""
    cut = items.withColumns({"title": F.substring("title", 1, 8000), "summary": F.substring("summary", 1, 16000)})
    return first_wins(stored, cut, ["content_sha256"], "row_seq")


def gap_start(latest: DataFrame, today: Column, lookback: int) -> DataFrame:
    """(symbol, start) of a refresh: the day of the newest article, no earlier than lookback days (1 to 60) ago."""
    days = max(1, min(60, lookback))
    return latest.select("symbol", F.greatest(F.coalesce(F.to_date("newest"), F.date_sub(today, days)), F.date_sub(today, days)).alias("start"))


def source_counts(items: DataFrame, kept: Column) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("fetched"), F.sum(kept.cast("int")).alias("kept"), F.sum((~kept).cast("int")).alias("filtered"))
