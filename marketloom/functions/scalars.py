"""Scalar expressions: text cleaning, lenient times, hashes, clamps, signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a text as financial (fixed values).
FINANCE_TERMS = ["earnings", "revenue", "guidance", "profit", "shares", "stock", "dividend", "quarter", "nasdaq", "nyse"]
#: Formats tried in turn for lenient times.
TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd", "MM/dd/yyyy", "MMM d, yyyy"]


def clean_text(c: Column) -> Column:
    """Trimmed text; null and nan are empty."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(text) == "nan", "").otherwise(text)


def join_parts(*parts: Column) -> Column:
    """Non-empty parts joined by a space."""
    return F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def headline_text(title: Column, summary: Column) -> Column:
    """title. summary, or whichever there is."""
    return F.concat_ws(". ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(summary), F.lit("")))


def lenient_time(c: Column, zone: str = "UTC") -> Column:
    """An instant from text in one of TIME_FORMATS; without an offset it is local to the zone; null if none fits."""
    text = F.trim(c.cast("string"))
    has_offset = text.rlike(r"(Z|[+-]\d\d:?\d\d)$") & text.rlike(r"\d:\d")
    parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS))
    return F.when(has_offset, parsed).otherwise(F.to_utc_timestamp(parsed, zone))


def iso(ts: Column) -> Column:
    """UTC instant as yyyy-MM-ddTHH:mm:ss[.ffffff]+00:00."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def is_relevant(symbol: Column, title: Column, text: Column) -> Column:
    """The symbol stands in the title or text as a word, with a finance term anywhere."""
    body = F.upper(F.concat(title, F.lit("\n"), text))
    word = F.concat(F.lit(r"\b\Q"), F.upper(symbol), F.lit(r"\E\b"))
    return F.regexp_like(body, word) & body.rlike("|".join(t.upper() for t in FINANCE_TERMS))


def signed_score(label: Column, score: Column) -> Column:
    """+score for a positive label, -score for a negative one, else 0."""
    kind = F.lower(label)
    return F.when(F.contains(kind, F.lit("positive")), score).when(F.contains(kind, F.lit("negative")), -score).otherwise(0.0)


def chunks(text: Column, size: int = 500) -> Column:
    """array<string> of slices; none for a blank text."""
    trimmed = F.trim(text)
    starts = F.sequence(F.lit(0), F.length(trimmed) - 1, F.lit(size))
    return F.when(F.length(trimmed) > 0, F.transform(starts, lambda s: F.substr(trimmed, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def point_id(article: Column, chunk: Column) -> Column:
    return article * 10_000 + chunk


def clamp(c: Column, low: float, high: float) -> Column:
    """The value held between two bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def signal(forecast: Column, band: float = 0.02) -> Column:
    return F.when(forecast > band, "BUY").when(forecast < -band, "SELL").otherwise("HOLD")


def decision(raw: Column) -> Column:
    """struct of a decision's JSON text, clamped; null if it is no object with all four keys and a list of flags."""
    parsed = F.from_json(raw, "conviction_score double, adjustment double, risk_flags array<string>, rationale string")
    keys = [F.get_json_object(raw, f"$.{k}").isNotNull() for k in ("conviction_score", "adjustment", "risk_flags", "rationale")]
    ok = keys[0] & keys[1] & keys[2] & keys[3] & parsed["risk_flags"].isNotNull() & parsed["conviction_score"].isNotNull() & parsed["adjustment"].isNotNull()
    value = F.struct(
        clamp(parsed["conviction_score"], -1.0, 1.0).alias("conviction_score"), clamp(parsed["adjustment"], -0.1, 0.1).alias("adjustment"),
        parsed["risk_flags"].alias("risk_flags"), F.trim(parsed["rationale"]).alias("rationale"),
    )
    return F.when(ok, value)
