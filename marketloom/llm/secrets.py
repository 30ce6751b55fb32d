"""Secret scans in SQL functions alone, with the ownership frequency of every candidate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.shared import join_counted, materialise


@dataclass(frozen=True)
class Kind:
    """A kind of candidate: its pattern, the group that is the secret and the secret's least length."""

    name: str
    pattern: str
    group: int
    least: int


#: The kinds that always count, in their order (fixed values). A run of hex digits or of access-key
#: characters that is long enough is found by its own pattern; a short one can hide no longer one.
BASE = [
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Further candidates, which count only where they look live: long mixed tokens.
LIVE = Kind("live", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
#: A mixed token has a digit, a capital and a small letter.
MIXED = r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])"


def _matches(text: Column, kind: Kind) -> Column:
    """array<struct<start,end,secret>> of a pattern's matches, in code points, end exclusive.

    The pieces between the matches and the matches themselves alternate, so that lengths give the
    places; texts without a match are tested once and go no further.
    """
    pattern = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    secret = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else whole
    found = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), whole.alias("whole"), secret.alias("secret"))
    span = "array<struct<start:int,end:int,secret:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def step(done: Column, part: Column) -> Column:
        begin = done["at"] + F.length(part["gap"])
        end = begin + F.length(F.coalesce(part["whole"], F.lit("")))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), part["secret"].alias("secret")))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.when(part["whole"].isNotNull(), one).otherwise(F.array().cast(span))).alias("spans"))

    spans = F.aggregate(found, start, step, lambda done: done["spans"])
    return F.when(F.regexp_like(text, pattern), spans).otherwise(F.array().cast(span))


def _candidates(text: Column) -> Column:
    """array<struct<start,kind,end,secret>> of all kinds, failing matches dropped."""

    def of(at: int, kind: Kind) -> Column:
        found = _matches(text, kind)
        if kind is LIVE:
            passed = F.filter(found, lambda s: F.regexp_like(s["secret"], F.lit(MIXED)))
        else:
            passed = F.filter(found, lambda s: F.length(s["secret"]) >= kind.least)
        return F.transform(passed, lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("kind"), s["end"].alias("end"), s["secret"].alias("secret")))

    return F.concat(*(of(at, kind) for at, kind in enumerate([*BASE, LIVE])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", live_repos: int = 1) -> DataFrame:
    """(id, spans) for every row, spans: array<struct<start, kind, end, repos, owners, live>> by start and kind.

    Places are code points of the text, end exclusive; kind is the place in BASE, or len(BASE) for
    a further candidate. repos and owners are the numbers of distinct repositories and owners that
    hold the same secret anywhere in the table: copied examples have many. live marks secrets of
    one owner in live_repos repositories or fewer. Spans of BASE kinds always stay; further
    candidates stay only if they are live and overlap no span of a BASE kind. A null or empty text
    has no spans; null repositories and owners count as one of their own each; repeated rows are
    one holder if their repository and owner are equal. Texts of any length are searched whole, each in one
    task. An empty table gives none. Other columns
    play no part.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        part(repo_col).alias("repo"),
        part(owner_col).alias("owner"),
        _candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("found"),
    )
    digest = lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind", "end")), F.sha2(s["secret"], 256).alias("secret"))
    rows = materialise(rows.withColumn("found", F.transform("found", digest)))
    each = rows.select("row", "repo", "owner", F.explode("found").alias("f")).select("row", "repo", "owner", "f.*")
    # distinct holders first, combined where they are: a widely copied secret is no single group
    counts = [F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"), F.count("*").alias("n")]
    spread = materialise(each.groupBy("secret").agg(*counts))
    total = spread.agg(F.sum("n")).first()[0] or 0
    spans = join_counted(each, spread, ["secret"], total).select("row", F.struct("start", "kind", "end", "repos", "owners", ((F.col("owners") <= 1) & (F.col("repos") <= live_repos)).alias("live")).alias("s"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    apart = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    kept = spans.withColumn("base", base).select("row", F.filter("spans", lambda s: (s["kind"] < len(BASE)) | (s["live"] & apart(s))).alias("spans"))
    empty = F.array().cast(kept.schema["spans"].dataType)
    return rows.select("row", "id").join(kept, "row", "left").select("id", F.coalesce("spans", empty).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k.name) for k in [*BASE, LIVE]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
