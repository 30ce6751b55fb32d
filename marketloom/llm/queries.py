"""The registered queries of this subpackage: thin forms of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.alignment import align_tokenizers
from marketloom.llm.brown import class_scores
from marketloom.llm.decontamination import contamination
from marketloom.llm.fingerprints import edited_fingerprints, likeness, printed
from marketloom.llm.lines import dedup_lines
from marketloom.llm.packing import pack
from marketloom.llm.prefixes import end_digests, ordered_turns, prefix_trie, rebuilt
from marketloom.llm.quality import fit_quality, is_held_out
from marketloom.llm.secrets import BASE, scan_secrets, span_text
from marketloom.llm.shared import materialise, table
from marketloom.llm.simhash import simhash_components
from marketloom.llm.substrings import remove_repeats
from marketloom.llm.topk import top_k
from marketloom.llm.viterbi import count_tokens


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository of its own here and its source is the owner."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        F.col("id").alias("doc_id"),
        *(of(i).alias(f"n_{kind.name}") for i, kind in enumerate(BASE)),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        of(len(BASE)).alias("n_live"),
        F.size(F.filter("spans", lambda s: s["owners"] > 1)).cast("long").alias("n_copied"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumnRenamed("id", "doc_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "substring_dedup.n_words", "substring_dedup.n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_class_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", "places")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", is_held_out("doc_id").alias("held_out"), model.column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        printed(F.col("fingerprint")).alias("fingerprint"),
        printed(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = rebuilt(materialise(ordered_turns(table(spark, sf_dir, "conversations"))))
    trie = prefix_trie(materialise(turns), convs)
    digests = trie.nodes.join(end_digests(trie.ends), ["conv_id", "depth"], "left")
    ends = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return digests.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), ends)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = align_tokenizers(table(spark, sf_dir, "documents"), *models)
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_class_lm_scores": op6_class_lm_scores,
    "op7_decontamination": op7_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_alignment": op13_token_alignment,
}

#: Matches and the pieces between them alternate, so that their lengths give each match's place.
_KIND = """
  SELECT doc_id, source, {kind} AS kind, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {group}) AS secret,
         string_split_regex(t, '{pattern}') AS gap FROM texts"""
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [(0, _ASSIGN, 2), (1, "AKIA[A-Z0-9]+", 0), (2, "[0-9a-f]{24,}", 0), (3, "[A-Za-z0-9+/_-]{20,}", 0)]
_SPAN = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'live' END || ':' || start || ':' || stop"

ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": f"""
        WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        found AS ({" UNION ALL ".join(_KIND.format(kind=k, pattern=p, group=g) for k, p, g in _KINDS)}),
        each AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found WHERE len(whole) > 0),
        spans AS (
          SELECT doc_id, source, kind, secret[i] AS secret, whole[i] AS whole,
            CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
          FROM each),
        kept AS (
          SELECT *, start + length(whole) AS stop FROM spans
          WHERE CASE kind WHEN 0 THEN length(secret) >= 6 WHEN 1 THEN length(secret) >= 20 WHEN 2 THEN length(secret) >= 24
            ELSE regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Z]') AND regexp_matches(secret, '[a-z]') END),
        spread AS (SELECT secret, count(DISTINCT doc_id) AS repos, count(DISTINCT source) AS owners FROM kept GROUP BY secret),
        final AS (
          SELECT k.*, owners FROM kept k JOIN spread USING (secret)
          WHERE kind < 3 OR (owners <= 1 AND repos <= 1 AND NOT EXISTS (
            SELECT 1 FROM kept b WHERE b.doc_id = k.doc_id AND b.kind < 3 AND b.start < k.stop AND k.start < b.stop)))
        SELECT t.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
          sha256(coalesce(string_agg({_SPAN}, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
          coalesce(string_agg({_SPAN}, ',' ORDER BY start, kind), '') AS spans, count(*) FILTER (kind = 3) AS n_live,
          count(*) FILTER (owners > 1) AS n_copied
        FROM texts t LEFT JOIN final f ON f.doc_id = t.doc_id GROUP BY t.doc_id
    """,
    "op1_exact_top_k": """
        WITH vectors AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        components AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM vectors),
        scores AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
          FROM components q JOIN components c ON q.i = c.i AND q.vec_id <> c.vec_id
          WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, c.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
    """,
    "op4_line_dedup": """
        WITH lines AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
          FROM documents),
        keyed AS (
          SELECT doc_id, pos, line,
                 translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM lines),
        shared AS (
          SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
          GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines,
               count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                      FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM keyed LEFT JOIN shared USING (key) GROUP BY doc_id
    """,
    "op5_substring_dedup": r"""
        WITH texts AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        starts AS (
          SELECT doc_id, unnest(range(1, len(words) - 33)) AS p FROM texts WHERE len(words) >= 35),
        windows AS (
          SELECT doc_id, p, md5(array_to_string(words[p:p + 34], ' ')) AS key FROM starts JOIN texts USING (doc_id)),
        again AS (SELECT key FROM windows GROUP BY key HAVING count(*) > 1),
        covered AS (
          SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS pos FROM windows JOIN again USING (key)),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM texts),
        kept AS (
          SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS body
          FROM each ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(body, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)
    """,
    "op12_prefix_trie": """
        WITH own AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
        lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM own GROUP BY conv_id),
        -- crc32 of the decimal digits, bit by bit
        crcs AS (
          SELECT conv_id, xor(list_reduce([CAST(x AS BIGINT) FOR x IN list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: ascii(d)))],
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])),
              lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295) % 9 AS h
          FROM lists),
        convs AS (
          SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), c.turns[h + 1:]) AS turns
          FROM lists c JOIN crcs USING (conv_id) LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 5),
        paths AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM convs),
        members AS (SELECT conv_id AS member, depth, turns[1:depth] AS path, len(turns) = depth AS ends FROM paths),
        nodes AS (
          SELECT path, depth, min(member) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) FILTER (ends), '')) AS ends_sha256
          FROM members GROUP BY path, depth),
        linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]),
        sizes AS (
          SELECT l.*, (SELECT count(*) FROM linked c WHERE c.depth = l.depth + 1 AND c.parent_conv_id = l.conv_id) AS n_children,
            CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(path[depth].text)) END AS saved
          FROM linked l),
        above AS (SELECT path[1:unnest(range(depth + 1))] AS path, unnest(range(depth + 1)) AS depth, n_children, saved FROM sizes),
        sums AS (SELECT path, depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path, depth)
        SELECT conv_id, s.depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
        FROM sizes s JOIN sums u ON u.depth = s.depth AND u.path = s.path
    """,
}
