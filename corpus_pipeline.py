"""From raw documents to packed training sequences, one operator a stage.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.decontamination import is_contaminated
from marketloom.llm.lines import dedup_lines
from marketloom.llm.near import near_duplicates
from marketloom.llm.packing import pack
from marketloom.llm.quality import fit_quality
from marketloom.llm.shared import shared_folder, table, written
from marketloom.llm.simhash import simhash_components


def _free(docs: DataFrame, name: str) -> str:
    """The name, or one like it that docs has not (names differ by more than case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go; null texts are scored as empty ones, repeated rows alike."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.column(F.col("text")) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them; n_chars follows the text.

    A null text becomes an empty one; a document whose every line goes stays with an empty text. A text
    of any length is cut in one task; rows of one id are one document for the counts; all columns are passed on,
    whatever their names; an empty table stays empty.
    """
    stats = _free(docs, "line_dedup")
    return dedup_lines(docs, stats_col=stats).drop(stats).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest id.

    Rows are linked by their SimHash fingerprints, as ``op10_simhash_near_dedup`` finds them in BK-trees. As three
    bits of 64 leave out many contiguous edits and short texts, those that share 0.8 of their five-word shingles
    are linked besides. Rows of one id are rows of their own: each is judged by its text. Among equal ids the first
    row written stays; rows without an id stay only where their group has no id. Texts are compared whole,
    whatever their length; all columns are passed on, whatever their names; an empty table stays empty.
    """
    row = _free(docs, "near_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    prints = simhash_components(rows, id_col=row)
    found = near_duplicates(rows, id_col=row, classes=prints).join(rows.select(F.col(row).alias("id"), "doc_id"), "id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("first")
    kept = found.groupBy("component").agg(first).select(F.col("first.id").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; null and empty texts hold none and stay."""
    return docs.where(~is_contaminated(table(spark, sf_dir, "benchmark"), F.col("text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence; a null or empty text is one piece, each repeated row has its own."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The stages learn models, hash and tokenize: SQL cannot express them. Tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{at}")
            docs = spark.read.parquet(f"{folder}/{at}")
    return docs
