"""Corpus preparation: quality, line dedup, document near-dedup, secret redaction, packing.

Each stage reads all that its predecessor kept; between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, table
from millrace.llm.lines import dedup_lines
from millrace.llm.minhash import near_duplicates
from millrace.llm.packing import pack_documents
from millrace.llm.quality import THRESHOLD, fit, score
from millrace.llm.secrets import scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of dropped documents are broadcast up to this number (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 2_000_000


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier, fitted on the labelled sample, doesn't reject."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select(*COLUMNS), model).filter(F.col("quality_score") >= THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier document's; those left without text go."""
    return _sized(dedup_lines(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each near-duplicate group."""
    scratch = Scratch(spark, "pipeline")
    dropped = scratch.cut(near_duplicates(docs, words=5, percent=80).filter("NOT kept").select("doc_id").distinct())
    small = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if small else dropped, "doc_id", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark."""
    return _sized(scan(docs.select(*COLUMNS), redact=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences in windows."""
    return pack_documents(docs, with_ids=False)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: No stage of this pipeline but the line dedup could be written in SQL; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
