"""The corpus pipeline: quality, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import table
from sievework.llm.line_crf import fit_quality, score_documents
from sievework.llm.packing import pack_documents
from sievework.llm.pii import fit_tagger, redact
from sievework.llm.simhash import distinct_documents
from sievework.session import shared_folder

GOOD = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose lines the field finds bad. It is fitted on a bounded sample of the labelled rows of docs.

    Null texts count as empty ones, which score as an empty line does; repeated rows and rows without an id are decided alike;
    without labelled rows every score is 0.5 and no document stays. An empty table gives an empty one.
    """
    crf = fit_quality(docs, table(spark, sf_dir, "labels"))
    score = "_score"
    while score in docs.columns:
        score += "_"
    return score_documents(docs, crf, score_col=score).filter(F.col(score) >= GOOD).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near-duplicates: that with the smallest id, rows without an id last.

    Decisions are made for rows: a text of its own stays whatever other rows share its id, of equal rows one stays, and rows
    without an id are treated alike. Null and empty texts are one group. An empty table gives an empty one.
    """
    return distinct_documents(docs).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts; n_chars follows the new text.

    Null texts stay null, repeated rows and rows without an id are masked alike, very long texts are read in windows. An
    empty table gives an empty one.
    """
    masked = redact(docs, fit_tagger(docs))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint")))
    return masked.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset.

    A null or empty text is one piece with the end id; repeated rows are packed as often as they occur, rows without an id
    too; very long texts are cut into whole sequences and a rest. An empty table gives an empty one.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

# The fitted models have no SQL form; tests compare the run with the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
