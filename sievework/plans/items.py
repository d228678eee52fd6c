"""The given tables read as a manifest: documents are items, `labels` their source labels.

Every column here has its DuckDB twin in ITEMS_SQL, which the query checks start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.fingerprints import text_fingerprints
from sievework.functions.text import content_hash, stable_id, tokens, words
from sievework.operators.classify import decide, map_labels
from sievework.registry import Dataset, class_map_table, dataset_table, severity_table
from sievework.session import small_table

SOURCES = [f"src{i}" for i in range(20)]
CLASS_MAP = {"good": "DOC_GOOD", "poor": "DOC_POOR", "toxic": "drop", "unlabelled": None}
SEVERITY = {"poor": 1, "toxic": 2}
DATASETS = [Dataset(s, "text", i, CLASS_MAP, SEVERITY, (), (), 1 + i % 3, 40.0 + i) for i, s in enumerate(SOURCES)]
TAXONOMY = [  # class_id, crop, name_en, name_hi, visible_on_leaf, in_model, status
    ("DOC_GOOD", "en", "Good text", "", True, True, "draft"), ("DOC_POOR", "en", "Poor text", "", True, True, "draft"),
    ("DOC_FR", "fr", "French text", "", True, True, "draft"), ("DOC_SPAM", "de", "Spam", "", True, False, "draft"),
    ("DOC_UNKNOWN", "all", "Unknown", "", True, True, "draft")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def taxonomy(spark: SparkSession) -> DataFrame:
    return small_table(spark, TAXONOMY, "class_id STRING, crop STRING, name_en STRING, name_hi STRING, "
                                        "visible_on_leaf BOOLEAN, in_model BOOLEAN, status STRING")


def datasets(spark: SparkSession) -> DataFrame:
    return dataset_table(spark, DATASETS)


def measured_documents(spark: SparkSession, sf_dir: str, prints: bool = False) -> DataFrame:
    """One row per document without its text: everything that is taken from the text, before any join or shuffle.

    With `prints` also phash64, which is NULL for a text without a token. Fingerprints scan the text on their own:
    their tokens cost far more than the scan, and would have to carry the measures along.
    """
    docs = table(spark, sf_dir, "documents")
    mark = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)
    share = F.try_divide(F.lit(100.0) * F.size(tokens(F.col("text"))), F.size(words(F.col("text"))))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    rows = docs.select(
        "doc_id", stable_id(F.lit("corpus"), F.lit("documents"), F.col("doc_id").cast("string")).alias("image_id"),
        F.col("source").alias("dataset_id"), F.col("lang").alias("crop"), F.lit("documents").alias("archive"),
        F.concat(F.col("lang"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("member_path"),
        F.when(mark.isin("0", "1"), "test").when(mark.isin("2", "3"), "valid").when(mark != "f", "train").alias("split_source"),
        content_hash(F.col("text")).alias("sha256"), F.col("n_chars").cast("int").alias("width"), lines.alias("height"),
        F.when(F.octet_length("text") == F.length("text"), "L").otherwise("RGB").alias("mode"),
        (F.octet_length("text") == F.length("text")).alias("is_grayscale"),
        F.octet_length("text").cast("bigint").alias("file_bytes"), F.bround(share, 1).alias("sharpness_256"),
        F.bround(F.try_divide(F.lit(255.0) * blanks, F.length("text")), 1).alias("brightness"))
    return rows.join(text_fingerprints(docs, "doc_id", "text"), "doc_id", "left") if prints else rows


def items(spark: SparkSession, sf_dir: str, prints: bool = False) -> DataFrame:
    """Manifest rows before quality, overrides and duplicates; columns not asked for cost nothing."""
    rows = measured_documents(spark, sf_dir, prints).join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn(
        "source_label", F.when(F.col("quality").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic")
        .when(F.col("quality") == 1, "good").otherwise("poor")).drop("quality", "toxic")
    mapped = map_labels(rows, class_map_table(spark, DATASETS), severity_table(spark, DATASETS))
    none = F.lit(None).cast("string")
    verdict = decide(F.col("mapped"), F.col("target"), F.lit(True), none, F.lit(True))
    return mapped.withColumns(verdict).withColumns({"duplicate_of": none, "dup_group": none, "error_detail": none}).drop(
        "mapped", "target")


ITEMS_SQL = r"""
raw AS (
  SELECT d.doc_id, substr(sha1('corpus|documents|' || d.doc_id), 1, 16) AS image_id, d.source AS dataset_id,
    d.lang AS crop, 'documents' AS archive, d.lang || '/' || lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS member_path,
    CASE WHEN substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 1) IN ('0','1') THEN 'test'
         WHEN substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 1) IN ('2','3') THEN 'valid'
         WHEN substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 1) <> 'f' THEN 'train' END AS split_source,
    CASE WHEN l.quality IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good'
         ELSE 'poor' END AS source_label,
    sha256(d.text) AS sha256, CAST(d.n_chars AS INTEGER) AS width,
    CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS INTEGER) AS height,
    CAST(octet_length(encode(d.text)) AS BIGINT) AS file_bytes, length(d.text) AS n_text,
    length(d.text) - length(replace(d.text, ' ', '')) AS blanks,
    list_filter(string_split_regex(lower(d.text), '\s+'), lambda t: t <> '') AS words, d.text,
    CAST(substr(d.source, 4) AS INTEGER) AS priority
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), items AS (
  SELECT * EXCLUDE (words, n_text, blanks),
    CASE WHEN file_bytes = n_text THEN 'L' ELSE 'RGB' END AS mode, file_bytes = n_text AS is_grayscale,
    CAST(round_even(100.0 * len(list_distinct(words)) / nullif(len(words), 0), 1) AS DOUBLE) AS sharpness_256,
    CAST(round_even(255.0 * blanks / nullif(n_text, 0), 1) AS DOUBLE) AS brightness,
    CASE source_label WHEN 'poor' THEN 1 WHEN 'toxic' THEN 2 END AS severity,
    CASE source_label WHEN 'toxic' THEN 'exclude' WHEN 'unlabelled' THEN 'hold' ELSE 'use' END AS status,
    CASE source_label WHEN 'toxic' THEN 'class_dropped' WHEN 'unlabelled' THEN 'pending_taxonomy' END AS reason,
    CASE source_label WHEN 'good' THEN 'DOC_GOOD' WHEN 'poor' THEN 'DOC_POOR' END AS class_id
  FROM raw
)"""

# 64 votes per text from the md5 of its distinct tokens, packed to a signed LONG
FINGERPRINTS_SQL = r"""
toks AS (
  SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> ''))) AS t
  FROM documents
), hashed AS (
  SELECT doc_id, CAST('0x' || substr(md5(t), 1, 16) AS UBIGINT) AS h FROM toks
), votes AS (
  SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v
  FROM hashed, (SELECT CAST(range AS UBIGINT) AS i FROM range(64)) GROUP BY doc_id, i
), fps AS (
  SELECT doc_id, CAST(sum(CASE WHEN v <= 0 THEN 0 WHEN i = 63 THEN -9223372036854775808::HUGEINT
                               ELSE 1::HUGEINT << CAST(i AS INTEGER) END) AS BIGINT) AS phash64
  FROM votes GROUP BY doc_id
)"""
