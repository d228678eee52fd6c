"""The registered queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import table
from sievework.plans.catalogue import Query
from sievework.session import shared_folder

QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def register(plan):
        QUERIES[plan.__name__] = Query(plan, sql)
        return plan
    return register


@query()
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.byte_bpe import encode_table
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_table(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""


@query(OP8_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.warc import read_archives, write_pages
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.simhash import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


OP5_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS node, vec_id AS origin FROM embeddings UNION SELECT p.b, r.origin FROM reach r JOIN pairs p ON p.a = r.node
), lowest AS (SELECT node, min(origin) AS component_id FROM reach GROUP BY 1),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY 1)
SELECT l.node AS vec_id, coalesce(k.n, 0) AS n_links, l.component_id, l.node = l.component_id AS kept FROM lowest l LEFT JOIN links k ON l.node = k.a
"""


@query(OP5_SQL)
def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.cross_polytope import near_duplicate_vectors
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op9_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.pruned_graph import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query()
def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.line_crf import fit_quality, held_out, score_documents
    docs = table(spark, sf_dir, "documents")
    crf = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), crf)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query()
def op1_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.pii import EKINDS, find_spans, fit_tagger
    docs = table(spark, sf_dir, "documents")
    found = find_spans(docs, fit_tagger(docs))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def written(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, EKINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


@query()
def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.training_order import read_shards, write_shards
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    write_shards(table(spark, sf_dir, "documents"), folder, ranks, public_tokenizers.PATTERN, end_id=50256, seq_len=256,
                 shard_rows=32768, key=20240229)
    return read_shards(spark, folder, seq_len=256, shard_rows=32768)


@query()
def op7_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.licenses import scan_table
    found = scan_table(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("matches").cast("bigint").alias("n_matches"),
        F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("coverage"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])), ",").alias("spans"))


@query()
def op11_pointer_jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.alignment import cross_align
    return cross_align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                       public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op12_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.toxicity import fit_toxicity, held_out, score_toxicity
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


OP13_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


@query(OP13_SQL)
def op13_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.hard_negatives import hard_negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
