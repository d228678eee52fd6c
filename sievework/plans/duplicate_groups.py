"""Exact and near duplicates of the documents, after quality rules and reviewer decisions."""

from pyspark.sql import functions as F

from sievework.functions.fingerprints import hamming, text_fingerprints
from sievework.operators import duplicates, profile
from sievework.operators.near_duplicates import leader_links
from sievework.operators.ranks import dense_ids
from sievework.operators.skew import left_join_weighted
from sievework.plans.catalogue import query
from sievework.plans.items import FINGERPRINTS_SQL, ITEMS_SQL, items, table
from sievework.plans.staged import CURATED_SQL, curated
from sievework.session import cut_lineage


def report(spark, sf_dir):
    return duplicates.duplicate_report(curated(spark, sf_dir).groups)


@query("WITH " + ITEMS_SQL + """, f AS (SELECT sha256, min(image_id) AS kept, count(*) AS n FROM items GROUP BY 1 HAVING count(*) > 1)
SELECT i.image_id, f.kept AS duplicate_of FROM items i JOIN f ON i.sha256 = f.sha256 WHERE i.image_id <> f.kept""")
def exact_duplicates(spark, sf_dir):
    rows = cut_lineage(items(spark, sf_dir).select("image_id", "sha256"))
    first = rows.groupBy("sha256").agg(F.min("image_id").alias("duplicate_of"), F.count("*").alias("n")).filter("n > 1")
    return left_join_weighted(rows, first, "sha256", "n").filter(F.col("image_id") != F.col("duplicate_of")).select(
        "image_id", "duplicate_of")


@query(CURATED_SQL + """ SELECT n.fp AS phash64, l.fp AS leader_phash64, bit_count(xor(n.fp, l.fp))::INTEGER AS distance
FROM walk w JOIN nodes n ON w.rank = n.rank JOIN nodes l ON w.leader_rank = l.rank WHERE w.rank <> w.leader_rank""")
def near_duplicate_links(spark, sf_dir):
    links = curated(spark, sf_dir).links.filter(F.col("phash64") != F.col("leader_phash64"))
    return links.select("phash64", "leader_phash64", hamming(F.col("phash64"), F.col("leader_phash64")).alias("distance"))


@query("WITH RECURSIVE " + FINGERPRINTS_SQL + """, nodes AS MATERIALIZED (SELECT phash64 AS fp, row_number() OVER (ORDER BY min(doc_id)) AS rank FROM fps GROUP BY 1),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rank, CAST([] AS STRUCT(r BIGINT, fp BIGINT)[]) AS leaders, CAST(NULL AS BIGINT) AS leader_rank
  UNION ALL
  SELECT rank, CASE WHEN hit IS NULL THEN list_append(leaders, {'r': rank, 'fp': fp}) ELSE leaders END, coalesce(hit, rank)
  FROM (SELECT n.rank, n.fp, w.leaders, list_filter(w.leaders, lambda x: bit_count(xor(x.fp, n.fp)) <= 6)[1].r AS hit
    FROM walk w JOIN nodes n ON n.rank = w.rank + 1)
) SELECT rank, leader_rank FROM walk WHERE rank <> leader_rank""")
def wide_near_copies(spark, sf_dir):
    """Leaders at distance 6, over all documents in id order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = text_fingerprints(docs, "doc_id", "text").groupBy("phash64").agg(F.min("doc_id").alias("first"))
    nodes = dense_ids(prints, ["first"], "rank").select(F.col("phash64").alias("fp"), "rank")
    return leader_links(nodes, 6)


@query(CURATED_SQL + " SELECT dup_group, size, outcome, label_conflict, datasets, cross_dataset, cross_split, canonical, labels FROM report")
def duplicate_report(spark, sf_dir):
    return report(spark, sf_dir)


@query(CURATED_SQL + " SELECT image_id, status, reason, class_id, duplicate_of, dup_group FROM curated")
def curated_manifest(spark, sf_dir):
    return curated(spark, sf_dir).manifest.select("image_id", "status", "reason", "class_id", "duplicate_of", "dup_group")


@query(CURATED_SQL + " SELECT dup_group, image_id, dataset_id, source_label FROM curated WHERE dup_group IS NOT NULL")
def duplicate_members(spark, sf_dir):
    return duplicates.duplicate_members(curated(spark, sf_dir).manifest)


@query(CURATED_SQL + """ SELECT count(*) AS dup_groups, coalesce(sum(size), 0)::BIGINT AS items, count(*) FILTER (cross_dataset) AS cross_dataset,
  count(*) FILTER (cross_split) AS cross_split, count(*) FILTER (label_conflict) AS label_conflict,
  count(*) FILTER (outcome = 'copies_of_rejected') AS copies_of_rejected FROM report""")
def duplicate_totals(spark, sf_dir):
    return duplicates.duplicate_totals(report(spark, sf_dir))


@query(CURATED_SQL + " SELECT datasets, count(*) AS dup_groups FROM report WHERE cross_dataset GROUP BY 1")
def cross_dataset_pairs(spark, sf_dir):
    return duplicates.cross_dataset_pairs(report(spark, sf_dir))


@query(CURATED_SQL + """ SELECT dup_group, size, cross_dataset, cross_split FROM report WHERE cross_dataset OR cross_split""")
def leakage_groups(spark, sf_dir):
    return report(spark, sf_dir).filter("cross_dataset OR cross_split").select("dup_group", "size", "cross_dataset", "cross_split")


@query(CURATED_SQL + """ SELECT dataset_id, source_label, count(*) AS removed FROM curated WHERE reason IN ('exact_duplicate', 'near_duplicate')
GROUP BY 1, 2 ORDER BY removed DESC, dataset_id, source_label LIMIT 15""")
def most_removed(spark, sf_dir):
    return profile.most_removed(curated(spark, sf_dir).manifest)


@query(CURATED_SQL + """ SELECT labels, count(*) AS dup_groups FROM report WHERE label_conflict GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def conflict_label_sets(spark, sf_dir):
    return profile.conflict_label_sets(report(spark, sf_dir))


@query(CURATED_SQL + """ SELECT coalesce(dataset_id, 'Total') AS dataset_id, count(*) FILTER (status = 'use') AS "use", count(*) FILTER (status = 'hold') AS hold,
  count(*) FILTER (status = 'exclude') AS exclude, count(*) AS total FROM curated GROUP BY ROLLUP (dataset_id)""")
def curated_status(spark, sf_dir):
    return profile.status_by_dataset(curated(spark, sf_dir).manifest)
