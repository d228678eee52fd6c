"""Seeded samples, splits and folds. DuckDB repeats them because the order is md5(seed|id)."""

from pyspark.sql import functions as F

from sievework.operators import sampling, splits
from sievework.operators.ranks import first_per_group
from sievework.plans.catalogue import query
from sievework.plans.items import table
from sievework.plans.staged import STAGED_SQL, staged
from sievework.session import cut_lineage

SEED = 20240501
SPLIT_SQL = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s1, s2 ORDER BY md5('20240501|' || id), id) AS r, count(*) OVER (PARTITION BY s1, s2) AS n FROM src
), sized AS (
  SELECT *, CASE WHEN n >= 3 THEN least(greatest(1, round_even(n * 0.1, 0)), n - 1) ELSE 0 END AS n_val FROM ranked
), cut AS (
  SELECT *, CASE WHEN n - n_val >= 2 THEN least(greatest(1, round_even(n * 0.1, 0)), n - n_val - 1) ELSE 0 END AS n_test FROM sized
)"""
ORDERS_SRC = "src AS (SELECT o_orderkey AS id, o_orderpriority AS s1, o_orderstatus AS s2 FROM orders)"
ITEMS_SRC = "src AS (SELECT image_id AS id, dataset_id AS s1, class_id AS s2 FROM staged WHERE status = 'use')"
CAPS = {("5-LOW", "O"): 500, ("1-URGENT", "P"): 100}


@query("WITH " + ORDERS_SRC + "," + SPLIT_SQL + """ SELECT id AS o_orderkey, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'val'
  WHEN (s1 = '5-LOW' AND s2 = 'O' AND r - n_test - n_val > 500) OR (s1 = '1-URGENT' AND s2 = 'P' AND r - n_test - n_val > 100)
  THEN 'unused' ELSE 'train' END AS split FROM cut""")
def capped_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return splits.stratified_split(orders, SEED, ["o_orderpriority", "o_orderstatus"], "o_orderkey", CAPS).select("o_orderkey", "split")


def item_splits(spark, sf_dir):
    # written once: ranking reads its input twice
    use = cut_lineage(staged(spark, sf_dir).filter("status = 'use'").select("doc_id", "image_id", "dataset_id", "class_id"))
    return splits.stratified_split(use, SEED)


@query("WITH " + STAGED_SQL + """, src AS (SELECT image_id AS id, split_source AS s1, crop AS s2 FROM staged),""" + SPLIT_SQL + """
SELECT id AS image_id, s1 AS split_source, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'val'
  WHEN s1 IS NULL AND s2 = 'en' AND r - n_test - n_val > 3 THEN 'unused' ELSE 'train' END AS split FROM cut""")
def split_by_origin(spark, sf_dir):
    """Strata by the split a source came with, which many items lack: NULL is a stratum, and may be capped."""
    rows = cut_lineage(staged(spark, sf_dir).select("image_id", "split_source", "crop"))
    done = splits.stratified_split(rows, SEED, ["split_source", "crop"], caps={(None, "en"): 3})
    return done.select("image_id", "split_source", "split")


ITEM_SPLIT_SQL = "WITH " + STAGED_SQL + "," + ITEMS_SRC + "," + SPLIT_SQL + """, done AS (
  SELECT id AS image_id, s1 AS dataset_id, s2 AS class_id,
    CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM cut)"""


@query(ITEM_SPLIT_SQL + " SELECT image_id, dataset_id, class_id, split FROM done")
def stratified_split(spark, sf_dir):
    return item_splits(spark, sf_dir).drop("doc_id")


@query(ITEM_SPLIT_SQL + """ SELECT d.image_id, len(e.embedding)::INTEGER AS dims, d.split, d.class_id, d.dataset_id FROM done d
JOIN items i ON i.image_id = d.image_id JOIN embeddings e ON e.vec_id = i.doc_id WHERE d.split <> 'unused'""")
def feature_rows(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return item_splits(spark, sf_dir).filter("split <> 'unused'").join(vectors, "doc_id").select(
        "image_id", F.size("embedding").alias("dims"), "split", "class_id", "dataset_id")


@query(ITEM_SPLIT_SQL + """ SELECT class_id, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
  count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'unused') AS unused FROM done GROUP BY 1""")
def split_counts(spark, sf_dir):
    return splits.split_counts(item_splits(spark, sf_dir))


@query("""SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('20240501|' || vec_id), vec_id) - 1) % 5 AS INTEGER) AS fold
FROM embeddings""")
def stratified_folds(spark, sf_dir):
    return splits.stratified_folds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), 5, SEED, "label", "vec_id")


@query("WITH " + STAGED_SQL + """, pool AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, source_label ORDER BY md5('7|' || image_id), image_id) AS rn
  FROM staged WHERE status = 'use' AND source_label <> '')
SELECT image_id, dataset_id, source_label FROM pool WHERE rn <= CASE WHEN dataset_id = 'src3' AND source_label = 'good' THEN 10
  WHEN dataset_id = 'src5' AND source_label = 'good' THEN 2 ELSE 4 END""")
def audit_sample(spark, sf_dir):
    exceptions = {("src3", "good"): 10, ("src5", "good"): 2}
    return sampling.audit_sample(staged(spark, sf_dir), 4, exceptions, 7).select("image_id", "dataset_id", "source_label")


@query("""SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY md5('0|' || l_orderkey || '-' || l_linenumber || '-' || l_partkey), l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS rn
  FROM lineitem) WHERE rn <= 300""")
def sample_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"))
    return sampling.sample_per_group(rows, ["l_returnflag", "l_linestatus"], "id", 300, 0).drop("id")


@query("""SELECT o_orderpriority, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 12""")
def top_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return first_per_group(rows, ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 12)
