"""Metrics and scoring: labels, line items and embeddings as scored items."""

from pyspark.sql import functions as F

from sievework.operators import evaluate, scoring
from sievework.operators.centroids import centroid_scores, fit_centroids
from sievework.plans.catalogue import query
from sievework.plans.items import table
from sievework.plans.samples import ITEM_SPLIT_SQL, item_splits
from sievework.session import small_table

FLAGS = ["A", "N", "R"]
LINES_SQL = """lines AS (SELECT l_returnflag AS y_true, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 40 THEN 'N' ELSE 'R' END AS y_pred,
  l_linestatus AS dataset_id FROM lineitem)"""
QUALITY_PAIRS_SQL = """pairs AS (SELECT l.quality AS y_true, 1 - l.toxic AS y_pred, d.source AS dataset_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
REPORT_SQL = """, c AS (SELECT label, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits FROM (
    SELECT y_true AS label, 1 AS support, 0 AS predicted, (y_true = y_pred)::INTEGER AS hits FROM {t}
    UNION ALL SELECT y_pred, 0, 1, 0 FROM {t}) GROUP BY 1),
rep AS (SELECT label, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
  coalesce(2 * hits / nullif(predicted + support, 0), 0) AS f1, support::BIGINT AS support FROM c)"""


def lines(spark, sf_dir):
    guess = F.when(F.col("l_quantity") < 15, "A").when(F.col("l_quantity") < 40, "N").otherwise("R")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("y_true"), guess.alias("y_pred"), F.col("l_linestatus").alias("dataset_id"))


def quality_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset_id"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred"), "dataset_id")


@query(ITEM_SPLIT_SQL + """, t AS (SELECT class_id, count(*) AS n FROM done WHERE split = 'train' GROUP BY 1)
SELECT class_id, n, round((SELECT sum(n) FROM t) / ((SELECT count(*) FROM t) * n), 6) AS weight FROM t""")
def class_weights(spark, sf_dir):
    train = item_splits(spark, sf_dir).filter("split = 'train'")
    return evaluate.class_weights(train).withColumn("weight", F.round("weight", 6))


@query("WITH " + LINES_SQL + " SELECT y_true, " + ", ".join(f"count(*) FILTER (y_pred = '{f}') AS \"pred_{f}\"" for f in FLAGS) + " FROM lines GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(lines(spark, sf_dir), FLAGS)


@query("WITH " + LINES_SQL + REPORT_SQL.format(t="lines") + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep""")
def class_report(spark, sf_dir):
    report = evaluate.class_report(lines(spark, sf_dir))
    return report.withColumns({c: F.round(c, 6) for c in ["precision", "recall", "f1"]})


@query("WITH " + QUALITY_PAIRS_SQL + REPORT_SQL.format(t="pairs") + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep""")
def quality_report(spark, sf_dir):
    report = evaluate.class_report(quality_pairs(spark, sf_dir))
    return report.withColumns({c: F.round(c, 6) for c in ["precision", "recall", "f1"]})


@query("WITH " + LINES_SQL + REPORT_SQL.format(t="lines") + " SELECT round_even(avg(f1), 4)::DOUBLE AS macro_f1 FROM rep")
def macro_f1(spark, sf_dir):
    return evaluate.macro_f1(evaluate.class_report(lines(spark, sf_dir)))


@query("WITH " + QUALITY_PAIRS_SQL + """ SELECT y_true AS class_id, dataset_id, count(*) AS n,
  round_even(count(*) FILTER (y_true = y_pred) / count(*), 3)::DOUBLE AS accuracy FROM pairs
WHERE y_true IN (SELECT y_true FROM pairs GROUP BY 1 HAVING count(DISTINCT dataset_id) >= 2) GROUP BY 1, 2""")
def per_source_accuracy(spark, sf_dir):
    return evaluate.per_source_accuracy(quality_pairs(spark, sf_dir))


CENTROID_SQL = """WITH long AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
cent AS (SELECT label, list(v ORDER BY pos) AS c FROM (SELECT label, pos, round(avg(v), 6) AS v FROM long GROUP BY 1, 2) GROUP BY 1),
dots AS (SELECT e.vec_id, e.label AS truth, c.label AS class_index, exp(40 * list_inner_product(e.embedding::DOUBLE[], c.c)) AS w FROM embeddings e, cent c),
probs AS (SELECT vec_id, truth, class_index, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM dots),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_index) AS place FROM probs)"""


def scored_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return centroid_scores(vectors, fit_centroids(vectors, "label", "embedding"), "embedding", sharpness=40.0)


@query(CENTROID_SQL + """ SELECT vec_id, CAST(place - 1 AS INTEGER) AS place, class_index, round(p, 3) AS confidence FROM ranked WHERE place <= 3""")
def top_k_scores(spark, sf_dir):
    best = scoring.top_k(scored_embeddings(spark, sf_dir), "probs")
    return best.select("vec_id", F.posexplode("top").alias("place", "t"), "probs").select(
        "vec_id", "place", "t.class_index", F.round(F.col("probs")[F.col("t.class_index")], 3).alias("confidence"))


@query(CENTROID_SQL + """, s AS (SELECT vec_id, truth AS y_true, class_index AS y_pred FROM ranked WHERE place = 1)""" + REPORT_SQL.format(t="s") + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep""")
def centroid_report(spark, sf_dir):
    scored = scored_embeddings(spark, sf_dir).select(
        F.col("label").alias("y_true"), scoring.argmax_index(F.col("probs")).alias("y_pred"))
    return evaluate.class_report(scored).withColumns({c: F.round(c, 6) for c in ["precision", "recall", "f1"]})


def nation_taxonomy(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select(F.col("n_name").alias("class_id"), F.lower("r_name").alias("crop"), F.initcap("n_name").alias("name_en"),
                          F.lit("").alias("name_hi"), F.lit(True).alias("in_model"))


@query(CENTROID_SQL + """, named AS (SELECT r.vec_id, r.place, 'NATION_' || r.class_index AS class_id, lower(g.r_name) AS crop, r.p FROM ranked r
  JOIN nation n ON n.n_name = 'NATION_' || r.class_index JOIN region g ON n.n_regionkey = g.r_regionkey WHERE r.place <= 3)
SELECT vec_id, CASE WHEN max(p) FILTER (place = 1) >= 0.35 THEN 'ok' ELSE 'not_sure' END AS status,
  CASE WHEN max(p) FILTER (place = 1) >= 0.35 THEN max(class_id) FILTER (place = 1) END AS top_class,
  CASE WHEN max(p) FILTER (place = 1) >= 0.35 THEN max(crop) FILTER (place = 1) END AS top_crop,
  string_agg(class_id, ',' ORDER BY place) FILTER (place > 1 OR (SELECT max(p) FROM named m WHERE m.vec_id = named.vec_id) < 0.35) AS alternatives,
  CASE WHEN max(p) FILTER (place = 1) < 0.35 THEN 'Not confident enough to name a disease. Try a clearer, closer photo.' END AS message
FROM named GROUP BY vec_id""")
def gated_predictions(spark, sf_dir):
    labels = small_table(spark, [(i, f"NATION_{i}") for i in range(10)], "class_index INT, class_id STRING")
    best = scoring.top_k(scored_embeddings(spark, sf_dir), "probs")
    answers = scoring.gate(scoring.name_alternatives(best, labels, nation_taxonomy(spark, sf_dir)), "vec_id")
    return answers.select("vec_id", "status", F.col("top.class_id").alias("top_class"), F.col("top.crop").alias("top_crop"),
                          F.concat_ws(",", "alternatives.class_id").alias("alternatives"), "message")
