"""Probes, PCA and head training.

Results of fitted models have no SQL twin: the queries that return them are checked in the tests. Beside each stands a query
on the same result that SQL can check: identities that only the right components fulfil, and scores against chance.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from sievework.operators import heads, probes
from sievework.operators.evaluate import class_report, confusion_counts
from sievework.operators.profile import with_shape
from sievework.operators.scoring import top_k
from sievework.operators.splits import stratified_split
from sievework.plans.catalogue import query
from sievework.plans.items import table
from sievework.plans.samples import SEED, SPLIT_SQL
from sievework.plans.staged import STAGED_SQL, staged
from sievework.session import cut_lineage

LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñíóáú"
# The last byte of each letter, whether another stands before it, and the bytes of a text that are counted at once.
CODES = np.array([c.encode()[-1] for c in LETTERS])
WIDE = np.array([len(c.encode()) == 2 for c in LETTERS])
CHUNK = 1 << 20


def counted_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text in lower case, becomes the shares of LETTERS in it: one pass over its UTF-8 bytes for all letters.

    Every letter is one byte, or two of which the first is 0xC3, a byte that only begins characters.
    """
    for batch in batches:
        shares = np.zeros((batch.num_rows, len(LETTERS)))
        for row, text in enumerate(batch.column(batch.num_columns - 1)):
            ones, twos = np.zeros(256, np.int64), np.zeros(256, np.int64)
            data = np.frombuffer(text.as_buffer(), np.uint8)
            for start in range(0, len(data), CHUNK):
                part = data[start:start + CHUNK + 1]  # with the byte that ends a character begun in the chunk
                own = part[:CHUNK]
                ones += np.bincount(own, minlength=256)
                twos += np.bincount(part[1:][own[:len(part) - 1] == 0xC3], minlength=256)
            size = ones.sum() - ones[0x80:0xC0].sum()
            if size:
                shares[row] = np.where(WIDE, twos[CODES], ones[CODES]) / size
        column = pa.FixedSizeListArray.from_arrays(pa.array(shares.ravel()), len(LETTERS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*batch.schema.names[:-1], "features"])


def letter_shares(spark, sf_dir, *more):
    """(doc_id, features, and the columns of `more`): how large a share of a text each letter has, measured in the scan of the text."""
    low = F.lower(F.coalesce("text", F.lit("")))
    texts = table(spark, sf_dir, "documents").select("doc_id", *more, low.alias("_low"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1]) + ", features ARRAY<DOUBLE>"
    return texts.mapInArrow(counted_letters, schema)


def featured_items(spark, sf_dir):
    """Usable documents with their letter shares; the language plays the source."""
    use = with_shape(staged(spark, sf_dir).filter("status = 'use'")).join(letter_shares(spark, sf_dir), "doc_id")
    return use.withColumns({"dataset_id": F.col("crop"), "crop": F.lit("text")})


@query("WITH " + STAGED_SQL + """ SELECT s.image_id, s.class_id, len(e.embedding)::INTEGER AS dims FROM staged s
JOIN embeddings e ON s.doc_id = e.vec_id WHERE s.status = 'use'""")
def items_with_features(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return staged(spark, sf_dir).filter("status = 'use'").join(vectors, "doc_id").select("image_id", "class_id", F.size("embedding").alias("dims"))


@query()
def pca_variance(spark, sf_dir):
    """The share of the variance that each of 50 components explains."""
    model, _ = probes.principal_components(table(spark, sf_dir, "embeddings"), "embedding", 50)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.explainedVariance.toArray())], "component INT, share DOUBLE")


@query("""WITH RECURSIVE x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
v AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS v FROM x),
cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / (count(*) - 1) AS s FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY 1, 2),
m AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM cov GROUP BY i)),
power AS (
  SELECT 0 AS n, list_transform(m, lambda r, k: 1.0::DOUBLE / k) AS w, 0.0::DOUBLE AS largest FROM m
  UNION ALL
  SELECT n + 1, list_transform(m, lambda r: list_dot_product(r, u)), list_dot_product(u, list_transform(m, lambda r: list_dot_product(r, u)))
  FROM (SELECT n, list_transform(w, lambda t: t / sqrt(list_dot_product(w, w))) AS u FROM power WHERE n < 2000), m)
SELECT (SELECT len(m) FROM m)::INTEGER AS components, true AS orthonormal, round(sum(s) FILTER (i = j), 6) AS total_variance,
  round(sum(s * s), 6) AS sum_of_squares, (SELECT round(largest, 6) FROM power WHERE n = 2000) AS largest FROM cov""")
def pca_basis(spark, sf_dir):
    """All components: they are orthonormal, the variances they explain add up to those of the vectors, their squares to
    those of the covariances, and the largest is what power iteration finds."""
    vectors = table(spark, sf_dir, "embeddings")
    size = vectors.agg(F.max(F.size("embedding"))).first()[0]
    model, _ = probes.principal_components(vectors, "embedding", size)
    basis, shares = model.pc.toArray(), model.explainedVariance.toArray()
    variance = probes.with_vectors(vectors, "embedding").agg(vector_to_array(Summarizer.variance(F.col("vec"))).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return variance.select(
        F.lit(basis.shape[1]).alias("components"), F.lit(bool(abs(basis.T @ basis - np.eye(size)).max() < 1e-6)).alias("orthonormal"),
        F.round(total, 6).alias("total_variance"), F.round(total * total * float(np.square(shares).sum()), 6).alias("sum_of_squares"),
        F.round(total * float(shares[0]), 6).alias("largest"))


@query()
def pca_projection(spark, sf_dir):
    """All vectors on 50 components."""
    _, rows = probes.principal_components(table(spark, sf_dir, "embeddings"), "embedding", 50)
    return rows.select("vec_id", "label", "components")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS squared_length FROM embeddings")
def pca_lengths(spark, sf_dir):
    """On all components a vector keeps its length."""
    vectors = table(spark, sf_dir, "embeddings")
    _, rows = probes.principal_components(vectors, "embedding", vectors.agg(F.max(F.size("embedding"))).first()[0])
    return rows.select("vec_id", F.round(F.aggregate("components", F.lit(0.0), lambda s, x: s + x * x), 5).alias("squared_length"))


FEATURED_SQL = "WITH " + STAGED_SQL + """, emb AS (SELECT image_id, class_id, crop AS dataset_id, 'text' AS crop FROM staged WHERE status = 'use'),
tasks AS (SELECT 'class_by_metadata' AS probe, crop AS scope, class_id AS label FROM emb UNION ALL SELECT 'class_by_features', crop, class_id FROM emb
  UNION ALL SELECT 'source_by_features', class_id, dataset_id FROM emb),
n AS (SELECT probe, scope, label, count(*) AS n FROM tasks WHERE scope IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER (PARTITION BY probe, scope) AS total FROM n)"""


@query()
def shortcut_report(spark, sf_dir):
    """How well metadata and features tell the class, and features the source within a class."""
    return probes.shortcut_report(featured_items(spark, sf_dir))


@query(FEATURED_SQL + """ SELECT probe, scope, string_agg(label || ' ' || printf('%.3f', round_even(n / total, 3)), ', ' ORDER BY n DESC, label) AS note,
  count(*) AS labels, round(max(n) / any_value(total), 6) AS majority_share, true AS above_chance FROM t GROUP BY 1, 2 HAVING count(*) > 1""")
def shortcut_scores(spark, sf_dir):
    """Every linear probe beats the macro-F1 of always naming the most frequent label by 0.05: 2 s / (1 + s) / labels, s its
    share. Forests on metadata need no more than that macro-F1."""
    rows = cut_lineage(featured_items(spark, sf_dir).select("crop", "class_id", "dataset_id", "image_id", "features", *probes.METADATA))
    report = probes.shortcut_report(rows)
    shares = []
    for p in probes.probe_table():
        counts = rows.filter(F.col(p.scope).isNotNull() & F.col(p.label).isNotNull()).groupBy(F.col(p.scope).alias("scope"), p.label).count()
        shares.append(counts.groupBy("scope").agg(F.count("*").alias("labels"), (F.max("count") / F.sum("count")).alias("share")).select(
            F.lit(p.name).alias("probe"), "scope", "labels", "share", F.lit(0.0 if p.make else 0.05).alias("more")))
    chance = 2 * F.col("share") / (1 + F.col("share")) / F.col("labels")
    joined = report.join(shares[0].union(shares[1]).union(shares[2]), ["probe", "scope"])
    return joined.select("probe", "scope", "note", "labels", F.round("share", 6).alias("majority_share"),
                         (F.col("macro_f1") >= F.round(chance, 3) + F.col("more")).alias("above_chance"))


HEAD_SQL = "WITH src AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'documents' AS s1, lang AS s2 FROM documents)," + SPLIT_SQL + """, held AS (
  SELECT id, s2 AS label, CASE WHEN r <= n_test THEN 'test' ELSE 'val' END AS split FROM cut WHERE r <= n_test + n_val)"""


def head_scores(spark, sf_dir):
    """Scores of the held-out documents, written once: the language from the shares of letters."""
    rows = letter_shares(spark, sf_dir, "lang").filter("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("string").alias("image_id"), F.lit("documents").alias("dataset_id"), F.col("lang").alias("class_id"), "features")
    rows = cut_lineage(stratified_split(cut_lineage(rows), SEED))
    head = heads.train_head(rows, steps=2, rate=0.02, epochs=15)
    return cut_lineage(heads.score_head(rows.filter(F.col("split").isin("val", "test")), head))


@query()
def head_report(spark, sf_dir):
    """Precision, recall and F1 of each class on the held-out rows."""
    return class_report(head_scores(spark, sf_dir), truth="class_id", by=["split"])


@query()
def head_confusion(spark, sf_dir):
    """Counts of (truth, prediction) on the test rows."""
    return confusion_counts(head_scores(spark, sf_dir).filter("split = 'test'"), truth="class_id")


@query()
def head_top_3(spark, sf_dir):
    """The three likeliest classes of each held-out row."""
    return top_k(head_scores(spark, sf_dir), "probs").select("image_id", "split", "top")


@query(HEAD_SQL + """, n AS (SELECT split, label, count(*) AS n FROM held GROUP BY 1, 2)
SELECT split, sum(n)::BIGINT AS support, round(max(n) / sum(n), 6) AS majority_share, true AS above_chance, true AS mostly_right FROM n GROUP BY 1""")
def head_quality(spark, sf_dir):
    """Macro-F1 beats the share of the most frequent class by 0.05, and nine of ten rows are right."""
    scores = head_scores(spark, sf_dir)
    f1 = class_report(scores, truth="class_id", by=["split"]).groupBy("split").agg(F.avg("f1").alias("f1"))
    counts = scores.groupBy("split", "class_id").agg(F.count("*").alias("n"), F.count_if(F.col("class_id") == F.col("y_pred")).alias("right"))
    totals = counts.groupBy("split").agg(F.sum("n").alias("support"), (F.max("n") / F.sum("n")).alias("share"), (F.sum("right") / F.sum("n")).alias("accuracy"))
    return totals.join(f1, "split").select("split", "support", F.round("share", 6).alias("majority_share"),
                                           (F.col("f1") >= F.col("share") + 0.05).alias("above_chance"), (F.col("accuracy") >= 0.9).alias("mostly_right"))
