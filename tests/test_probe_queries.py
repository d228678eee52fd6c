"""The probe queries that return fitted results, against numpy and each other."""

import numpy as np
import pytest

import __spark_entry__ as entry_points
from sievework.plans import probes as plans
from pyspark.sql import functions as F

PLANS = entry_points.queries()


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)


def test_pca_against_numpy(spark, sf_dir, vectors):
    ids, x = vectors
    values, basis = np.linalg.eigh(np.cov(x.T))
    values, basis = values[::-1], basis[:, ::-1]
    got = [r.share for r in PLANS["pca_variance"](spark, sf_dir).orderBy("component").collect()]
    assert np.allclose(got, (values / values.sum())[:50], atol=1e-9)
    rows = {r.vec_id: r.components for r in PLANS["pca_projection"](spark, sf_dir).collect()}
    found = np.array([rows[i] for i in ids])
    assert found.shape == (len(ids), 50) and np.allclose(np.abs(found[:, :10]), np.abs(x @ basis[:, :10]), atol=1e-6)


def test_head_results(spark, sf_dir):
    confusion = {(r.y_true, r.y_pred): r.n for r in PLANS["head_confusion"](spark, sf_dir).collect()}
    report = {r.label: r for r in PLANS["head_report"](spark, sf_dir).filter("split = 'test'").collect()}
    assert set(report) == {"de", "en", "es", "fr"}
    for label, r in report.items():
        hits = confusion.get((label, label), 0)
        assert r.support == sum(n for (t, _), n in confusion.items() if t == label)
        assert r.recall == pytest.approx(hits / r.support) and r.f1 > 0.6
    for r in PLANS["head_top_3"](spark, sf_dir).collect():
        confidence = [t.confidence for t in r.top]
        assert len({t.class_index for t in r.top}) == 3 and confidence == sorted(confidence, reverse=True) and sum(confidence) <= 1.001


def test_shortcut_results(spark, sf_dir):
    report = {(r.probe, r.scope): r for r in PLANS["shortcut_report"](spark, sf_dir).collect()}
    assert {p for p, _ in report} == {"class_by_metadata", "class_by_features", "source_by_features"}
    # the language of a text shows in its letters
    assert report["source_by_features", "DOC_GOOD"].macro_f1 > 0.9
    assert report["class_by_metadata", "text"].note.startswith("DOC_GOOD 0.")


@pytest.mark.parametrize("chunk", [1 << 20, 3])
def test_letters_are_counted_in_one_pass(spark, sf_dir, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(plans, "CHUNK", chunk)
    odd = ["", None, " ", "É" * 5 + "İKÅßẞ", "x" * 3 + "é" * 70_001, "日本語Ã©ñÑ", "\U0001f600a", "ÄÖÜ ß", "ìÿ×÷ù"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id LONG, text STRING")
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).select(F.col("doc_id") + 100, "text")
    rows.union(some).write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.letter_shares(spark, str(tmp_path))
    assert "translate" not in found._jdf.queryExecution().optimizedPlan().toString()
    found = {r.doc_id: r.features for r in found.collect()}
    lowered = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.lower("text").alias("t")).collect()
    assert found == {r.doc_id: [r.t.count(c) / len(r.t) if r.t else 0.0 for c in plans.LETTERS] for r in lowered}
