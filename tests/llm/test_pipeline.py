"""The corpus pipeline stage by stage against plain versions, and on odd rows."""

import numpy as np
import pytest
import public_tokenizers
from test_packing import check_layout
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from sievework.llm import line_crf, pii


def staged(spark, docs, sf_dir, tmp_path):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs)
    return out


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good, single, masked, packed = staged(spark, docs, sf_dir, tmp_path)
    assert good.columns == single.columns == masked.columns == docs.columns
    before = {r.doc_id: r for r in docs.collect()}

    crf = line_crf.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r.doc_id: r for r in good.collect()}
    assert kept == {i: r for i, r in before.items() if crf.scores([r.text])[0] >= corpus_pipeline.GOOD}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.98
    assert np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.05

    reached = plain_components({i: plain_fingerprint(r.text) for i, r in kept.items()})
    alone = {r.doc_id: r for r in single.collect()}
    assert alone == {i: r for i, r in kept.items() if reached[i] == i}

    tagger = pii.fit_tagger(single)
    texts = {r.doc_id: r.text for r in masked.collect()}
    ids = sorted(alone)
    spans = tagger.all_spans([alone[i].text for i in ids])
    assert texts == {i: pii.mask(alone[i].text, s[1]) for i, s in zip(ids, spans, strict=True)}
    assert all(not pii.base_spans(t) for t in texts.values())
    assert all(r.n_chars == len(r.text) for r in masked.collect())

    rows = packed.collect()
    check_layout(rows, 2048)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_odd_rows(spark, tmp_path):
    columns = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, _score STRING"
    rows = [(i, f"Words number {i} stand in this line.\nAnd {i * i} in that one.", "en", None, 50) for i in range(30)]
    rows += [(3, None, None, None, None), (40, "", "en", "s", 0), (None, "A line without an id.", "en", "s", 21),
             (41, "Mail ann@site.org now, it is about the words of this line.", "en", "s", 58),
             (41, "Mail ann@site.org now, it is about the words of this line.", "en", "s", 58)]
    sf_dir = str(tmp_path / "sf")
    rows = [(*r, "own") for r in rows]
    spark.createDataFrame(rows, columns).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{sf_dir}/labels.parquet")
    labelled = [(i, 1, 0) for i in range(30)]
    spark.createDataFrame(labelled, "doc_id BIGINT, quality INT, toxic INT").write.mode("overwrite").parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good, single, masked, _ = staged(spark, docs, sf_dir, tmp_path)
    assert good.count() == len(rows) and good.columns == docs.columns and good.filter("_score = 'own'").count() == len(rows)
    assert {r.text for r in masked.collect() if r.doc_id == 41} == {"Mail <email> now, it is about the words of this line."}
    assert single.filter("doc_id IS NULL").count() == 1 and single.filter("doc_id = 41").count() == 1
    assert single.filter("text IS NULL OR text = ''").count() == 1
    empty = docs.limit(0)
    for (_, stage), columns in zip(corpus_pipeline.STAGES, [docs.columns] * 3 + [None], strict=True):
        result = stage(spark, empty, sf_dir)
        assert result.count() == 0 and (columns is None or result.columns == columns)


def test_registered():
    names = set(entry_points.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "personal_data", "packing"]


@pytest.mark.parametrize("name", ["pipeline", "op4_training_order", "op7_patience_licenses", "op10_packing"])
def test_queries_run(spark, sf_dir, name):
    assert entry_points.queries()[name](spark, sf_dir).count() > 0
