"""The line field: exact marginals, learning, held-out accuracy, odd rows."""

import itertools
import zlib

import numpy as np
import pytest

from sievework.llm import line_crf, queries


def plain_marginals(emission, step):
    total = np.zeros(emission.shape)
    for path in itertools.product((0, 1), repeat=len(emission)):
        w = np.exp(sum(emission[t, s] for t, s in enumerate(path)) + sum(step[a, b] for a, b in itertools.pairwise(path)))
        for t, s in enumerate(path):
            total[t, s] += w
    return total / total.sum(axis=1, keepdims=True)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    crf = line_crf.LineCrf(3)
    crf.step = rng.normal(size=(2, 2))
    lengths = np.array([1, 5, 3, 8, 1, 2])
    emission = rng.normal(size=(lengths.sum(), 2)) * 3
    got, _ = crf.marginals(emission, lengths)
    at = 0
    for n in lengths:
        assert np.allclose(got[at:at + n], plain_marginals(emission[at:at + n], crf.step))
        at += n


def test_lines_are_cut(monkeypatch):
    monkeypatch.setattr(line_crf, "LINE_CHARS", 4)
    assert line_crf.lines_of("abcdefghi\n\nxy") == ["abcd", "efgh", "i", "", "xy"]
    assert line_crf.lines_of("") == [""]


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op6_line_crf(spark, sf_dir).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    judged = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 50 and sum(judged) / len(judged) >= 0.95


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(i, "Plain words stand here.\nAnd more of them." if i % 2 else "### $$$ @@@\n!!! ###", "en") for i in range(40)],
                                 "doc_id BIGINT, text STRING, lang STRING")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 1, 0), (2, None, 0), (None, 1, 0), (99, 1, 1)],
                                   "doc_id BIGINT, quality INT, toxic INT")
    return docs, labels


def test_odd_rows(spark, small):
    crf = line_crf.fit_quality(*small)
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "Plain words stand here.", "z"), (4, "### $$$ @@@", "u"),
                                 (4, "### $$$ @@@", "u"), (5, "Plain words. " * 3000, "v")], "doc_id BIGINT, text STRING, score STRING")
    rows = line_crf.score_documents(odd, crf).collect()
    score = {(r.doc_id, r.text): r.score for r in rows}
    assert len(rows) == 6 and score[1, None] == score[1, ""]
    assert score[None, "Plain words stand here."] > 0.7 > 0.3 > score[4, "### $$$ @@@"]
    assert line_crf.score_documents(odd.limit(0), crf).count() == 0


def test_without_labels_every_score_is_a_half(spark, small):
    crf = line_crf.fit_quality(small[0], small[1].limit(0))
    assert {r.score for r in line_crf.score_documents(small[0], crf).collect()} == {0.5}


def test_scores_do_not_depend_on_neighbours_in_the_batch(spark, small):
    crf = line_crf.fit_quality(*small)
    texts = ["a b c\nd", "", "### !!\n" * 20, "One line."]
    together = crf.scores(texts)
    assert np.allclose(together, [crf.scores([t])[0] for t in texts], atol=1e-12)
