"""Toxicity: held-out accuracy, the learners against plain versions, and odd rows."""

import zlib

import numpy as np
import pytest

from sievework.llm import queries, toxicity

DOCS = "doc_id BIGINT, text STRING, score STRING, label INT"
LABELS = "doc_id BIGINT, quality INT, toxic INT"


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in queries.op12_boosted_trees(spark, "/root/testdata/sf0.1").collect()}


def test_held_out_accuracy(spark, scored):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(scored) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in scored.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored.values())
    unseen = [(scored[i].predicted, t) for i, t in labels.items() if i in scored and scored[i].held_out]
    caught = np.mean([p for p, t in unseen if t])
    wrong = np.mean([p for p, t in unseen if not t])
    assert caught >= 0.85 and wrong <= 0.01, (caught, wrong)
    # calibration: among held-out texts the mean score is near the share of toxic ones
    assert abs(np.mean([scored[i].score for i in labels if i in scored and scored[i].held_out]) - np.mean([t for _, t in unseen])) < 0.03


def test_isotonic_matches_least_squares():
    """Pooling gives the monotone fit: every block mean equals max-min of averages."""
    rng = np.random.default_rng(1)
    raw, y = rng.integers(0, 25, 80) / 5, rng.integers(0, 2, 80).astype(float)
    points = toxicity.isotonic(raw, y)
    order = np.argsort(raw, kind="stable")
    r, t = raw[order], y[order]
    for v in np.unique(r):
        low, high = np.searchsorted(r, v), np.searchsorted(r, v, side="right")
        # over whole levels only
        starts = [i for i in range(low + 1) if i == 0 or r[i] != r[i - 1]]
        ends = [j for j in range(high, len(r) + 1) if j == len(r) or r[j] != r[j - 1]]
        want = max(min(t[i:j].mean() for j in ends) for i in starts)
        assert abs(np.interp(v, *points) - want) < 1e-12
    assert (np.diff(points[1]) >= 0).all() and (np.diff(points[0]) >= 0).all()


def test_first_tree_is_the_best_stump():
    """Depth one, one round: the split with the largest gain over all features and cuts."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 9, (200, 3)).astype(float), rng.integers(0, 2, 200).astype(float)
    model = toxicity.BoostedTrees(rounds=1, depth=1, bins=64).fit(x, y)
    p = y.mean()

    def gain(f, cut):
        left = x[:, f] <= cut
        return sum((p - y[m]).sum() ** 2 / (m.sum() * p * (1 - p) + 1) for m in (left, ~left))
    best = max(((f, c) for f in range(3) for c in range(8)), key=lambda s: gain(*s))
    feature, cut, _ = model.trees[0]
    assert gain(feature[0], cut[0]) == pytest.approx(gain(*best))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = toxicity.BoostedTrees().fit(x, y)
    fresh = rng.random((500, 4))
    assert (((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5)) == (model.raw(fresh) > 0)).mean() > 0.93


def test_features():
    lexicon = toxicity.Lexicon({"achl": 4.0})

    def named(text):
        return dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon), strict=True))
    plain, rude = named("You are a kind person, he said."), named("YOU idiot!! You achlichung, st*pid id1ot i.d.i.o.t stuuupid")
    assert plain["fixed"] == 0 and plain["second"] > 0 and plain["near_second"] == 0
    assert np.expm1(rude["fixed"]) >= 1 and np.expm1(rude["near_second"]) >= 2 and rude["most"] == 4.0
    assert rude["mixed"] > 0 and rude["spelled"] > 0 and rude["stretched"] > 0 and rude["mark_runs"] > 0 and np.expm1(rude["plain_hits"]) >= 3
    assert not toxicity.features("", lexicon).any()


def test_windows_lose_nothing():
    text = "one two  three\nfour five" * 40 + "x" * 300
    assert "".join(toxicity.windows(text, 50)) == text and "".join(toxicity.windows("", 5)) == ""
    lexicon = toxicity.Lexicon({})
    whole = toxicity.raw_counts(text, lexicon)[0]
    parts = sum(toxicity.raw_counts(t, lexicon)[0] for t in toxicity.windows(text, 500))
    assert np.array_equal(whole, parts)


def test_odd_rows(spark):
    rows = [(i, f"quiet words number {i} stand here", "x", 1) for i in range(60)]
    rows += [(100 + i, f"you idiot number {i} are a moron", "x", 1) for i in range(40)]
    rows += [(1, None, None, None), (None, "you idiot are a moron", None, None), (200, "", "x", 1), (200, "", "x", 1), (201, "a" * 3_000_000, "x", 1)]
    labels = [(i, 1, int(i >= 100)) for i, *_ in rows if i is not None and i < 200] + [(None, 1, 1), (5, None, None), (7, 1, 1), (7, 1, 0)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit_toxicity(docs, known)
    got = toxicity.score_toxicity(docs, model)
    assert got.columns == ["doc_id", "text", "label", "score"] and got.count() == len(rows)
    scores = {r.doc_id: r.score for r in got.collect()}
    assert scores[None] > 0.7 > 0.3 > scores[3] and 0 <= scores[200] < 0.7 and scores[201] < 0.7
    empty = toxicity.fit_toxicity(docs.limit(0), known)
    assert toxicity.score_toxicity(docs.limit(0), empty).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, empty).collect()} == {0.5}
    one_kind = toxicity.fit_toxicity(docs, known.filter("toxic = 0"))
    assert {r.score for r in toxicity.score_toxicity(docs, one_kind).collect()} == {0.0}
