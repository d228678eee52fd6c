"""The trained head: gradients, a table that no linear model can learn, early stop, resuming, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import heads, probes
from sievework.operators.evaluate import class_report, macro_f1

ROWS = "image_id STRING, split STRING, class_id STRING, features ARRAY<DOUBLE>"


def rings(n=900, seed=1):
    """Two classes that differ by the sign of a product, and a third far out: no linear model tells the first two apart."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 4))
    label = np.where(x[:, 0] * x[:, 1] > 0, "even", "odd").astype(object)
    far = rng.random(n) < 0.1
    x[far, 2] += 6
    label[far] = "far"
    split = rng.choice(["train", "val", "test"], n, p=[0.7, 0.15, 0.15])
    return [(f"i{i}", str(s), str(c), v.tolist()) for i, (s, c, v) in enumerate(zip(split, label, x, strict=True))]


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    x, y, weight = rng.normal(size=(7, 3)), rng.integers(0, 4, 7), rng.random(7)
    masks = ((rng.random((7, 3)) > 0.3) / 0.7, (rng.random((7, 5)) > 0.3) / 0.7)
    flat = heads.first_weights(3, 5, 4, 1) + rng.normal(size=3 * 5 + 5 + 5 * 4 + 4) * 0.1

    def loss(f):
        layers = heads.split_vector(f, 3, 5, 4)
        return float(-(weight * heads.forward(layers, x, masks)[-1][np.arange(7), y]).sum())
    got = heads.summed_gradient(heads.split_vector(flat, 3, 5, 4), x, y, weight, masks)
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-6)


@pytest.fixture(scope="module")
def trained(spark):
    table = spark.createDataFrame(rings(), ROWS).repartition(3)
    return table, heads.train_head(table, steps=2, hidden=32, dropout=0.1, rate=0.03, epochs=25, patience=25)


def test_beats_the_linear_head(trained):
    table, head = trained
    test = table.filter("split = 'test'")
    score = macro_f1(class_report(heads.score_head(test, head), truth="class_id")).first()[0]
    labels, model = probes.train_head(table)
    linear = macro_f1(class_report(probes.score_head(test, labels, model), truth="class_id")).first()[0]
    assert head.labels == ["even", "far", "odd"] and score > 0.85 and linear < 0.75
    assert min(head.losses) < 0.5 * head.losses[0]


def test_sums_of_tasks_are_the_whole_sum(spark, monkeypatch):
    monkeypatch.setattr(heads, "FAN_IN", 3)
    rows = spark.range(40).repartition(8)
    sent = heads._sent

    def run(batches):
        yield sent(np.array([float(sum(b.num_rows for b in batches)), 1.0]))
    assert heads.added(rows.mapInArrow(run, heads.SENT), 2, 8).tolist() == [40, 8]


def test_stops_early_and_keeps_the_best(spark):
    """Labels without any relation to the features: the loss on val rows soon rises."""
    rng = np.random.default_rng(3)
    rows = [(f"i{i}", "val" if i % 4 == 0 else "train", f"c{rng.integers(2)}", rng.normal(size=6).tolist()) for i in range(160)]
    head = heads.train_head(spark.createDataFrame(rows, ROWS).coalesce(2), steps=1, hidden=64, dropout=0.0, rate=0.05, epochs=40, patience=3)
    assert len(head.losses) < 40 and int(np.argmin(head.losses)) == len(head.losses) - 4


def test_resumes_from_a_checkpoint(spark, tmp_path):
    table = spark.createDataFrame(rings(200), ROWS).coalesce(1)
    options = {"steps": 2, "hidden": 8, "rate": 0.03, "patience": 50}
    whole = heads.train_head(table, epochs=6, **options)
    folder = str(tmp_path / "state")
    heads.train_head(table, epochs=2, checkpoint=folder, **options)
    again = heads.train_head(table, epochs=6, checkpoint=folder, **options)
    assert np.allclose(again.losses, whole.losses) and np.allclose(again.flat, whole.flat)


def test_odd_rows(spark, trained):
    _, head = trained
    rows = [("a", "test", None, [0.5, 0.5, 0.0, 0.0]), ("b", None, "unheard", None), (None, "test", "even", [0.5, 0.5, 6.0, 0.0]), ("a", "test", None, [0.5, 0.5, 0.0, 0.0])]
    got = heads.score_head(spark.createDataFrame(rows, ROWS), head)
    assert got.columns == ["image_id", "split", "class_id", "features", "probs", "y_pred"]
    found = {r.image_id: r for r in got.collect()}
    assert found["b"].probs is None and found["b"].y_pred is None and found[None].y_pred == "far"
    assert sum(found["a"].probs) == pytest.approx(1) and found["a"].y_pred == "even"
    assert heads.score_head(spark.createDataFrame([], ROWS), head).count() == 0
    with pytest.raises(ValueError, match="train rows"):
        heads.train_head(spark.createDataFrame([], ROWS))
    only_train = spark.createDataFrame([(f"i{i}", "train", f"c{i % 2}", [float(i % 2), 1.0]) for i in range(20)] + rows[1:2], ROWS)
    assert heads.train_head(only_train, steps=1, hidden=4, epochs=2).labels == ["c0", "c1"]
