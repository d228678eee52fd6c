"""Forests over folds: shared top nodes, growth below them, and what a forest must find."""

import numpy as np
import pytest

from sievework.operators import probes
from sievework.operators.forests import fold_votes, grown, record


def test_a_tree_is_grown_until_its_leaves_are_pure():
    rng = np.random.default_rng(1)
    rows = np.zeros(800, record(3))
    rows["bins"], rows["weight"] = rng.integers(0, 32, (800, 3)), np.arange(800) < 600
    rows["y"] = (rows["bins"][:, 0] > 15) ^ (rows["bins"][:, 1] > 20)
    shares = grown(rows, 2, 30, rng)[600:]
    assert np.allclose(shares.sum(axis=1), 1) and set(np.unique(shares)) == {0.0, 1.0}
    assert (shares.argmax(axis=1) == rows["y"][600:]).mean() > 0.9
    flat = grown(rows, 2, 0, rng)[600:]
    assert np.allclose(flat, np.bincount(rows["y"][:600], minlength=2) / 600)


@pytest.mark.parametrize("node_rows", [10_000, 150])
def test_rows_are_judged_by_trees_without_their_fold(spark, node_rows, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    data = spark.createDataFrame([(f"r{i}", i % 3, int(y[i]), *map(float, x[i])) for i in range(900)],
                                 "id STRING, fold INT, y INT, a DOUBLE, b DOUBLE, c DOUBLE")
    found = fold_votes(data, ["a", "b", "c"], 2, 3, 20, 30, node_rows=node_rows).collect()
    assert len(found) == 900 and sum(r.y_true for r in found) == y.sum()
    assert np.mean([r.y_true == r.y_pred for r in found]) > 0.85
    noise = data.withColumn("y", (data["a"] * 0 + data["c"] * 1e6 % 2 > 1).cast("int"))
    assert 0.3 < np.mean([r.y_true == r.y_pred for r in fold_votes(noise, ["a", "b"], 2, 3, 20, 30, node_rows=node_rows).collect()]) < 0.7


def test_no_tree_reaches_the_driver(spark):
    """The probe on metadata has no MLlib forest, whose nodes lie on the driver and grow with the rows."""
    assert not hasattr(probes, "RandomForestClassifier") and not hasattr(probes, "VectorAssembler")
