"""Regressions fitted together: the same as single fits and as MLlib's, in a number of jobs that does not depend on the groups."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from sievework.operators import probes, regressions

ROWS = "id STRING, group STRING, label STRING, features ARRAY<DOUBLE>, fold INT"


def some_rows(groups=3, n=150, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=(3, 4))
        for i in range(n):
            y = int(rng.integers(3))
            x = centre[y] + rng.normal(size=4)
            rows.append((f"{g}-{i}", f"g{g}", f"k{y}", [*(x * [1, 10, 0.01, 1] + [0, 500, 0, 0]).tolist(), 7.0], i % 5))
    return rows


def test_same_as_single_fits(spark):
    rows = some_rows()
    table = spark.createDataFrame(rows, ROWS).repartition(4)
    together, _ = regressions.fit_many(table, "group", "label", fold="fold", tolerance=1e-9)
    assert sorted(together.models) == [(g, f) for g in range(3) for f in range(5)] and together.groups == ["g0", "g1", "g2"]
    for g, f in ((0, 1), (2, 4)):
        part = table.filter((F.col("group") == f"g{g}") & (F.col("fold") != f))
        single, _ = regressions.fit_many(part, "group", "label", tolerance=1e-9)
        for a, b in zip(together.coefficients(f"g{g}", f)[1:], single.coefficients(f"g{g}")[1:], strict=True):
            assert np.abs(a - b).max() < 1e-6


def test_same_as_mllib(spark):
    rows = some_rows(1, 200, 3)
    table = spark.createDataFrame(rows, ROWS)
    fitted, _ = regressions.fit_many(table, "group", "label", tolerance=1e-9)
    labels, weights, offsets = fitted.coefficients("g0")
    vec = probes.with_vectors(table, "features").withColumn("y", F.substring("label", 2, 1).cast("double"))
    scaler = StandardScaler(withMean=True, inputCol="vec", outputCol="scaled").fit(vec)
    model = LogisticRegression(featuresCol="scaled", labelCol="y", family="multinomial", standardization=False, maxIter=500, tol=1e-12,
                               regParam=1 / (regressions.C * 200)).fit(scaler.transform(vec))
    x = np.array([r[3] for r in rows])
    spread = x.std(axis=0)
    spread[spread == 0] = 1
    # MLlib scales by the spread of a sample, n - 1 in place of n
    score = x @ weights + offsets
    theirs = ((x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0, ddof=1))) @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
    shares = [np.exp(s) / np.exp(s).sum(axis=1, keepdims=True) for s in (score - score.max(axis=1, keepdims=True), theirs - theirs.max(axis=1, keepdims=True))]
    assert labels == ["k0", "k1", "k2"] and np.abs(shares[0] - shares[1]).max() < 2e-3


def test_gradient_by_differences():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(30, 3)) * [1, 5, 0.2] + 2, rng.integers(0, 3, 30)
    model = regressions.Model(0, -1, np.arange(3), 30, x.mean(axis=0), x.std(axis=0), 0.07)
    model.trial = rng.normal(size=12)

    class Batch:
        num_rows = 30

        def column(self, i):
            import pyarrow as pa
            return [pa.array(np.zeros(30, int)), pa.array(np.zeros(30, int)), pa.array(y), pa.array(x.tolist(), pa.list_(pa.float64()))][i]

    def value(flat):
        model.trial = flat
        (_, sums), = regressions._measure([(0, -1, model.mean, model.classes, *model.weights(flat))])(Batch())
        return model.objective(sums[0], sums[1:])
    at = model.trial
    _, slope = value(at)
    for i in range(12):
        step = np.zeros(12)
        step[i] = 1e-6
        assert slope[i] == pytest.approx((value(at + step)[0] - value(at - step)[0]) / 2e-6, abs=1e-6)


def test_jobs_do_not_grow_with_groups(spark):
    few, _ = regressions.fit_many(spark.createDataFrame(some_rows(1), ROWS).coalesce(2), "group", "label", fold="fold")
    many, _ = regressions.fit_many(spark.createDataFrame(some_rows(12, 60), ROWS).coalesce(2), "group", "label", fold="fold")
    assert len(many.models) == 60 and many.jobs <= 2 * few.jobs and all(m.evaluations <= many.jobs for m in many.models.values())


def test_many_tasks_and_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(regressions, "FAN_IN", 2)
    rows = some_rows(2, 120, 8)
    fitted, data = regressions.fit_many(spark.createDataFrame(rows, ROWS).repartition(6), "group", "label", fold="fold")
    found = regressions.held_out_predictions(fitted, data).collect()
    assert len(found) == 240 and np.mean([r.y_true == r.y_pred for r in found]) > 0.6


def test_odd_groups(spark):
    rows = [("a", "one", "k", [1.0], 0), ("b", "one", "k", [2.0], 1), ("c", None, "k", [1.0], 0), ("d", "two", None, [1.0], 0), ("e", "two", "x", None, 0),
            *[(f"f{i}", "two", "xy"[i % 2], [float(i % 2)], i % 5) for i in range(20)], ("g", "two", "rare", [9.0], 3), ("g", "two", "rare", [9.0], 3)]
    fitted, data = regressions.fit_many(spark.createDataFrame(rows, ROWS), "group", "label", fold="fold")
    assert fitted.groups == ["two"] and fitted.labels == [["rare", "x", "y"]]
    assert [len(fitted.models[0, f].classes) for f in range(5)] == [3, 3, 3, 2, 3]
    found = regressions.held_out_predictions(fitted, data).collect()
    assert len(found) == 22 and all(r.y_true == r.y_pred for r in found if r.y_true != "rare")
    empty, none = regressions.fit_many(spark.createDataFrame([], ROWS), "group", "label", fold="fold")
    assert empty.models == {} and regressions.held_out_predictions(empty, none).count() == 0
