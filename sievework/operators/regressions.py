"""Many multinomial regressions at once: one for each (group, left-out fold), fitted side by side on the cluster.

Every iteration is one job: each task adds up, for all models still open, the loss and the gradient of its rows at the
model's trial point; the driver holds one L-BFGS state per model, takes its step, and drops models that have converged. So the
number of jobs is that of the slowest model, whatever the number of groups. Only sums reach the driver, never rows.

A model is fitted on standardised inputs with the penalty of `C` on its weights and none on its offsets: it minimises
mean loss + |W|^2 / (2 C n). A label without a training row in a model is no class of that model. Groups with one label only
have no model. Rows without a group, label or inputs take no part.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.heads import FAN_IN
from sievework.session import SMALL_TABLE_ROWS, cut_lineage

C = 0.5
MAX_ITER = 500
TOLERANCE = 1e-5
MEMORY = 10
ALL = -1  # the fold that is left out by a model over all rows: none has this number


@dataclass
class Model:
    """One regression: classes (positions in its group's labels), scaling of the inputs, and the state of its L-BFGS."""

    group: int
    fold: int
    classes: np.ndarray
    rows: int
    mean: np.ndarray
    scale: np.ndarray
    penalty: float
    point: np.ndarray = field(init=False)
    trial: np.ndarray = field(init=False)
    value: float = np.inf
    slope: np.ndarray | None = None
    way: np.ndarray | None = None
    step: float = 1.0
    done: bool = False
    evaluations: int = 0

    def __post_init__(self):
        self.point = np.zeros((len(self.mean) + 1) * len(self.classes))
        self.trial = self.point
        self.pairs: deque = deque(maxlen=MEMORY)

    def weights(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and offsets for inputs from which `mean` is subtracted but which are not scaled."""
        table = flat.reshape(len(self.mean) + 1, -1)
        return table[:-1] / self.scale[:, None], table[-1]

    def objective(self, loss: float, gradient: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and slope at the trial point, from the sums over rows: loss, and gradient (inputs and a row for offsets)."""
        table = gradient.reshape(len(self.mean) + 1, -1).copy() / self.rows
        table[:-1] /= self.scale[:, None]
        own = self.trial.reshape(table.shape)
        table[:-1] += self.penalty * own[:-1]
        return loss / self.rows + self.penalty / 2 * float(np.square(own[:-1]).sum()), table.ravel()

    def advance(self, loss: float, gradient: np.ndarray, tolerance: float, max_iter: int) -> None:
        """Take what was measured at the trial point, and set the next trial point."""
        value, slope = self.objective(loss, gradient)
        self.evaluations += 1
        if self.way is not None and value > self.value + 1e-4 * self.step * float(self.slope @ self.way):
            self.step /= 2
            # a step this short changes nothing any more
            self.done = self.step < 1e-12 or self.evaluations >= max_iter
        else:
            if self.slope is not None:
                moved, turned = self.trial - self.point, slope - self.slope
                if moved @ turned > 1e-14 * float(turned @ turned):
                    self.pairs.append((moved, turned))
            self.point, self.value, self.slope = self.trial, value, slope
            self.done = bool(np.abs(slope).max() <= tolerance) or self.evaluations >= max_iter
            self.way = self._direction()
            self.step = 1.0 if self.pairs else 1.0 / max(1.0, float(np.linalg.norm(slope)))
        self.trial = self.point + self.step * self.way

    def _direction(self) -> np.ndarray:
        way, kept = -self.slope, []
        for moved, turned in reversed(self.pairs):
            share = (moved @ way) / (moved @ turned)
            kept.append(share)
            way = way - share * turned
        if self.pairs:
            moved, turned = self.pairs[-1]
            way = way * (moved @ turned) / (turned @ turned)
        for (moved, turned), share in zip(self.pairs, reversed(kept), strict=True):
            way = way + moved * (share - (turned @ way) / (moved @ turned))
        return way


@dataclass(frozen=True)
class Regressions:
    """Fitted models: the label names of each group (by its number), groups by number, and models by (group, fold)."""

    groups: list[str]
    labels: list[list[str]]
    models: dict[tuple[int, int], Model]
    jobs: int

    def coefficients(self, group: str, fold: int = ALL) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(labels, weights, offsets) on the original inputs; offsets add up to zero."""
        g = self.groups.index(group)
        model = self.models[g, fold]
        weights, offsets = model.weights(model.point)
        offsets = offsets - model.mean @ weights
        return [self.labels[g][c] for c in model.classes], weights, offsets - offsets.mean()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sums(rows: DataFrame, measure, tasks: int) -> dict[int, np.ndarray]:
    """{key: sum of vectors}. `measure(batch)` gives (key, vector) pairs; each task adds its own, many tasks meet per key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, vector in measure(batch):
                total[key] = total[key] + vector if key in total else vector
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["key", "total"])

    found = rows.mapInArrow(run, "key BIGINT, total BINARY")
    if tasks > FAN_IN:
        def add(part: pa.Table) -> pa.Table:
            return pa.table({"key": part.column("key").slice(0, 1), "total": pa.array(
                [np.sum([np.frombuffer(v.as_buffer(), np.float64) for v in part.column("total")], axis=0).tobytes()], pa.binary())})

        found = found.groupBy("key").applyInArrow(add, "key BIGINT, total BINARY")
    out: dict[int, np.ndarray] = {}
    for r in found.collect():
        vector = np.frombuffer(r.total, np.float64)
        out[r.key] = out[r.key] + vector if r.key in out else vector
    return out


def _log_shares(x: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    score = x @ weights + offsets
    score -= score.max(axis=1, keepdims=True)
    return score - np.log(np.exp(score).sum(axis=1, keepdims=True))


def numbered(rows: DataFrame, group: str, label: str, features: str, fold: str | None) -> tuple[DataFrame, list[str], list[list[str]], dict]:
    """(g, fold, y, x) written once, group names, label names of each group, and rows by (g, fold, y)."""
    spark = rows.sparkSession
    known = rows.select(F.col(group).cast("string").alias("group"), F.col(label).cast("string").alias("label"),
                        F.col(features).cast("array<double>").alias("x"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"))
    known = cut_lineage(known.filter(F.col("group").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()))
    counts = known.groupBy("group", "label", "fold").count().limit(SMALL_TABLE_ROWS + 1).collect()
    if len(counts) > SMALL_TABLE_ROWS:
        raise ValueError("too many groups, labels and folds")
    by_group = defaultdict(set)
    for r in counts:
        by_group[r.group].add(r.label)
    groups = sorted(g for g in by_group if len(by_group[g]) > 1)
    labels = [sorted(by_group[g]) for g in groups]
    names = [(g, l, i, y) for i, g in enumerate(groups) for y, l in enumerate(labels[i])]
    table = spark.createDataFrame(names, "group STRING, label STRING, g INT, y INT")
    place = {(g, l): (i, y) for g, l, i, y in names}
    sizes = {(*place[r.group, r.label], r.fold): r["count"] for r in counts if (r.group, r.label) in place}
    data = cut_lineage(known.join(F.broadcast(table), ["group", "label"]).select("g", "fold", "y", "x"))
    return data, groups, labels, {(g, f, y): n for (g, y, f), n in sizes.items()}


def fit_many(rows: DataFrame, group: str, label: str, features: str = "features", fold: str | None = None, c: float = C,
             tolerance: float = TOLERANCE, max_iter: int = MAX_ITER) -> tuple[Regressions, DataFrame]:
    """(models, rows as numbers): for each group a model without each of its folds, or one over all rows without `fold`.

    The second result has g, fold, y, x and is what `held_out_predictions` reads.
    """
    data, groups, labels, sizes = numbered(rows, group, label, features, fold)
    tasks = data.rdd.getNumPartitions()

    def first_two(batch):
        if not batch.num_rows:
            return
        x, at = _matrix(batch.column(3)), np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        for g, f in np.unique(at, axis=0):
            own = x[(at == (g, f)).all(axis=1)]
            yield int(g) << 32 | int(f), np.concatenate([[len(own)], own.sum(axis=0), np.square(own).sum(axis=0)])

    sums = _sums(data, first_two, tasks)
    models: dict[tuple[int, int], Model] = {}
    for g in range(len(groups)):
        folds = sorted({f for h, f, _ in sizes if h == g})
        for left in folds if fold else [ALL]:
            kept = [f for f in folds if f != left]
            classes = [y for y in range(len(labels[g])) if any((g, f, y) in sizes for f in kept)]
            if len(classes) < 2:
                continue
            total = np.sum([sums[g << 32 | f] for f in kept], axis=0)
            n, first, second = total[0], *np.split(total[1:], 2)
            mean = first / n
            spread = np.sqrt(np.maximum(second / n - mean ** 2, 0))
            spread = np.where(spread > 1e-9 * np.maximum(np.abs(mean), 1), spread, 1.0)
            models[g, left] = Model(g, left, np.array(classes), int(n), mean, spread, 1 / (c * n))
    jobs = 0
    while still := {k: m for k, m in models.items() if not m.done}:
        points = [(g, f, m.mean, m.classes, *m.weights(m.trial)) for (g, f), m in still.items()]
        sums = _sums(data, _measure(points), tasks)
        for number, model in enumerate(still.values()):
            model.advance(sums[number][0], sums[number][1:], tolerance, max_iter)
        jobs += 1
    return Regressions(groups, labels, models, jobs), data


def _measure(points: list[tuple]):
    """For every model the loss and gradient sums of a batch: (number, [loss, gradient…])."""
    by_group = defaultdict(list)
    for number, point in enumerate(points):
        by_group[point[0]].append((number, *point[1:]))

    def measure(batch):
        if not batch.num_rows:
            return
        g, fold, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3))
        for group in np.unique(g).tolist():
            for number, left, mean, classes, weights, offsets in by_group.get(group, ()):
                own = (g == group) & (fold != left)
                if not own.any():
                    continue
                part, at = x[own] - mean, np.searchsorted(classes, y[own])
                logs = _log_shares(part, weights, offsets)
                down = np.exp(logs)
                down[np.arange(len(at)), at] -= 1
                loss = -logs[np.arange(len(at)), at].sum()
                yield number, np.concatenate([[loss], (part.T @ down).ravel(), down.sum(axis=0)])
    return measure


def held_out_predictions(fitted: Regressions, data: DataFrame) -> DataFrame:
    """(group, fold, y_true, y_pred): every row under the model that has not seen its fold."""
    groups, labels = fitted.groups, fitted.labels
    points = {k: (m.mean, m.classes, *m.weights(m.point)) for k, m in fitted.models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            g, fold, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3))
            found = np.full(len(y), -1)
            for group, left in np.unique(np.stack([g, fold], axis=1), axis=0).tolist():
                if (group, left) in points:
                    mean, classes, weights, offsets = points[group, left]
                    own = np.flatnonzero((g == group) & (fold == left))
                    found[own] = classes[_log_shares(x[own] - mean, weights, offsets).argmax(axis=1)]
            kept = np.flatnonzero(found >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([groups[g[i]] for i in kept], pa.string()), pa.array(fold[kept]), pa.array([labels[g[i]][y[i]] for i in kept], pa.string()),
                 pa.array([labels[g[i]][found[i]] for i in kept], pa.string())], ["group", "fold", "y_true", "y_pred"])

    return data.mapInArrow(run, "group STRING, fold INT, y_true STRING, y_pred STRING")
