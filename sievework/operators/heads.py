"""Training of a small network on feature rows: one hidden layer, dropout, class weights, early stop.

Every step is one job. The rows of a mini-batch lie in a folder of their own, so a step reads its batch and nothing else; the
weights travel with the step, tasks turn their Arrow batches into sums of gradients, the sums of many tasks are added in a
second stage, and the driver makes the Adam step. The driver never holds rows. The loss on validation rows is a job of the
same kind after every epoch; the weights of the best epoch are kept, and training ends after `patience` epochs without a better one.

Dropout masks depend on the seed, the step and the place of a batch in its task, so a repeated task gives the same sums. Sums
of floating-point numbers may differ in the last digits with the layout of the files.

Rows without features or label are not used; unknown labels in rows to score are no problem, their probabilities are given all
the same. Classes are those of the train rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.evaluate import class_weights
from sievework.session import SMALL_TABLE_ROWS, files_of

# The head's size and its training.
HIDDEN, DROPOUT, L2, RATE, EPOCHS, PATIENCE = 128, 0.3, 1e-4, 1e-3, 60, 8
# Sums of more tasks than this are added in a second stage before they reach the driver.
FAN_IN = 16
PARTS = ("w1", "b1", "w2", "b2")


def split_vector(flat: np.ndarray, inputs: int, hidden: int, classes: int) -> dict[str, np.ndarray]:
    """The layers of a flat parameter vector."""
    shapes = {"w1": (inputs, hidden), "b1": (hidden,), "w2": (hidden, classes), "b2": (classes,)}
    sizes = np.cumsum([int(np.prod(shapes[p])) for p in PARTS])
    return {p: part.reshape(shapes[p]) for p, part in zip(PARTS, np.split(flat, sizes[:-1]), strict=True)}


def first_weights(inputs: int, hidden: int, classes: int, seed: int) -> np.ndarray:
    """Uniform weights by the sizes of the layers, zero offsets."""
    rng = np.random.default_rng(seed)
    w1 = rng.uniform(-1, 1, inputs * hidden) * np.sqrt(6 / (inputs + hidden))
    w2 = rng.uniform(-1, 1, hidden * classes) * np.sqrt(6 / (hidden + classes))
    return np.concatenate([w1, np.zeros(hidden), w2, np.zeros(classes)])


def forward(layers: dict[str, np.ndarray], x: np.ndarray, masks: tuple[np.ndarray, np.ndarray] | None = None) -> tuple:
    """(input, hidden layer before and after the ramp, log probabilities)."""
    x = x * masks[0] if masks else x
    raw = x @ layers["w1"] + layers["b1"]
    hidden = np.maximum(raw, 0) * (masks[1] if masks else 1)
    score = hidden @ layers["w2"] + layers["b2"]
    score = score - score.max(axis=1, keepdims=True)
    return x, raw, hidden, score - np.log(np.exp(score).sum(axis=1, keepdims=True))


def summed_loss(layers: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The weighted sum of the cross-entropy."""
    return float(-(weight * forward(layers, x)[-1][np.arange(len(y)), y]).sum())


def summed_gradient(layers: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray,
                    masks: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The gradient of the weighted sum of the cross-entropy, as one flat vector."""
    x, raw, hidden, logs = forward(layers, x, masks)
    out = np.exp(logs)
    out[np.arange(len(y)), y] -= 1
    out *= weight[:, None]
    back = (out @ layers["w2"].T) * (raw > 0) * (masks[1] if masks else 1)
    return np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), (hidden.T @ out).ravel(), out.sum(axis=0)])


@dataclass
class Adam:
    size: int
    rate: float = RATE
    steps: int = 0
    moment: np.ndarray = field(init=False)
    square: np.ndarray = field(init=False)

    def __post_init__(self):
        self.moment, self.square = np.zeros(self.size), np.zeros(self.size)

    def move(self, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.moment = 0.9 * self.moment + 0.1 * gradient
        self.square = 0.999 * self.square + 0.001 * gradient ** 2
        return -self.rate * (self.moment / (1 - 0.9 ** self.steps)) / (np.sqrt(self.square / (1 - 0.999 ** self.steps)) + 1e-7)


@dataclass(frozen=True)
class Head:
    """A trained head: its classes in order, the shift and scale of its inputs, its weights, and the loss after each epoch."""

    labels: list[str]
    shift: np.ndarray
    scale: np.ndarray
    flat: np.ndarray
    hidden: int
    losses: list[float]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        layers = split_vector(self.flat, len(self.shift), self.hidden, len(self.labels))
        return np.exp(forward(layers, (x - self.shift) / self.scale)[-1])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


SENT = "task INT, total BINARY"


def _sent(total: np.ndarray) -> pa.RecordBatch:
    """What a task hands on: its number and its sum."""
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                      ["task", "total"])


def added(rows: DataFrame, size: int, tasks: int) -> np.ndarray:
    """The sum of vectors (`total` BINARY), one row per task; many rows are added in FAN_IN groups first."""
    if tasks > FAN_IN:
        def add(part: pa.Table) -> pa.Table:
            total = np.zeros(size)
            for value in part.column("total"):
                total += np.frombuffer(value.as_buffer(), np.float64)
            return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

        rows = rows.groupBy(F.col("task") % FAN_IN).applyInArrow(add, "total BINARY")
    return np.sum([np.frombuffer(r.total, np.float64) for r in rows.select("total").collect()] or [np.zeros(size)], axis=0)


def moments(rows: DataFrame, inputs: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of every input of rows (x); inputs that never change keep scale 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * inputs)
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, inputs))
            total += np.concatenate([[len(x)], x.sum(axis=0), np.square(x).sum(axis=0)])
        yield _sent(total)

    total = added(rows.select("x").mapInArrow(run, SENT), 1 + 2 * inputs, tasks)
    n, first, second = total[0], *np.split(total[1:], 2)
    mean = first / n
    spread = np.sqrt(np.maximum(second / n - mean ** 2, 0))
    return mean, np.where(spread > 1e-9 * np.maximum(np.abs(mean), 1), spread, 1.0)


def train_head(feature_rows: DataFrame, features: str = "features", label: str = "class_id", id_col: str = "image_id",
               steps: int = 4, hidden: int = HIDDEN, dropout: float = DROPOUT, l2: float = L2, rate: float = RATE,
               epochs: int = EPOCHS, patience: int = PATIENCE, seed: int = 0, checkpoint: str | None = None) -> Head:
    """Train on the train rows of (features, split, class_id), stop on the loss of the val rows.

    An epoch makes `steps` steps, one for each mini-batch; rows are dealt to batches by a hash of their id. With `checkpoint` (a
    folder) the state after every epoch is written as a table, and a later call with the same folder goes on from the last.
    """
    spark = feature_rows.sparkSession
    known = feature_rows.filter(F.col(features).isNotNull() & F.col(label).isNotNull())
    train = known.filter(F.col("split") == "train")
    weights = class_weights(train, label).select(label, "weight", "n").orderBy(label).limit(SMALL_TABLE_ROWS + 1).collect()
    if not weights or len(weights) > SMALL_TABLE_ROWS:
        raise ValueError(f"a head needs train rows of 1 to {SMALL_TABLE_ROWS} classes")
    labels = [r[0] for r in weights]
    table = spark.createDataFrame([(r[0], i, r.weight) for i, r in enumerate(weights)], f"`{label}` {dict(known.dtypes)[label]}, y INT, weight DOUBLE")
    batch = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(steps)).cast("int")
    used = known.filter(F.col("split").isin("train", "val")).join(F.broadcast(table), label).select(
        F.col(features).cast("array<double>").alias("x"), "y", "weight", F.when(F.col("split") == "train", batch).otherwise(-1).alias("batch"))
    folder = files_of(used, ["batch"])
    data = spark.read.schema("x ARRAY<DOUBLE>, y INT, weight DOUBLE, batch INT").parquet(folder)
    rows = {r.batch: (r.n, r.d) for r in data.groupBy("batch").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).collect()}
    inputs = max(d for _, d in rows.values())
    parts = {b: data.filter(F.col("batch") == b).select("x", "y", "weight") for b in rows}
    tasks = {b: part.rdd.getNumPartitions() for b, part in parts.items()}
    learnt = data.filter("batch >= 0")
    shift, scale = moments(learnt, inputs, learnt.rdd.getNumPartitions())

    def total(b: int, flat: np.ndarray, step: int | None) -> np.ndarray:
        """The sum of the gradients of a batch, or with step None the sum of its losses."""
        size = len(flat) if step is not None else 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layers, sums, task = split_vector(flat, inputs, hidden, len(labels)), np.zeros(size), TaskContext.get().partitionId()
            for number, rows_ in enumerate(batches):
                if not rows_.num_rows:
                    continue
                x, y = (_matrix(rows_.column(0)) - shift) / scale, rows_.column(1).to_numpy()
                if step is None:
                    sums += summed_loss(layers, x, y, np.ones(len(y)))
                    continue
                rng = np.random.default_rng([seed, step, task, number])
                masks = ((rng.random(x.shape) >= dropout) / (1 - dropout), (rng.random((len(x), hidden)) >= dropout) / (1 - dropout)) if dropout else None
                sums += summed_gradient(layers, x, y, rows_.column(2).to_numpy(), masks)
            yield _sent(sums)

        return added(parts[b].mapInArrow(run, SENT), size, tasks[b])

    flat = first_weights(inputs, hidden, len(labels), seed)
    adam = Adam(len(flat), rate)
    state = {"epoch": 0, "losses": [], "best": flat, "flat": flat, "moment": adam.moment, "square": adam.square, "steps": 0}
    if checkpoint:
        state |= load_state(spark, checkpoint)
    flat, best, losses = state["flat"], state["best"], list(state["losses"])
    adam.moment, adam.square, adam.steps = state["moment"], state["square"], state["steps"]
    for epoch in range(state["epoch"], epochs):
        if losses and len(losses) - 1 - int(np.argmin(losses)) >= patience:
            break
        for b in np.random.default_rng([seed, epoch]).permutation([b for b in rows if b >= 0]).tolist():
            gradient = total(b, flat, adam.steps) / rows[b][0]
            gradient[:inputs * hidden] += 2 * l2 * flat[:inputs * hidden]
            flat = flat + adam.move(gradient)
        judged = [-1] if -1 in rows else [b for b in rows if b >= 0]
        loss = sum(total(b, flat, None)[0] for b in judged) / sum(rows[b][0] for b in judged)
        losses.append(float(loss + l2 * np.square(flat[:inputs * hidden]).sum()))
        best = flat if losses[-1] == min(losses) else best
        if checkpoint:
            save_state(spark, checkpoint, {"epoch": epoch + 1, "losses": losses, "best": best, "flat": flat, "moment": adam.moment,
                                           "square": adam.square, "steps": adam.steps})
    return Head(labels, shift, scale, best, hidden, losses)


ARRAYS = ("best", "flat", "moment", "square")


def save_state(spark, folder: str, state: dict) -> None:
    """One table per epoch, so a stop while writing leaves the epoch before."""
    row = (json.dumps({k: state[k] for k in ("epoch", "losses", "steps")}), *[state[a].tobytes() for a in ARRAYS])
    columns = "about STRING, " + ", ".join(f"`{a}` BINARY" for a in ARRAYS)
    spark.createDataFrame([row], columns).withColumn("epoch", F.lit(state["epoch"])).coalesce(1).write.mode("append").partitionBy("epoch").parquet(folder)


def load_state(spark, folder: str) -> dict:
    """The state of the last whole epoch; nothing where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    row = spark.read.parquet(folder).orderBy(F.desc("epoch")).first()
    return {} if row is None else json.loads(row.about) | {a: np.frombuffer(row[a], np.float64) for a in ARRAYS}


def score_head(rows: DataFrame, head: Head, features: str = "features") -> DataFrame:
    """Add probs (in label order) and y_pred; rows without features have neither."""
    names = F.array(*[F.lit(l) for l in head.labels])
    columns = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", probs ARRAY<DOUBLE>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            found = np.empty(batch.num_rows, object)
            if len(known):
                for i, p in zip(known, head.probabilities(_matrix(column.take(pa.array(known)))), strict=True):
                    found[i] = p
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.tolist(), pa.list_(pa.float64()))], [*columns, "probs"])

    scored = rows.select("*", F.col(features).cast("array<double>").alias("_x")).mapInArrow(run, schema)
    best = F.array_position("probs", F.array_max("probs")).cast("int")
    return scored.withColumn("y_pred", F.when(F.col("probs").isNotNull(), F.element_at(names, best)))

