"""Forests over folds: every row gets the votes of the trees that have not seen its fold. No tree is kept, on the driver or elsewhere.

Inputs are cut at 31 quantiles. A tree takes each row of its folds a Poisson number of times, drawn from a hash of the row's id, so
every pass and task draws the same. Nodes with more than `node_rows` rows are split by sums of counts over all tasks; from there on
the rows of a node, seventeen bytes each, are one group: a task grows the rest of the tree below it, and the held-out rows that
fell into the node come back with the shares of the classes in their leaf. Shares are added up over trees; the largest is the prediction.

As in MLlib: gini, a random choice of sqrt(inputs) inputs for a node, a node without a gain is a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import cut_lineage

BINS = 32
NODE_ROWS = 1 << 18
# Counts that are held at once while the nodes of a level are split.
CELLS = 1 << 21
POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def record(inputs: int) -> np.dtype:
    """A row of a node: weight 0 is a held-out row."""
    return np.dtype([("id", "<i8"), ("bins", "u1", (inputs,)), ("y", "<u2"), ("weight", "u1")])


def draws(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree takes each row: Poisson(1) of a hash of its id."""
    z = ids.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(POISSON, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53, side="right").astype(np.uint8)


def best_splits(counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input, last bin to the left, gain) of nodes with counts [node, input, bin, class], from the inputs allowed for each."""
    left = counts.cumsum(axis=2, dtype=np.float64)
    whole = left[:, :, -1:, :]
    right = whole - left
    n_left, n_right = left.sum(axis=3), right.sum(axis=3)
    score = np.square(left).sum(axis=3) / np.maximum(n_left, 1) + np.square(right).sum(axis=3) / np.maximum(n_right, 1)
    score -= (np.square(whole).sum(axis=3) / np.maximum(whole.sum(axis=3), 1))
    score[(n_left == 0) | (n_right == 0) | ~allowed[:, :, None]] = -1
    flat = score.reshape(len(score), -1)
    at = flat.argmax(axis=1)
    return at // counts.shape[2], at % counts.shape[2], flat[np.arange(len(at)), at]


def some_inputs(rng: np.random.Generator, nodes: int, inputs: int) -> np.ndarray:
    """A random choice of sqrt(inputs) inputs for each node."""
    return rng.random((nodes, inputs)).argsort(axis=1).argsort(axis=1) < ceil(sqrt(inputs))


def grown(rows: np.ndarray, classes: int, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Grow a tree on rows with a weight; for every row without one the shares of the classes in its leaf."""
    inputs = rows["bins"].shape[1]
    shares = np.zeros((len(rows), classes))
    at, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    for level in range(depth + 1):
        order = np.argsort(node, kind="stable")
        at, node = at[order], node[order]
        bins, y, weight = rows["bins"][at], rows["y"][at].astype(np.int64), rows["weight"][at]
        nodes = int(node[-1]) + 1 if len(node) else 0
        totals = np.bincount(node * classes + y, weight, nodes * classes).reshape(nodes, classes)
        feature, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
        mixed = np.flatnonzero((totals > 0).sum(axis=1) > 1) if level < depth else np.zeros(0, np.int64)
        step = max(1, CELLS // (inputs * BINS * classes))
        place = np.full(nodes, -1)
        place[mixed] = np.arange(len(mixed))
        own = np.flatnonzero((place[node] >= 0) & (weight > 0))
        starts = np.searchsorted(place[node[own]], np.arange(0, len(mixed) + step, step))
        for k, first in enumerate(range(0, len(mixed), step)):
            some = mixed[first:first + step]
            part = own[starts[k]:starts[k + 1]]
            cell = ((place[node[part]] - first)[:, None] * inputs + np.arange(inputs)) * BINS + bins[part]
            counts = np.bincount((cell * classes + y[part][:, None]).ravel(), np.repeat(weight[part], inputs), len(some) * inputs * BINS * classes)
            f, c, gain = best_splits(counts.reshape(len(some), inputs, BINS, classes), some_inputs(rng, len(some), inputs))
            feature[some], cut[some] = np.where(gain > 1e-9, f, -1), c
        ends = feature[node] < 0
        done = np.flatnonzero(ends & (weight == 0))
        shares[at[done]] = totals[node[done]] / np.maximum(totals[node[done]].sum(axis=1, keepdims=True), 1)
        going = ~ends
        at, node, bins = at[going], node[going], bins[going]
        right = bins[np.arange(len(at)), feature[node]] > cut[node]
        child = (np.cumsum(feature >= 0) - 1)[node] * 2 + right
        node = child
    return shares


def _routed(top: dict, bins: np.ndarray) -> np.ndarray:
    """The node of every row under the splits made so far: {node: (input, cut, left node, right node)}."""
    node = np.zeros(len(bins), np.int64)
    for number in sorted(top):  # children have larger numbers than their parents
        feature, cut, low, high = top[number]
        own = np.flatnonzero(node == number)
        node[own] = np.where(bins[own, feature] > cut, high, low)
    return node


def fold_votes(data: DataFrame, inputs: Sequence[str], classes: int, folds: int, trees: int, depth: int, seed: int = 0,
               node_rows: int = NODE_ROWS) -> DataFrame:
    """(fold, y_true, y_pred) of rows (id, fold, y, inputs): the prediction of the trees grown without the row's fold."""
    quantiles = data.approxQuantile(list(inputs), [k / BINS for k in range(1, BINS)], 0.001)
    edges = [np.unique(q) for q in quantiles]
    kind, wide = record(len(inputs)), len(inputs)
    rows = cut_lineage(data.select(F.xxhash64("id").alias("id"), F.col("fold").cast("int").alias("fold"), F.col("y").cast("int").alias("y"),
                                   *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)]))
    tops: dict[tuple[int, int], dict] = {}
    ends: dict[tuple[int, int, int], np.ndarray] = {}
    depths: dict[tuple[int, int, int], int] = {}

    def read(batch):
        out = np.zeros(batch.num_rows, kind)
        out["id"], out["y"] = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for i in range(wide):
            out["bins"][:, i] = np.searchsorted(edges[i], batch.column(3 + i).to_numpy(), side="left")
        return out, batch.column(1).to_numpy()

    large = [(f, t, 0) for f in range(folds) for t in range(trees)] if rows.count() > node_rows else []
    while large:
        wanted: dict[tuple[int, int], list[int]] = {}
        for f, t, n in large:
            wanted.setdefault((f, t), []).append(n)

        def count(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int, int], np.ndarray] = {}
            for batch in batches:
                out, fold = read(batch)
                for (f, t), numbers in wanted.items():
                    weight, node = draws(out["id"], seed, f * trees + t), _routed(tops.get((f, t), {}), out["bins"])
                    for n in numbers:
                        own = np.flatnonzero((node == n) & (fold != f) & (weight > 0))
                        cell = (np.arange(wide) * BINS + out["bins"][own]) * classes + out["y"][own].astype(np.int64)[:, None]
                        found = np.bincount(cell.ravel(), np.repeat(weight[own], wide), wide * BINS * classes)
                        sums[f, t, n] = sums[f, t, n] + found if (f, t, n) in sums else found
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [
                pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["fold", "tree", "node", "counts"])

        def split(part: pa.Table) -> pa.Table:
            f, t, n = (part.column(c)[0].as_py() for c in ("fold", "tree", "node"))
            counts = np.sum([np.frombuffer(v.as_buffer()) for v in part.column("counts")], axis=0).reshape(1, wide, BINS, classes)
            feature, cut, gain = best_splits(counts, some_inputs(np.random.default_rng([seed, f, t, n]), 1, wide))
            below = counts[0, feature[0], :cut[0] + 1].sum()
            whole = counts[0, 0].sum(axis=0)
            return pa.table({"fold": pa.array([f], pa.int32()), "tree": pa.array([t], pa.int32()), "node": pa.array([n], pa.int32()), "feature": pa.array([feature[0] if gain[0] > 1e-9 else -1], pa.int32()),
                             "cut": pa.array([cut[0]], pa.int32()), "low": [float(below)], "high": [float(whole.sum() - below)], "whole": [whole.tolist()]})

        found = rows.mapInArrow(count, "fold INT, tree INT, node INT, counts BINARY").groupBy("fold", "tree", "node").applyInArrow(
            split, "fold INT, tree INT, node INT, feature INT, cut INT, low DOUBLE, high DOUBLE, whole ARRAY<DOUBLE>").collect()
        large = []
        for r in sorted(found, key=lambda r: (r.fold, r.tree, r.node)):
            level = depths.get((r.fold, r.tree, r.node), 0)
            if r.feature < 0 or level >= depth:
                ends[r.fold, r.tree, r.node] = np.array(r.whole) / max(sum(r.whole), 1)
                continue
            top = tops.setdefault((r.fold, r.tree), {})
            children = 2 * len(top) + 1, 2 * len(top) + 2
            top[r.node] = (r.feature, r.cut, *children)
            for child, size in zip(children, (r.low, r.high)):
                depths[r.fold, r.tree, child] = level + 1
                if size > node_rows:
                    large.append((r.fold, r.tree, child))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, fold = read(batch)
            for f in range(folds):
                held, keys, packed = fold == f, [], []
                for t in range(trees):
                    own = out.copy()
                    own["weight"] = np.where(held, 0, draws(out["id"], seed, f * trees + t))
                    used, node = held | (own["weight"] > 0), _routed(tops.get((f, t), {}), out["bins"])
                    for n in np.unique(node[used]).tolist():
                        part = own[used & (node == n) & (held if (f, t, n) in ends else True)]
                        if len(part):
                            keys.append((f, t, n))
                            packed.append(part.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array(packed, pa.binary())],
                                                 ["fold", "tree", "node", "rows"])

    def grow(part: pa.Table) -> pa.Table:
        f, t, n = (part.column(c)[0].as_py() for c in ("fold", "tree", "node"))
        own = np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in part.column("rows")])
        held = own["weight"] == 0
        shares = np.tile(ends[f, t, n], (len(own), 1)) if (f, t, n) in ends else grown(
            own, classes, depth - depths.get((f, t, n), 0), np.random.default_rng([seed, f, t, n]))
        return pa.table({"fold": pa.array(np.full(held.sum(), f), pa.int32()), "id": own["id"][held], "y_true": pa.array(own["y"][held], pa.int32())} | {
            f"p{c}": shares[held, c] for c in range(classes)})

    columns = ", ".join(f"p{c} DOUBLE" for c in range(classes))
    dealt = rows.mapInArrow(deal, "fold INT, tree INT, node INT, rows BINARY")
    votes = dealt.groupBy("fold", "tree", "node").applyInArrow(grow, f"fold INT, id BIGINT, y_true INT, {columns}")
    summed = votes.groupBy("fold", "id", "y_true").agg(*[F.sum(f"p{c}").alias(f"p{c}") for c in range(classes)])
    shares = F.array(*[F.round(f"p{c}", 9) for c in range(classes)])
    return summed.select("fold", F.col("y_true").cast("double").alias("y_true"),
                         (F.array_position(shares, F.array_max(shares)) - 1).cast("double").alias("y_pred"))
