"""Near-duplicate vectors by cross-polytope hashing.

A vector is scaled to length one, padded to a power of two and put through three rounds of random signs and the fast
Hadamard transform. The hash is the axis, with its sign, that the rotated vector is nearest to. A table's key joins
`hashes` of them. Multiprobe: a vector also enters the buckets that its next nearest axes give, least loss first,
`probes` in all. Vectors that share a bucket are compared in double precision; equal ones are one class from the start.

Buckets with one vector are dropped before any vector is moved, larger ones are cut into blocks that meet
pairwise, and a pair is counted in the first bucket that it shares only. Each bucket gives a number of links per
vector and a spanning forest, never its pairs.

Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing. Vectors of different dimensions
do not meet: the dimension is part of a vector's class and of a bucket's key. Rows without an id count as copies but are
not named. Repeated ids are separate vectors. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import attach, block_pairs, bounded_batches, components, forest, whole_units
from sievework.session import cut_lineage

TABLES, HASHES, PROBES = 10, 3, 4
UNIT_ROWS = 1024
SEED = 7


def valid_vector(column: str) -> Column:
    """True for a vector of finite numbers that is not all zero."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(column, lambda x: x != 0), F.lit(False))


def vector_key(column: str) -> Column:
    """A name for equal vectors: their dimension and 128 bits of hash. Adding zero makes the two zeros one."""
    plain = F.transform(column, lambda x: x + F.lit(0.0))
    return F.concat_ws("-", F.size(column), F.hex(F.xxhash64(plain)), F.hex(F.xxhash64(F.lit("second"), plain)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def probe_keys(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Keys (row, table, probe) of unit vectors, the first probe being the vector's own bucket."""
    size = max(2, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size))
    padded[:, :x.shape[1]] = x
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, hashes, 3, size))
    out = np.empty((len(x), tables, probes), np.int64)
    for t in range(tables):
        axes, losses = [], []
        for h in range(hashes):
            turned = padded
            for sign in signs[t, h]:
                turned = hadamard(turned * sign)
            order = np.argsort(-np.abs(turned), axis=1)[:, :probes]
            value = np.take_along_axis(turned, order, axis=1)
            axes.append(2 * order + (value < 0))
            losses.append(np.abs(value[:, :1]) - np.abs(value))
        key, loss = axes[0], losses[0]
        for axis, more in zip(axes[1:], losses[1:], strict=True):
            key = (key[:, :, None] * (2 * size) + axis[:, None]).reshape(len(x), -1)
            loss = (loss[:, :, None] + more[:, None]).reshape(len(x), -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            key, loss = np.take_along_axis(key, best, axis=1), np.take_along_axis(loss, best, axis=1)
        short = probes - key.shape[1]
        out[:, t] = np.pad(key, ((0, 0), (0, short)), mode="edge") if short > 0 else key
    return out


def vector_classes(rows: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """A row per distinct vector of rows (id, v, vkey): c, vkey, rep (smallest id), n (rows), v, and its keys."""
    classes = rows.groupBy("vkey").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = classes.withColumn("c", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.empty((batch.num_rows, tables * probes), np.int64)
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = _matrix(batch.column("v").take(pa.array(at)))
                own = probe_keys(_unit(x), tables, hashes, probes)
                keys[at] = (own * tables + np.arange(tables)[:, None]).reshape(len(at), -1)
            flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables * probes, dtype=np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "keys"])

    schema = "vkey STRING, rep BIGINT, n BIGINT, v ARRAY<DOUBLE>, c BIGINT, keys ARRAY<BIGINT>"
    return classes.mapInArrow(run, schema)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def first_meetings(key: np.ndarray, a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether `key` is the first bucket that rows a and b share: the first table, and in it the smallest key."""
    out = np.empty(len(a), bool)
    tables = keys.shape[1]
    for start in range(0, len(a), 20_000):
        part = slice(start, start + 20_000)
        ka, kb = keys[a[part]], keys[b[part]]
        same = (ka[:, :, :, None] == kb[:, :, None, :]).any(axis=3)
        table = same.any(axis=2).argmax(axis=1)
        row = np.arange(len(ka))
        low = np.where(same[row, table], ka[row, table], np.iinfo(np.int64).max).min(axis=1)
        out[part] = (table == key[part] % tables) & (low == key[part])
    return out


def near_pairs(x: np.ndarray, starts: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in the same unit with a product of at least `threshold`."""
    ends = np.append(starts[1:], len(x))
    small = ends - starts <= 32
    unit = np.repeat(np.where(small, np.arange(len(starts)), -1), ends - starts)
    left, shift = np.flatnonzero(unit >= 0), 0
    while len(left):
        shift += 1
        left = left[left + shift < len(x)]
        left = left[unit[left] == unit[left + shift]]
        near = left[np.einsum("ij,ij->i", x[left], x[left + shift]) >= threshold]
        yield near, near + shift
    for start, end in zip(starts[~small], ends[~small], strict=True):
        for at in range(start, end, 512):
            a, b = np.nonzero(x[at:at + 512][: end - at] @ x[start:end].T >= threshold)
            ahead = b + start > a + at
            yield a[ahead] + at, b[ahead] + start


def bucket_links(classes: DataFrame, tables: int, probes: int, threshold: float) -> DataFrame:
    """Rows (c, links, a, b): links that class c has in one bucket, and an edge (a, b) of a spanning forest there."""
    places = classes.select(F.size("v").alias("d"), F.explode(F.array_distinct("keys")).alias("key"), "c")
    dealt = block_pairs(places, ["d", "key"], "c", UNIT_ROWS, least=2)
    dealt = dealt.join(classes.select("c", "v", "keys", "n", "rep"), "c")
    unit = ["d", "key", "_i", "_j"]

    def links_of(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        x = _unit(_matrix(rows.column("v")))
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(x), tables, probes)
        key, n, c = (rows.column(k).to_numpy() for k in ("key", "n", "c"))
        block, crossed = rows.column("_b").to_numpy(), (rows.column("_i").to_numpy() != rows.column("_j").to_numpy())
        rep = rows.column("rep").to_numpy(zero_copy_only=False)
        links, label, found = np.zeros(len(x), np.int64), np.arange(len(x)), []
        for a, b in near_pairs(x, starts, threshold):
            keep = ~crossed[a] | (block[a] != block[b])
            a, b = a[keep], b[keep]
            found += [a, b]
            if sum(map(len, found)) > 1 << 20:
                label = forest(len(x), np.concatenate([label, *found[::2]]), np.concatenate([np.arange(len(x)), *found[1::2]]))
                found = []
            first = first_meetings(key[a], a, b, keys)
            np.add.at(links, a[first], n[b[first]])
            np.add.at(links, b[first], n[a[first]])
        label = forest(len(x), np.concatenate([label, *found[::2]]), np.concatenate([np.arange(len(x)), *found[1::2]]))
        out = np.flatnonzero((links > 0) | (label != np.arange(len(x))))
        return pa.RecordBatch.from_arrays(
            [pa.array(c[out]), pa.array(links[out]), pa.array(rep[out], pa.int64(), from_pandas=True),
             pa.array(rep[label[out]], pa.int64(), from_pandas=True)], ["c", "links", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_units(batches, unit):
            # units are sorted by dimension, and each dimension is a matrix of its own
            d = rows.column("d").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(d)) + 1), len(d)]
            for low, high in zip(edges, edges[1:], strict=False):
                own = starts[(starts >= low) & (starts < high)] - low
                yield links_of(rows.slice(low, high - low).combine_chunks(), own)

    return dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "c BIGINT, links BIGINT, a BIGINT, b BIGINT")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                           tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id (smallest id reached), kept."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("vkey", F.when(valid_vector("v"), vector_key("v")))
    classes = cut_lineage(vector_classes(rows.filter("vkey IS NOT NULL"), tables, hashes, probes))
    found = cut_lineage(bucket_links(classes, tables, probes, threshold))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    reached = components(found.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b"))
    named = classes.select("c", "vkey", "rep", "n").join(links, "c", "left").join(
        reached, F.col("rep") == F.col("node"), "left")
    named = cut_lineage(named.select("vkey", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                                     F.coalesce("component", "rep").alias("component_id"), "n"))
    key = F.coalesce("vkey", F.concat(F.lit("~"), F.col("id").cast("string"), F.lit("~")))
    spread = F.concat(F.lit("~"), F.xxhash64("id").cast("string"))
    done = attach(rows.select("id", key.alias("vkey")), named, "vkey", "n", spread)
    component = F.coalesce("component_id", "id")
    return done.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                       component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
