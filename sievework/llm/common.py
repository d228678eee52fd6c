"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import builtins
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import cut_lineage

# A key is hot above this share of all rows, so at most 1 / HOT_SHARE hot keys are ever broadcast.
HOT_SHARE = 0.001
BATCH_ROWS = 1024
# Whitespace runs from this length on do not go through tiktoken's split; 600,000 characters were found to work.
LONG_RUN = 1 << 18


def once_per_worker(key: str, build: Callable[[], Any]) -> Any:
    """`build()` once for each Python worker; later tasks in the same worker find the result again."""
    store = builtins.__dict__.setdefault("_sievework_worker", {})
    if key not in store:
        store[key] = build()
    return store[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of texts hold few rows, so that long texts do not add up in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def whole_encoder(quick, pattern: str) -> Callable[[str], list[int]]:
    """The ids of a text by a tiktoken encoding with the split `pattern`, whatever the text.

    tiktoken's own split overflows its stack where a lookahead follows some 1,000,000 whitespace characters. A text with a
    run of LONG_RUN or more is split by `regex`, and each match is merged alone.
    """
    import re

    import regex
    # `\s` of `re` holds all that of the pattern does
    long_run, split = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}"), regex.compile(pattern)

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN or not long_run.search(text):
            return quick.encode_ordinary(text)
        return [i for piece in split.finditer(text) for i in quick._encode_single_piece(piece.group())]
    return encode


def text_groups(texts: Sequence[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `chars` characters together; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def attach(big: DataFrame, small: DataFrame, key: str, weight: str, spread: Column) -> DataFrame:
    """`big` left join `small` on `key`, where `small` has one row per key and `weight` counts its rows in `big`.

    Keys above HOT_SHARE of all rows are broadcast (at most 1 / HOT_SHARE rows); their rows are then dealt by
    `spread`, a value of the key's type that differs from row to row, and not by the key. `small` is read
    three times, so it should be a written table.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    limit = max(1000, int(total * HOT_SHARE))
    hot = small.filter(F.col(weight) > limit)
    rest = [c for c in small.columns if c != key]
    if total <= limit or hot.isEmpty():
        return big.join(small, key, "left")
    packed = big.join(F.broadcast(hot.select(key, F.struct(*rest).alias("_hot"))), key, "left")
    packed = packed.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread))
    cold = small.filter(F.col(weight) <= limit).select(F.col(key).alias("_key"), F.struct(*rest).alias("_cold"))
    joined = packed.join(cold, "_key", "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*big.columns, *[found[c].alias(c) for c in rest])


def block_pairs(rows: DataFrame, keys: Sequence[str], item: str, limit: int, least: int = 1) -> DataFrame:
    """Deal the rows of each key into units (`_i`, `_j`) of at most about 2 * limit rows.

    A key with up to `limit` rows is one unit (0, 0). A larger one is cut into blocks by a hash of `item`, and
    every two blocks meet in one unit, so all pairs of rows meet and no unit grows with the key. `_b` is the
    row's own block: a pair belongs to unit (i, j) when its blocks are i and j. Keys with fewer than `least`
    rows are left out.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    counts = counts.filter(F.col("_n") >= least if least > 1 else F.col("_n") > limit)
    blocks = counts.select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_nb"))
    dealt = rows.join(blocks, list(keys), "inner" if least > 1 else "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64(item), F.col("_nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_o")
    dealt = dealt.select(*rows.columns, "_b", other)
    return dealt.select(*rows.columns, "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))


def whole_units(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted Arrow batches as tables that hold whole units, each with the start positions of its units."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        starts = _starts(rows, keys)
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]).combine_chunks(), starts[:-1]
            rows = rows.slice(starts[-1])
        held = rows if rows.num_rows else None
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0])


def _starts(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    if not rows.num_rows:
        return np.array([], dtype=np.int64)
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        values = rows.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position linked to each of n positions by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), the component being its smallest node.

    Alternating large-star and small-star steps; every round is one written table. Nodes without an edge are
    not returned. A node with many neighbours contributes its minimum through a partial aggregate.
    """
    pairs = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = cut_lineage(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        last, mark = mark, _mark(pairs)
        if mark == last:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select("b", "b").distinct())


def _mark(pairs: DataFrame) -> tuple:
    """Count and checksum: equal marks of two rounds mean that nothing changed."""
    row = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]
