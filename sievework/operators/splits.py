"""Stratified train/val/test splits and folds, the same on every run and for any partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.ranks import hash_ranked
from sievework.session import small_table

STRATUM = ["dataset_id", "class_id"]


def split_sizes(n: Column, share: float = 0.1) -> tuple[Column, Column]:
    """(val, test) rows of a stratum of n: a tenth each, rounded half to even, one at least if there are enough."""
    tenth = F.greatest(F.lit(1), F.bround(n * F.lit(share), 0).cast("int"))
    val = F.when(n >= 3, F.least(tenth, n - 1)).otherwise(0)
    test = F.when(n - val >= 2, F.least(tenth, n - val - 1)).otherwise(0)
    return val, test


def stratified_split(items: DataFrame, seed: int | str, strata: Sequence[str] = STRATUM, id_col: str = "image_id",
                     caps: Mapping[tuple, int] | None = None, share: float = 0.1) -> DataFrame:
    """Add `split`: the first rows of a stratum in hash order are test, the next val, the others train.

    `caps` limits the train rows of single strata; what is over the cap becomes unused.
    """
    ranked = hash_ranked(items, strata, id_col, seed)
    val, test = split_sizes(F.col("_size"), share)
    train_rank = F.col("_rank") - test - val
    split = F.when(F.col("_rank") <= test, "test").when(train_rank <= 0, "val")
    if caps:
        # strata of any type and NULL strata are named by their text
        rows = [(*(None if k is None else str(k) for k in key), limit) for key, limit in caps.items()]
        table = small_table(items.sparkSession, rows, ", ".join(f"`{c}` STRING" for c in strata) + ", _cap INT")
        table = table.select(F.struct(*strata).alias("_stratum"), "_cap")
        ranked = ranked.withColumn("_stratum", F.struct(*[F.col(c).cast("string").alias(c) for c in strata])).join(table, "_stratum", "left")
        split = split.when(train_rank > F.col("_cap"), "unused")
    return ranked.withColumn("split", split.otherwise("train")).select(*items.columns, "split")


def stratified_folds(items: DataFrame, folds: int, seed: int | str, label: str, id_col: str = "image_id") -> DataFrame:
    """Add `fold` in 0..folds-1, with every label spread evenly over the folds."""
    ranked = hash_ranked(items, [label], id_col, seed)
    return ranked.withColumn("fold", (F.col("_rank") - 1) % folds).select(*items.columns, F.col("fold").cast("int").alias("fold"))


def split_counts(splits: DataFrame, by: str = "class_id") -> DataFrame:
    parts = ["train", "val", "test", "unused"]
    return splits.groupBy(by).agg(*[F.count_if(F.col("split") == p).alias(p) for p in parts])
