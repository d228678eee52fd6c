"""What a re-run may keep and what it has to redo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_VERSION = "1"


def current_cache(cache: DataFrame, version: str) -> DataFrame:
    """Cache rows of this version; rows from before versioning count as version 1.

    Both conditions are plain filters on the partition column, so other versions are not read.
    """
    ours = F.col("hash_version") == version
    if version == FIRST_VERSION:
        ours = ours | F.col("hash_version").isNull() | (F.col("hash_version") == "")
    return cache.filter(ours)


def cache_hits(items: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Items with their cache row; a key that the cache repeats counts once, so no item is multiplied."""
    return items.join(cache.drop("hash_version").dropDuplicates([key]), key)


def cache_misses(items: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return items.join(cache.select(key), key, "left_anti")


def up_to_date(selected: DataFrame, index: DataFrame) -> DataFrame:
    """Selected rows whose output exists for the same content."""
    return selected.join(index, ["image_id", "sha256"], "left_semi")


def to_build(selected: DataFrame, index: DataFrame) -> DataFrame:
    return selected.join(index, ["image_id", "sha256"], "left_anti")


def missing(selected: DataFrame, outputs: DataFrame) -> DataFrame:
    return selected.select("image_id").join(outputs, "image_id", "left_anti")


def stale(outputs: DataFrame, selected: DataFrame) -> DataFrame:
    return outputs.join(selected.select("image_id"), "image_id", "left_anti")


def build_counts(selected: DataFrame, index: DataFrame) -> DataFrame:
    """One row: wanted, up_to_date, to_build, missing, stale, from one full join of the two tables."""
    left = selected.select("image_id", F.col("sha256").alias("want"), F.lit(True).alias("wanted"))
    right = index.select("image_id", F.col("sha256").alias("have"), F.lit(True).alias("exists"))
    both = left.join(right, "image_id", "full")
    same = F.col("wanted") & F.coalesce(F.col("want") == F.col("have"), F.lit(False))
    return both.agg(
        F.count_if("wanted").alias("wanted"), F.count_if(same).alias("up_to_date"),
        F.count_if(F.col("wanted") & ~F.coalesce(F.col("want") == F.col("have"), F.lit(False))).alias("to_build"),
        F.count_if(F.col("wanted") & F.col("exists").isNull()).alias("missing"),
        F.count_if(F.col("wanted").isNull()).alias("stale"))


def next_index(selected: DataFrame, index: DataFrame, built: DataFrame, prune: bool = False) -> DataFrame:
    """The index after a build: new entries replace old ones; rows no longer selected leave only on request."""
    kept = index.join(built.select("image_id"), "image_id", "left_anti")
    after = kept.unionByName(built.select("image_id", "sha256"))
    return after.join(selected.select("image_id"), "image_id", "left_semi") if prune else after
