"""Ranks that do not put a whole group, or the whole table, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut_lineage


def seeded_hash(seed: int | str, id_col: str) -> Column:
    """The shuffle key of every seeded sample and split: uniform, and the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def group_key(groups: Sequence[str]) -> Column:
    """One key for some columns: a struct is never NULL, so NULL values join and group like others."""
    return F.struct(*groups) if groups else F.lit(0)


def hash_ranked(df: DataFrame, groups: Sequence[str], id_col: str, seed: int | str,
                rank: str = "_rank", size: str = "_size", digits: int = 3) -> DataFrame:
    """Add the exact 1-based rank of each row in its group by seeded hash order, and the group size.

    Hashes are uniform, so a group is cut by the first `digits` hex digits into equal slices. A slice's
    first rank follows from the (pre-aggregated) slice counts, and rows are only sorted within a slice:
    a group with a third of all rows is spread over 16**digits slices. NULL is a group value like any other.
    """
    slices = ["_group", "_slice"]
    keyed = df.withColumns({"_group": group_key(groups), "_hash": seeded_hash(seed, id_col)}).withColumn(
        "_slice", F.coalesce(F.substring("_hash", 1, digits), F.lit("")))
    counts = keyed.groupBy(*slices).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*slices, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"),
                           F.sum("_c").over(whole).alias(size))
    in_slice = Window.partitionBy(*slices).orderBy("_hash", id_col)
    ranked = keyed.withColumn("_in_slice", F.row_number().over(in_slice)).join(starts, slices)
    return ranked.withColumn(rank, F.col("_start") + F.col("_in_slice")).drop("_group", "_hash", "_slice", "_in_slice", "_start")


def first_per_group(df: DataFrame, groups: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each group. Spark cuts each group to n rows before it shuffles them."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def dense_ids(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """Number the rows 1, 2, 3 … in a global order, without a single-partition window.

    The rows are range-sorted and written once; only one count per sorted partition is summed up.
    """
    mask = (1 << 33) - 1
    ordered = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    # one row per sorted partition: bounded by the partition count, whatever the data size
    numbered = ordered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.col("_start") + F.col("_mid").bitwiseAND(F.lit(mask)) + 1).drop(
        "_part", "_start", "_mid")
