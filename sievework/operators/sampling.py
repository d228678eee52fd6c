"""Seeded samples per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.ranks import first_per_group, seeded_hash
from sievework.session import small_table


def sample_per_group(df: DataFrame, groups: Sequence[str], id_col: str, n: int, seed: int | str) -> DataFrame:
    """At most n rows per group, drawn in seeded hash order."""
    return first_per_group(df, groups, [seeded_hash(seed, id_col), id_col], n)


def audit_sample(manifest: DataFrame, per_group: int, exceptions: Mapping[tuple[str, str], int], seed: int | str) -> DataFrame:
    """Usable labelled rows drawn per (dataset, label), with other sizes for the listed groups.

    The largest size cuts every group before the shuffle; the group's own size cuts the rest.
    """
    spark = manifest.sparkSession
    pool = manifest.filter((F.col("status") == "use") & (F.coalesce("source_label", F.lit("")) != ""))
    largest = max([per_group, *exceptions.values()])
    order = [seeded_hash(seed, "image_id"), "image_id"]
    within = Window.partitionBy("dataset_id", "source_label").orderBy(*order)
    ranked = pool.withColumn("_rn", F.row_number().over(within)).filter(F.col("_rn") <= largest)
    if exceptions:
        sizes = small_table(spark, [(d, l, n) for (d, l), n in exceptions.items()],
                            "dataset_id STRING, source_label STRING, _limit INT")
        ranked = ranked.join(sizes, ["dataset_id", "source_label"], "left")
    else:
        ranked = ranked.withColumn("_limit", F.lit(None).cast("int"))
    kept = ranked.filter(F.col("_rn") <= F.coalesce("_limit", F.lit(per_group)))
    return kept.select(*manifest.columns)

