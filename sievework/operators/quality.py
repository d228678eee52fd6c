"""Per-source minimum size and sharpness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unknown_source() -> Column:
    """Fails with the name of the row's source."""
    return F.raise_error(F.concat(F.lit("source not in the registry: "), F.coalesce("dataset_id", F.lit("NULL")))).cast("string")


# Fixed value: characters of an error that a manifest keeps.
ERROR_CHARS = 200


def mark_unreadable(manifest: DataFrame) -> DataFrame:
    """Rows whose content could not be read leave the data set, with the beginning of the error kept."""
    bad = F.col("error").isNotNull()
    return manifest.withColumns({
        "status": F.when(bad, "exclude").otherwise(F.col("status")),
        "reason": F.when(bad, "unreadable_image").otherwise(F.col("reason")), "error_detail": F.left("error", F.lit(ERROR_CHARS))}).drop("error")


def apply_quality_rules(manifest: DataFrame, datasets: DataFrame) -> DataFrame:
    """Exclude rows in use or on hold that are too small or, failing that, too blurry for their source.

    `datasets` is (dataset_id, min_short_side, min_sharpness). Rows without dimensions stay as they are. A row of a
    source that is not listed stops the run.
    """
    limits = datasets.select("dataset_id", "min_short_side", "min_sharpness", F.lit(True).alias("_listed"))
    checked = F.col("status").isin("use", "hold") & F.col("width").isNotNull()
    small = checked & (F.least("width", "height") < F.col("min_short_side"))
    blurry = checked & ~small & (F.col("sharpness_256") < F.col("min_sharpness"))
    fails = F.coalesce(small | blurry, F.lit(False))
    return manifest.join(limits, "dataset_id", "left").withColumns({
        "status": F.when(F.col("_listed").isNull(), unknown_source()).when(fails, "exclude").otherwise(F.col("status")),
        "reason": F.when(fails, F.when(small, "too_small").otherwise("too_blurry")).otherwise(F.col("reason")),
    }).select(*manifest.columns)
