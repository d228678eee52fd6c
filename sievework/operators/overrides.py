"""Reviewer decisions on single items: validation, application, and the upsert of new decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import REVIEW_PREFIX

# Actions a decision can have.
ACTIONS = ["exclude", "use", "hold"]


class OverrideError(ValueError):
    pass


def latest_decisions(decisions: DataFrame, seq: str, key: str = "image_id") -> DataFrame:
    """The last decision per item by sequence. An aggregate, not a window: one hot item does not skew it."""
    others = [c for c in decisions.columns if c != key]
    newest = decisions.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("d"))
    return newest.select(key, "d.*")


def override_violations(overrides: DataFrame, manifest: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(image_id, problem) for each decision that must stop the run."""
    classes = taxonomy.select(F.col("class_id"), F.lit(True).alias("known_class")).distinct()
    rows = manifest.select("image_id", F.col("phash64").isNotNull().alias("hashed"))
    action = F.coalesce(F.trim("action"), F.lit(""))
    problem = (
        F.when(~action.isin(ACTIONS), "unknown action")
        .when((action == "use") & F.col("known_class").isNull(), "'use' needs a class of the taxonomy")
        .when((action == "use") & ~F.coalesce("hashed", F.lit(True)), "item was never hashed"))
    return (
        overrides.withColumn("class_id", F.trim("class_id")).withColumn("image_id", F.trim("image_id"))
        .join(classes, "class_id", "left").join(rows, "image_id", "left")
        .select("image_id", problem.alias("problem")).filter(F.col("problem").isNotNull()))


def unknown_overrides(overrides: DataFrame, manifest: DataFrame) -> DataFrame:
    """Decisions on items that are not in the manifest: reported, never fatal."""
    return overrides.join(manifest.select("image_id"), "image_id", "left_anti")


def _reason():
    return F.concat(F.lit(REVIEW_PREFIX), F.trim(F.coalesce(F.nullif("reason", F.lit("")), F.lit("unspecified"))))


def apply_overrides(manifest: DataFrame, overrides: DataFrame, taxonomy: DataFrame, seq: str) -> DataFrame:
    """Manifest with every decision applied; the last decision of an item wins.

    A class is set by `use`, cleared by `exclude` and kept by `hold`. Stops on an invalid decision.
    """
    bad = override_violations(overrides, manifest, taxonomy)
    count = bad.count()
    if count:
        some = "; ".join(f"{row.image_id}: {row.problem}" for row in bad.limit(20).collect())
        raise OverrideError(f"{count} invalid decisions (see override_violations), among them: {some}")
    return apply_valid_overrides(manifest, overrides, seq)


def apply_valid_overrides(manifest: DataFrame, overrides: DataFrame, seq: str) -> DataFrame:
    last = latest_decisions(overrides.withColumn("image_id", F.trim("image_id")), seq).select(
        "image_id", F.trim("action").alias("_action"), F.nullif(F.trim("class_id"), F.lit("")).alias("_class"),
        _reason().alias("_reason"))
    decided = F.col("_action").isNotNull()
    new_class = F.when(F.col("_action") == "use", F.col("_class")).when(F.col("_action") == "hold", F.col("class_id"))
    return manifest.join(last, "image_id", "left").withColumns({
        "status": F.coalesce("_action", "status"),
        "reason": F.coalesce("_reason", "reason"),
        "class_id": F.when(decided, new_class).otherwise(F.col("class_id")),
    }).select(*manifest.columns)


def override_counts(overrides: DataFrame, manifest: DataFrame) -> DataFrame:
    """Applied decisions per reason (every row counts, also those a later row replaces)."""
    known = overrides.join(manifest.select("image_id"), "image_id", "left_semi")
    return known.groupBy(_reason().alias("reason")).agg(F.count("*").alias("items"))


def upsert_decisions(current: DataFrame, fresh: DataFrame, seq: str = "decided_at") -> DataFrame:
    """Current decisions with new ones put in; the newest one of an item stays."""
    columns = current.columns
    both = current.withColumn("_seq", F.struct(F.lit(0).alias("a"), F.col(seq).alias("b"))).unionByName(
        fresh.select(*columns).withColumn("_seq", F.struct(F.lit(1).alias("a"), F.col(seq).alias("b"))))
    return latest_decisions(both, "_seq").select(*columns)
