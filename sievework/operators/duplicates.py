"""Duplicate groups: keep order, leaders, outcomes, row changes and the report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import is_reviewed, label_identity
from sievework.operators.near_duplicates import BUCKET_ROWS, leader_links
from sievework.operators.quality import unknown_source
from sievework.operators.ranks import dense_ids
from sievework.operators.skew import HOT_ROWS, left_join_weighted
from sievework.session import cut_lineage

DEFAULT_THRESHOLD = 4


@dataclass
class DuplicateResult:
    manifest: DataFrame  # input rows with status, reason, class, duplicate_of, dup_group settled
    groups: DataFrame    # one row per group of two or more rows
    links: DataFrame     # (phash64, dup_group, leader_phash64) of every fingerprint in a group


def takes_part() -> Column:
    """Rows with a fingerprint that are in use or on hold, or that a reviewer excluded."""
    return F.col("phash64").isNotNull() & (
        F.col("status").isin("use", "hold") | ((F.col("status") == "exclude") & is_reviewed(F.col("reason"))))


def keep_key() -> Column:
    """Smaller is kept first: reviewed, then use before hold, larger area, source priority, place."""
    area = F.coalesce(F.col("width"), F.lit(0)).cast("bigint") * F.coalesce(F.col("height"), F.lit(0))
    status_rank = F.when(F.col("status") == "use", 0).when(F.col("status") == "hold", 1).otherwise(2)
    return F.struct(
        F.when(is_reviewed(F.col("reason")), 0).otherwise(1).alias("k1"), status_rank.alias("k2"),
        (-area).alias("k3"), F.col("priority").alias("k4"), F.col("member_path").alias("k5"),
        F.col("archive").alias("k6"), F.col("image_id").alias("k7"))


def _differs(low: str, high: str) -> Column:
    """More than one distinct non-NULL value, from the smallest and the largest."""
    return F.coalesce(F.col(low) != F.col(high), F.lit(False))


def resolve_duplicates(manifest: DataFrame, priority: DataFrame, threshold: int = DEFAULT_THRESHOLD,
                       bucket_rows: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS) -> DuplicateResult:
    """Group exact and near copies, keep one row per group, settle label conflicts.

    `manifest` has the manifest columns plus phash64 and should be a stored table, as it is read three
    times; `priority` is (dataset_id, priority), and a row of another source stops the run. All copies of one
    fingerprint collapse in the map-side aggregate first; groups are then put together from one row per
    fingerprint, so a group with a third of all rows costs no more than any other.
    """
    if not 0 <= threshold <= 64:
        raise ValueError("threshold must be between 0 and 64")
    columns = manifest.columns
    listed = priority.select("dataset_id", "priority", F.lit(True).alias("_listed"))
    ranked = manifest.join(listed, "dataset_id", "left").withColumn(
        "status", F.when(F.col("_listed").isNull(), unknown_source()).otherwise(F.col("status")))
    expert = F.when(is_reviewed(F.col("reason")) & (F.col("status") == "use"), F.col("class_id"))
    identity = label_identity(F.col("class_id"), F.col("dataset_id"), F.col("source_label"))
    split = F.nullif(F.col("split_source"), F.lit(""))
    per_fingerprint = ranked.filter(takes_part()).groupBy("phash64").agg(
        F.min(F.struct(keep_key().alias("key"), F.col("image_id"), F.col("status"), F.col("sha256"),
                       is_reviewed(F.col("reason")).alias("reviewed"))).alias("best"),
        F.count("*").alias("size"),
        F.min(expert).alias("expert_low"), F.max(expert).alias("expert_high"),
        F.min(identity).alias("label_low"), F.max(identity).alias("label_high"),
        F.min(split).alias("split_low"), F.max(split).alias("split_high"),
        F.collect_set(F.struct("dataset_id", F.coalesce("source_label", F.lit("")).alias("label"))).alias("labels"))
    nodes = dense_ids(per_fingerprint, ["best.key"], "rank")
    links = leader_links(nodes.select(F.col("phash64").alias("fp"), "rank"), threshold, bucket_rows)
    placed = nodes.join(links, "rank", "left").withColumn("leader_rank", F.coalesce("leader_rank", "rank"))
    grouped = placed.groupBy("leader_rank").agg(
        F.min_by("best", "rank").alias("leader"), F.min_by("phash64", "rank").alias("leader_phash64"),
        F.sum("size").alias("size"),
        F.min("expert_low").alias("expert_low"), F.max("expert_high").alias("expert_high"),
        F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"),
        F.min("split_low").alias("split_low"), F.max("split_high").alias("split_high"),
    ).filter(F.col("size") > 1)
    # distinct (source, label) pairs only, so bounded by the label vocabulary and not by the group
    labels = (placed.select("leader_rank", F.explode("labels").alias("l")).groupBy("leader_rank")
              .agg(F.collect_set("l").alias("labels")))
    outcome = (
        F.when(F.col("leader.reviewed") & (F.col("leader.status") == "exclude"), "copies_of_rejected")
        .when(_differs("expert_low", "expert_high")
              | (F.col("expert_low").isNull() & _differs("label_low", "label_high")), "label_conflict")
        .otherwise("kept_one"))
    numbered = dense_ids(grouped.join(labels, "leader_rank"), ["leader_rank"], "no")
    groups = cut_lineage(numbered.select(
        F.format_string("D%05d", "no").alias("dup_group"), "leader_rank", "leader_phash64", "size",
        outcome.alias("outcome"), F.col("leader.image_id").alias("leader_id"),
        F.col("leader.sha256").alias("leader_sha256"),
        _differs("expert_low", "expert_high").alias("experts_disagree"),
        F.array_sort(F.array_distinct("labels.dataset_id")).alias("datasets"),
        F.array_sort(F.transform("labels", lambda l: F.concat_ws(":", l["dataset_id"], l["label"]))).alias("labels"),
        (F.size(F.array_distinct("labels.dataset_id")) > 1).alias("cross_dataset"), _differs("split_low", "split_high").alias("cross_split")))
    in_group = cut_lineage(
        placed.select("phash64", "leader_rank", F.col("size").alias("copies"))
        .join(groups.drop("datasets", "labels"), "leader_rank"))

    # a fingerprint that a large part of all rows share is joined without moving those rows
    member = left_join_weighted(
        manifest.filter(takes_part()),
        in_group.select("phash64", F.col("dup_group").alias("_group"), "outcome", "leader_id", "leader_sha256",
                        "experts_disagree", "copies"), "phash64", "copies", floor=hot_rows)
    reviewed = is_reviewed(F.col("reason"))
    grouped_row = F.col("_group").isNotNull()
    conflict = grouped_row & (F.col("outcome") == "label_conflict") & ~(reviewed & ~F.col("experts_disagree"))
    copy = grouped_row & ~conflict & ~reviewed & (F.col("image_id") != F.col("leader_id"))
    copy_reason = (F.when(F.col("outcome") == "copies_of_rejected", "duplicate_of_rejected")
                   .when(F.col("sha256") == F.col("leader_sha256"), "exact_duplicate").otherwise("near_duplicate"))
    changed = member.withColumns({
        "status": F.when(conflict | copy, "exclude").otherwise(F.col("status")),
        "reason": F.when(conflict, "duplicate_label_conflict").when(copy, copy_reason).otherwise(F.col("reason")),
        "duplicate_of": F.when(copy, F.col("leader_id")).otherwise(F.col("duplicate_of")),
        "dup_group": F.coalesce("_group", "dup_group")})
    # rows without a part in it are not sent through the join, where their NULL keys would pile up
    rest = manifest.filter(~F.coalesce(takes_part(), F.lit(False)))
    return DuplicateResult(changed.select(*columns).unionByName(rest.select(*columns)), groups,
                           in_group.select("phash64", "dup_group", "leader_phash64"))


def duplicate_report(groups: DataFrame) -> DataFrame:
    """The group report; members are rows of the manifest (`duplicate_members`), not a packed string."""
    return groups.select(
        "dup_group", "size", "outcome", (F.col("outcome") == "label_conflict").alias("label_conflict"),
        F.concat_ws(" | ", "datasets").alias("datasets"), "cross_dataset", "cross_split",
        F.when(F.col("outcome") == "kept_one", F.col("leader_id")).alias("canonical"),
        F.concat_ws(" | ", "labels").alias("labels"))


def duplicate_members(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("dup_group").isNotNull()).select("dup_group", "image_id", "dataset_id", "source_label")


def duplicate_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("dup_groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("items"),
        F.count_if("cross_dataset").alias("cross_dataset"), F.count_if("cross_split").alias("cross_split"),
        F.count_if("label_conflict").alias("label_conflict"),
        F.count_if(F.col("outcome") == "copies_of_rejected").alias("copies_of_rejected"))


def cross_dataset_pairs(report: DataFrame) -> DataFrame:
    return report.filter("cross_dataset").groupBy("datasets").agg(F.count("*").alias("dup_groups"))
