"""Counts, balance and size profiles of a manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import extension
from sievework.operators.quantiles import ORDER, exact_quantiles
from sievework.session import cut_lineage

STATUSES = ["use", "hold", "exclude"]
TOTAL = "Total"


# What the sections of the report group by, and the column of counted rows.
REPORT_KEYS = ["dataset_id", "crop", "class_id", "source_label", "status", "reason"]
COUNTED = "_n"


def count_items(manifest: DataFrame) -> DataFrame:
    """How many items share all of REPORT_KEYS. Written once, this small table is all that the sections of a report need:
    each of them takes a manifest or counted rows, so a report reads the manifest once."""
    return cut_lineage(manifest.groupBy(*REPORT_KEYS).agg(F.count("*").alias(COUNTED)))


def _items(df: DataFrame, where: Column | None = None) -> Column:
    """The number of items in a group of rows, or of counted rows."""
    if COUNTED not in df.columns:
        return F.count("*") if where is None else F.count_if(where)
    return F.coalesce(F.sum(COUNTED if where is None else F.when(where, F.col(COUNTED))), F.lit(0).cast("bigint"))


def active(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("status").isin("use", "hold"))


def status_by_dataset(manifest: DataFrame) -> DataFrame:
    """use / hold / exclude / total per dataset, with a grand-total row."""
    counted = manifest.rollup("dataset_id").agg(
        *[_items(manifest, F.col("status") == s).alias(s) for s in STATUSES], _items(manifest).alias("total"),
        F.grouping("dataset_id").alias("_g"))
    return counted.withColumn("dataset_id", F.when(F.col("_g") == 1, TOTAL).otherwise(F.col("dataset_id"))).drop("_g")


def status_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(_items(manifest).alias("items"))


def usable_by_class(manifest: DataFrame) -> DataFrame:
    """Usable rows per class with 'source (n)' in descending order of n, then by name."""
    per_source = manifest.filter(F.col("status") == "use").groupBy("class_id", "dataset_id").agg(_items(manifest).alias("n"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("dataset_id").alias("d")))),
                         lambda x: F.format_string("%s (%d)", x["d"], -x["m"]))
    return per_source.groupBy("class_id").agg(F.sum("n").alias("items"), F.concat_ws(", ", listed).alias("sources"))


def held_items(manifest: DataFrame) -> DataFrame:
    held = manifest.filter(F.col("status") == "hold")
    return held.groupBy("dataset_id", "source_label", "reason").agg(_items(held).alias("items"))


def exclusion_reasons(manifest: DataFrame) -> DataFrame:
    out = manifest.filter(F.col("status") == "exclude")
    return out.groupBy("reason").agg(_items(out).alias("items")).orderBy(F.desc("items"), "reason")


def count_matrix(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Count per row key and listed column value, 0 where there is none. A value that is not listed stops the run."""
    other = F.min(F.when(~F.coalesce(F.col(columns).isin(list(values)), F.lit(False)), F.coalesce(F.col(columns).cast("string"), F.lit("NULL"))))
    counted = df.groupBy(rows).agg(*[_items(df, F.col(columns) == v).alias(v) for v in values], other.alias("_other"))
    stop = F.raise_error(F.concat(F.lit(f"value of {columns} without a column: "), F.col("_other"))).cast("bigint")
    return counted.withColumns({v: F.when(F.col("_other").isNotNull(), stop).otherwise(F.col(v)) for v in values}).drop("_other")


def class_by_dataset(manifest: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Usable rows per class and dataset, smallest class first."""
    use = manifest.filter(F.col("status") == "use")
    counted = count_matrix(use, "class_id", "dataset_id", datasets)
    total = sum((F.col(d) for d in datasets), F.lit(0).cast("bigint"))
    return counted.withColumn("total", total).orderBy("total", "class_id")


def archive_counts(members: DataFrame, archives: DataFrame) -> DataFrame:
    """Per archive: rows listed, ignored, unmatched with one example; size in GB and date of the file.

    `members` is (archive, member_path, kind) with kind listed, unmatched, ignored or skipped.
    """
    counted = members.groupBy("archive").agg(
        F.count_if(F.col("kind").isin("listed", "unmatched")).alias("listed"),
        F.count_if(F.col("kind") == "skipped").alias("skipped"),
        F.count_if(F.col("kind") == "ignored").alias("ignored"),
        F.count_if(F.col("kind") == "unmatched").alias("unmatched"),
        F.min(F.when(F.col("kind") == "unmatched", F.col("member_path"))).alias("example"))
    sized = archives.withColumns({
        "size_gb": F.bround(F.col("file_bytes") / F.lit(float(1 << 30)), 2),
        "dated": F.coalesce("downloaded", F.date_format("modified", "yyyy-MM-dd"))})
    return sized.join(counted, "archive", "left").select(
        "archive", "size_gb", "dated", *[F.coalesce(c, F.lit(0)).alias(c) for c in ["listed", "skipped", "ignored", "unmatched"]],
        "example")


def ignored_extensions(members: DataFrame, path_col: str = "member_path") -> DataFrame:
    ext = F.coalesce(F.nullif(extension(F.col(path_col)), F.lit("")), F.lit("<none>"))
    return members.groupBy("archive", ext.alias("ext")).agg(F.count("*").alias("members"))


def unmapped_labels(manifest: DataFrame) -> DataFrame:
    rows = manifest.filter(F.col("reason") == "label_not_in_class_map")
    return rows.groupBy("dataset_id", "source_label").agg(_items(rows).alias("items"))


def imbalance(manifest: DataFrame) -> DataFrame:
    """Per crop: number of classes, smallest and largest class, and their ratio."""
    per_class = manifest.filter(F.col("status") == "use").groupBy("crop", "class_id").agg(_items(manifest).alias("n"))
    spread = per_class.groupBy("crop").agg(
        F.count("*").alias("classes"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    return spread.withColumn("imbalance_ratio", F.bround(F.col("largest") / F.col("smallest"), 1))


def dominance(manifest: DataFrame) -> DataFrame:
    """Largest share of a class that comes from one source."""
    per_source = manifest.filter(F.col("status") == "use").groupBy("class_id", "dataset_id").agg(_items(manifest).alias("n"))
    return per_source.groupBy("class_id").agg(F.bround(F.max("n") / F.sum("n"), 2).alias("largest_source_share"))


def majority_share(df: DataFrame, scope: str, label: str) -> DataFrame:
    """Chance level: share of the most frequent label within each scope."""
    counts = df.groupBy(scope, label).agg(_items(df).alias("n"))
    return counts.groupBy(scope).agg(F.bround(F.max("n") / F.sum("n"), 4).alias("majority_share"))


def scopes_with_labels(df: DataFrame, scope: str, label: str, at_least: int = 2) -> DataFrame:
    """Scopes that have enough distinct labels."""
    # (scope, label) pairs first: the distinct labels of a hot scope are counted, not its rows
    pairs = df.select(scope, label).filter(F.col(label).isNotNull()).distinct()
    return pairs.groupBy(scope).agg(F.count("*").alias("labels")).filter(F.col("labels") >= at_least)


def with_shape(manifest: DataFrame) -> DataFrame:
    """Add aspect and short_side."""
    aspect = F.when(F.col("height") != 0, F.col("width") / F.col("height"))
    return manifest.withColumns({"aspect": aspect, "short_side": F.least("width", "height")})


def wide_quantiles(df: DataFrame, groups: Sequence[str], named: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Quantiles as columns, one row per group; `named` is output name -> (value column, probability)."""
    wanted: dict[str, list[float]] = {}
    for value, p in named.values():
        wanted.setdefault(value, []).append(p)
    long = exact_quantiles(df, groups, wanted)
    return long.groupBy(*groups).agg(*[
        F.max(F.when((F.col("column") == value) & (F.col("prob") == float(p)), F.col("value"))).alias(name)
        for name, (value, p) in named.items()])


def size_profile(manifest: DataFrame) -> DataFrame:
    """Per dataset: rows, median width, height and aspect, 5th percentile of the short side."""
    rows = with_shape(active(manifest))
    counts = rows.groupBy("dataset_id").agg(F.count("image_id").alias("items"))
    return counts.join(wide_quantiles(rows, ["dataset_id"], {
        "median_width": ("width", .5), "median_height": ("height", .5), "min_side_p05": ("short_side", .05),
        "median_aspect": ("aspect", .5)}), "dataset_id", "left")


FIVE_NUMBERS = {"low": 0.0, "q1": .25, "median": .5, "q3": .75, "high": 1.0}


def five_numbers(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    return wide_quantiles(df, groups, {name: (value, p) for name, p in FIVE_NUMBERS.items()})


def quality_flags(manifest: DataFrame, short_side: int = 224) -> DataFrame:
    """One row: small and grayscale rows, and the middle and lowest-5% order statistics of sharpness."""
    rows = with_shape(active(manifest)).filter(F.col("width").isNotNull())
    counts = rows.agg(F.count_if(F.col("short_side") < short_side).alias("small"),
                      F.count_if("is_grayscale").alias("grayscale"))
    steps = exact_quantiles(rows, [], {"sharpness_256": [.5, .05]}, how=ORDER)
    picked = steps.agg(F.max(F.when(F.col("prob") == .5, F.col("value"))).alias("sharpness_median"),
                       F.max(F.when(F.col("prob") == .05, F.col("value"))).alias("sharpness_p05"))
    return counts.crossJoin(F.broadcast(picked))  # one row beside one row


def coverage_gaps(taxonomy: DataFrame, manifest: DataFrame) -> DataFrame:
    """Classes of the taxonomy without a usable row."""
    used = manifest.filter(F.col("status") == "use").select("class_id").distinct()
    return taxonomy.join(used, "class_id", "left_anti")


def most_removed(manifest: DataFrame, n: int = 15) -> DataFrame:
    removed = manifest.filter(F.col("reason").isin("exact_duplicate", "near_duplicate"))
    counted = removed.groupBy("dataset_id", "source_label").agg(F.count("*").alias("removed"))
    return counted.orderBy(F.desc("removed"), "dataset_id", "source_label").limit(n)


def conflict_label_sets(report: DataFrame, n: int = 10) -> DataFrame:
    counted = report.filter("label_conflict").groupBy("labels").agg(F.count("*").alias("dup_groups"))
    return counted.orderBy(F.desc("dup_groups"), "labels").limit(n)


def smallest(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n rows with the smallest values: a top-n per task, then one merge of n rows each."""
    return df.filter(F.col(value).isNotNull()).orderBy(value, tie).limit(n)
