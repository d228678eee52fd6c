"""The human-review loop: forms, their validation, and import as decisions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import NO_CLASS, class_or_none
from sievework.schema import FORM, OVERRIDES, names
from sievework.session import SMALL_TABLE_ROWS, small_table

# Verdict -> (action, or None for no change; whether correct_class must be filled).
VERDICTS: dict[str, tuple[str | None, bool]] = {
    "correct": (None, False),
    "wrong": ("use", True),
    "label": ("use", True),
    "wrong_unknown": ("exclude", False),
    "not_a_leaf": ("exclude", False),
    "unusable": ("exclude", False),
    "unsure": ("hold", False),
}
# Crops that share the classes of another crop.
CROP_ALIASES = {"chickpea": "pulses", "pea": "pulses", "urd": "pulses", "moong": "pulses"}
ALL_CROPS = "all"
ERROR_RATE_LIMIT = 0.05


class FormError(ValueError):
    pass


def taxonomy_crop(crop: Column, aliases: Mapping[str, str] = CROP_ALIASES) -> Column:
    if not aliases:
        return crop
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(table, crop), crop)


def classes_by_crop(taxonomy: DataFrame) -> DataFrame:
    """(crop, class_id) of model classes; classes for all crops also listed under each crop."""
    rows = taxonomy.filter("in_model").select("crop", "class_id")
    # a taxonomy is small: its crops beside its shared classes
    shared = F.broadcast(rows.filter(F.col("crop") == ALL_CROPS).select("class_id").distinct())
    return rows.unionByName(rows.select("crop").distinct().crossJoin(shared)).distinct()


def permitted_classes(taxonomy: DataFrame) -> dict[str, list[str]]:
    """Classes by crop as driver-side configuration; a taxonomy of more rows than that is refused."""
    found = classes_by_crop(taxonomy).limit(SMALL_TABLE_ROWS + 1).collect()
    if len(found) > SMALL_TABLE_ROWS:
        raise FormError(f"the taxonomy has more than {SMALL_TABLE_ROWS} classes")
    table: dict[str, list[str]] = {ALL_CROPS: []}
    for row in sorted(found):
        table.setdefault(row.crop, []).append(row.class_id)
    return table


def is_permitted(class_id: Column, crop: Column, permitted: Mapping[str, list[str]], aliases: Mapping[str, str]) -> Column:
    """Whether a crop may have a class; a crop the taxonomy lacks gets the shared classes only."""
    lists = F.create_map(*[x for c, ids in permitted.items() for x in (F.lit(c), F.array(*[F.lit(i) for i in ids]).cast("array<string>"))])
    own = F.coalesce(F.element_at(lists, taxonomy_crop(crop, aliases)), F.element_at(lists, F.lit(ALL_CROPS)))
    return F.coalesce(F.array_contains(own, class_id), F.lit(False))


def allowed_classes(items: DataFrame, taxonomy: DataFrame, aliases: Mapping[str, str] = CROP_ALIASES) -> DataFrame:
    """(crop, class_id) a row of each crop may get; a crop the taxonomy lacks gets the shared classes only."""
    crops = items.select("crop").distinct().withColumn("tax_crop", taxonomy_crop(F.col("crop"), aliases))
    table = classes_by_crop(taxonomy)
    known = table.select(F.col("crop").alias("tax_crop")).distinct().withColumn("known", F.lit(True))
    looked_up = crops.join(known, "tax_crop", "left").withColumn(
        "tax_crop", F.when(F.col("known"), F.col("tax_crop")).otherwise(ALL_CROPS))
    return looked_up.join(table.withColumnRenamed("crop", "tax_crop"), "tax_crop").select("crop", "class_id")


def check_form(form: DataFrame, manifest: DataFrame, taxonomy: DataFrame, version: str,
               aliases: Mapping[str, str] = CROP_ALIASES) -> DataFrame:
    """Form rows with `errors` (ARRAY, empty if valid), `action` and `decision_reason`.

    Blank verdicts are no answers and pass. The crop is that of the manifest, not of the form.
    """
    text = {c: F.coalesce(F.trim(c), F.lit("")) for c in ["image_id", "correct_class", "manifest_version", "current_class"]}
    text["verdict"] = F.lower(F.coalesce(F.trim("verdict"), F.lit("")))
    spark = form.sparkSession
    verdicts = small_table(spark, [(v, a, n) for v, (a, n) in VERDICTS.items()],
                           "verdict STRING, action STRING, needs_class BOOLEAN").withColumn("known_verdict", F.lit(True))
    known = manifest.select("image_id", F.col("crop").alias("known_crop"))
    rows = form.withColumns(text).join(verdicts, "verdict", "left").join(known, "image_id", "left")
    permitted = is_permitted(F.col("correct_class"), F.col("known_crop"), permitted_classes(taxonomy), aliases)
    stop = (
        F.when(F.col("known_verdict").isNull(), "unknown_verdict")
        .when(F.col("known_crop").isNull(), "unknown_item")
        .when(~F.col("manifest_version").isin("", version), "other_manifest_version"))
    filled = F.col("correct_class") != ""
    about_class = (
        F.when(F.col("needs_class") & ~filled, "class_required")
        .when(~F.col("needs_class") & filled, "class_must_be_empty")
        .when(filled & ~permitted, "class_not_valid_for_crop"))
    no_class = F.when((F.col("verdict") == "correct") & F.col("current_class").isin("", NO_CLASS), "item_has_no_class")
    none = F.array().cast("array<string>")
    errors = (
        F.when(F.col("verdict") == "", none).when(stop.isNotNull(), F.array(stop))
        .otherwise(F.array_compact(F.array(about_class, no_class))))
    checked = rows.withColumn("errors", errors)
    valid = (F.size("errors") == 0) & (F.col("verdict") != "")
    return checked.withColumns({
        "action": F.when(valid, F.col("action")),
        "decision_reason": F.when(valid & F.col("action").isNotNull(), F.concat(F.lit("expert_"), F.col("verdict"))),
    }).select(*form.columns, "errors", "action", "decision_reason")


def form_errors(checked: DataFrame) -> DataFrame:
    return checked.select("image_id", F.explode("errors").alias("error"))


def form_decisions(checked: DataFrame, form_name: str, decided_by: str, decided_at: Column) -> DataFrame:
    """Valid answers that change something, as decision rows."""
    return checked.filter(F.col("action").isNotNull()).select(
        "image_id", "action", F.nullif("correct_class", F.lit("")).alias("class_id"),
        F.concat_ws(":", "decision_reason", F.lit(form_name)).alias("reason"), F.lit(decided_by).alias("decided_by"),
        decided_at.alias("decided_at"), F.lit("approved").alias("status")).select(*names(OVERRIDES))


def import_form(checked: DataFrame, form_name: str, decided_by: str, decided_at: Column | None = None) -> DataFrame:
    """Decisions of a form, all or none: one invalid row refuses the whole form; `form_errors` lists all faults."""
    faults = form_errors(checked)
    count = faults.count()
    if count:
        some = "; ".join(f"{p.image_id}: {p.error}" for p in faults.limit(20).collect())
        raise FormError(f"nothing imported, {count} faults (see form_errors), among them: {some}")
    return form_decisions(checked, form_name, decided_by, F.current_timestamp() if decided_at is None else decided_at)


def blank_form(items: DataFrame, version: str) -> DataFrame:
    empty = F.lit(None).cast("string")
    return items.select(
        F.lit(version).alias("manifest_version"), "image_id", "dataset_id", "crop", "source_label",
        class_or_none(F.col("class_id")).alias("current_class"), empty.alias("verdict"),
        empty.alias("correct_class"), empty.alias("notes")).select(*names(FORM))


def relabel_list(manifest: DataFrame, dataset_id: str) -> DataFrame:
    """Held rows of one source, in path order."""
    return manifest.filter((F.col("dataset_id") == dataset_id) & (F.col("status") == "hold")).orderBy("member_path")


def audit_error_rates(answers: DataFrame) -> DataFrame:
    """Share of wrong labels among audited rows by group, and whether the group needs a full review."""
    verdict = F.lower(F.trim("verdict"))
    audited = answers.filter(F.coalesce(verdict, F.lit("")) != "")
    counts = audited.groupBy("dataset_id", "source_label").agg(
        F.count("*").alias("audited"), F.count_if(verdict.isin("wrong", "wrong_unknown")).alias("wrong"))
    rate = F.col("wrong") / F.col("audited")
    return counts.withColumns({"error_rate": rate, "review_all": rate > ERROR_RATE_LIMIT})
