"""From member paths to labels, classes and a first status, without reading any content."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import NESTED_MARK, normalise_label, outer_path, stable_id, to_java_pattern
from sievework.operators.rule_index import NO_RULE, match_indexed
from sievework.registry import DROP, REVIEW, Dataset, PathRule, class_map_table, severity_table
from sievework.session import first_true

# More rules than this are not made into one expression but matched through an index of their literals.
CHAIN_RULES = 100


def captured(path: Column, number: Column, rules: Sequence[PathRule], group: str) -> Column:
    """The named capture of the rule that matched; '' if that rule has no such group."""
    pairs = []
    for i, rule in enumerate(rules):
        java, index = to_java_pattern(rule.pattern)
        if group in index:
            pairs.append((number == i, F.regexp_extract(path, java, index[group])))
    return first_true(pairs, F.lit(""))


def _of_rule(values: Sequence[str | None], number: str = "rule_no") -> Column:
    """The value that belongs to a rule number; NULL without a rule."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.col(number))


def _with_rule(members: DataFrame, placed: Sequence[tuple[str | None, PathRule]], path_col: str) -> DataFrame:
    """Add the columns of the first matching rule; a rule with an archive only looks at that archive's members."""
    path, number, rules = F.col(path_col), F.col("rule_no"), [r for _, r in placed]
    numbered = members.withColumns({"rule_no": _first_match(path, placed), "_outer_no": F.when(
        path.contains(NESTED_MARK), _first_match(outer_path(path), placed)).otherwise(NO_RULE)})
    skips = [r.skip for r in rules]
    return numbered.withColumns({
        "rule_exclude": _of_rule([r.exclude for r in rules]),
        # a nested archive that is skipped is skipped with all that is in it
        "rule_skip": F.coalesce(_of_rule(skips, "_outer_no"), _of_rule(skips)),
        "raw_label": F.coalesce(_of_rule([r.label for r in rules]), captured(path, number, rules, "label")),
        "split_source": F.nullif(captured(path, number, rules, "split"), F.lit("")),
    }).drop("_outer_no")


def _first_match(path: Column, placed: Sequence[tuple[str | None, PathRule]]) -> Column:
    hits = []
    for i, (archive, rule) in enumerate(placed):
        found = path.rlike(to_java_pattern(rule.pattern)[0])
        hits.append((found if archive is None else (F.col("archive") == archive) & found, F.lit(i)))
    return first_true(hits, F.lit(NO_RULE))


def apply_rules(members: DataFrame, rules: Sequence[PathRule], path_col: str = "member_path") -> DataFrame:
    """Add rule_no (-1 without one), rule_exclude, rule_skip, raw_label and split_source by one list of rules.

    The rules become one CASE chain of literal patterns, which are compiled once per task.
    """
    return _with_rule(members, [(None, r) for r in rules], path_col)


def apply_archive_rules(members: DataFrame, datasets: Sequence[Dataset]) -> DataFrame:
    """`apply_rules` for members of many archives in one pass, each under the rules of its own archive."""
    placed = [(a.file, r) for d in datasets for a in d.archives for r in a.rules]
    if len(placed) > CHAIN_RULES:
        return match_indexed(members, placed).drop("rule_tries")
    return _with_rule(members, placed, "member_path")


def match_rule_table(members: DataFrame, rules: DataFrame, key: str, path_col: str = "member_path") -> DataFrame:
    """First matching rule when rules come as a table (dataset_id, archive, ordinal, pattern in Java syntax).

    The table form of `apply_rules`, for rule sets too many for one expression. The broadcast hint sits on
    the rule table only if its size was checked (`small_table`).
    """
    hit = members.join(rules, ["dataset_id", "archive"], "left").filter(
        F.col("pattern").isNull() | F.rlike(F.col(path_col), F.col("pattern")))
    best = hit.groupBy(key).agg(F.min(F.struct("ordinal", "pattern", "label", "exclude", "skip")).alias("rule"))
    return members.join(best, key, "left")


def decide(present: Column, target: Column, rule_found: Column, rule_exclude: Column, has_label: Column) -> dict[str, Column]:
    """status, reason and class_id, by the first of: no rule, excluded by rule, no label, label map."""
    is_class = present & target.isNotNull() & ~target.isin(DROP, REVIEW)
    status = first_true([
        (~rule_found | rule_exclude.isNotNull() | ~has_label, F.lit("exclude")),
        (~present | target.isNull() | (target == REVIEW), F.lit("hold")),
        (target == DROP, F.lit("exclude"))], F.lit("use"))
    reason = first_true([
        (~rule_found, F.lit("no_rule_matched")), (rule_exclude.isNotNull(), rule_exclude),
        (~has_label, F.lit("rule_has_no_label")), (~present, F.lit("label_not_in_class_map")),
        (target.isNull(), F.lit("pending_taxonomy")), (target == REVIEW, F.lit("needs_expert_review")),
        (target == DROP, F.lit("class_dropped"))])
    used = rule_found & rule_exclude.isNull() & has_label & is_class
    return {"status": status, "reason": reason, "class_id": F.when(used, target)}


def map_labels(items: DataFrame, class_map: DataFrame, severity: DataFrame) -> DataFrame:
    """Add target, mapped (a missing key is not a NULL target) and severity for (dataset_id, source_label)."""
    present = class_map.withColumn("mapped", F.lit(True))
    joined = items.join(present, ["dataset_id", "source_label"], "left").join(
        severity, ["dataset_id", "source_label"], "left")
    mapped = F.coalesce("mapped", F.lit(False))
    return joined.withColumn("mapped", mapped).withColumn("severity", F.when(mapped, F.col("severity")))


def _listings(datasets: Sequence[Dataset]) -> list[list[Dataset]]:
    """Passes over the members in which no archive is listed twice: one, unless data sets share an archive."""
    passes: list[list[Dataset]] = []
    for ds in datasets:
        for archive in ds.archives:
            one = replace(ds, archives=(archive,))
            free = next((p for p in passes if all(archive.file != d.archives[0].file for d in p)), None)
            if free is None:
                passes.append([one])
            else:
                free.append(one)
    return passes


def _label_rows(members: DataFrame, listed: Sequence[Dataset]) -> DataFrame:
    """One pass: rows of the listed archives with rule columns, dataset, crop and normalised label."""
    owner = {d.archives[0].file: d for d in listed}

    def by_archive(values: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("archive")]

    rows = apply_archive_rules(members.filter(F.col("archive").isin(list(owner))), listed).filter(F.col("rule_skip").isNull())
    has_label = F.coalesce("raw_label", F.lit("")) != ""
    labelled = (F.col("rule_no") != NO_RULE) & F.col("rule_exclude").isNull() & has_label
    by_suffixes: dict[tuple[str, ...], list[str]] = {}
    for file, ds in owner.items():
        by_suffixes.setdefault(ds.strip_suffixes, []).append(file)
    label = first_true([(labelled & F.col("archive").isin(files), normalise_label(F.col("raw_label"), suffixes))
                        for suffixes, files in by_suffixes.items()])
    return rows.withColumns({
        "dataset_id": by_archive({f: d.id for f, d in owner.items()}), "crop": by_archive({f: d.crop for f, d in owner.items()}),
        "has_label": has_label, "source_label": label})


def classify_members(members: DataFrame, datasets: Sequence[Dataset]) -> DataFrame:
    """(archive, member_path, size …) to manifest rows with status. Skipped members have no row."""
    spark = members.sparkSession
    passes = _listings(datasets)
    if not passes:
        raise ValueError("the registry lists no archive")
    parts = reduce(DataFrame.unionByName, [_label_rows(members, listed) for listed in passes])
    joined = map_labels(parts, class_map_table(spark, datasets), severity_table(spark, datasets))
    verdict = decide(F.col("mapped"), F.col("target"), F.col("rule_no") != NO_RULE, F.col("rule_exclude"), F.col("has_label"))
    named = joined.withColumns(verdict).withColumn(
        "image_id", stable_id(F.col("dataset_id"), F.col("archive"), F.col("member_path")))
    return named.withColumnRenamed("size", "file_bytes").drop(
        "rule_no", "rule_exclude", "rule_skip", "raw_label", "has_label", "target", "mapped")


def skipped_members(members: DataFrame, rules: Sequence[PathRule]) -> DataFrame:
    """Count of members per skip reason."""
    return apply_rules(members, rules).filter(F.col("rule_skip").isNotNull()).groupBy(
        F.col("rule_skip").alias("skip_reason")).agg(F.count("*").alias("members"))
