"""Sections of the report from counted rows equal those from the manifest, and the manifest is read once."""

import random

import pytest

from sievework.operators import profile

SOURCES = ["a", "b", "c"]
SECTIONS = {
    "status_by_dataset": profile.status_by_dataset, "status_totals": profile.status_totals, "usable_by_class": profile.usable_by_class,
    "held_items": profile.held_items, "exclusion_reasons": profile.exclusion_reasons, "unmapped_labels": profile.unmapped_labels,
    "imbalance": profile.imbalance, "dominance": profile.dominance, "class_by_dataset": lambda m: profile.class_by_dataset(m, SOURCES),
    "matrix": lambda m: profile.count_matrix(m.filter("status = 'exclude'"), "dataset_id", "reason", ["r1", "r2", "label_not_in_class_map"]),
    "majority": lambda m: profile.majority_share(m.filter("status = 'use'"), "crop", "class_id"),
    "two": lambda m: profile.scopes_with_labels(m.filter("status = 'use'"), "dataset_id", "class_id")}


@pytest.fixture(scope="module")
def manifest(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        status = rng.choice(["use", "use", "hold", "exclude"])
        reason = rng.choice(["r1", "r2", "label_not_in_class_map"]) if status != "use" else None
        rows.append((f"i{i}", rng.choice(SOURCES), rng.choice(["x", "y", None]), rng.choice(["k", "l", None]), rng.choice(["p", "q"]), status, reason))
    return spark.createDataFrame(rows, "image_id STRING, dataset_id STRING, crop STRING, class_id STRING, source_label STRING, status STRING, reason STRING")


@pytest.mark.parametrize("name", sorted(SECTIONS))
def test_sections_of_counts(manifest, name):
    section, counts = SECTIONS[name], profile.count_items(manifest)
    plain, counted = section(manifest), section(counts)
    assert plain.schema.simpleString() == counted.schema.simpleString()
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, counted.collect()), key=str)


@pytest.mark.parametrize("name", ["status_by_dataset", "status_totals", "imbalance"])
def test_an_empty_manifest(manifest, name):
    empty = manifest.limit(0)
    assert sorted(map(tuple, SECTIONS[name](empty).collect()), key=str) == sorted(map(tuple, SECTIONS[name](profile.count_items(empty)).collect()), key=str)


def test_the_text_is_scanned_once(spark, sf_dir):
    """All sections together read the table of counts only; the scan of the documents lies below it, in one job."""
    from sievework.plans.counts import report_sections
    plan = report_sections(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and plan.count("FileScan") >= 10
