"""Forms out and back, and the tables that pass between runs."""

import datetime

import pytest
from pyspark.sql import functions as F

from sievework import registry
from sievework.operators.review import FormError
from sievework.plans import review_loop
from sievework.schema import FORM, OVERRIDES, TAXONOMY
from sievework.session import cut_lineage, scratch
from sievework.sources import tables
from sievework.sources.versions import VersionedTables

MANIFEST = "image_id STRING, dataset_id STRING, crop STRING, source_label STRING, class_id STRING, status STRING"
ROWS = [(f"i{n}", "b" if n < 4 else "a", "verse" if n % 2 else "song", "l", "VERSE_CALM", "use") for n in range(8)] + [("h", "a", "verse", "l", None, "hold")]


@pytest.fixture(scope="module")
def manifest(spark):
    return spark.createDataFrame(ROWS, MANIFEST)


@pytest.fixture(scope="module")
def taxonomy(spark):
    rows = [("VERSE_CALM", "verse"), ("VERSE_STORM", "verse"), ("SONG_LOUD", "song"), ("ANY_OTHER", "all")]
    return spark.createDataFrame([(c, crop, True) for c, crop in rows], "class_id STRING, crop STRING, in_model BOOLEAN")


def filled(spark, answers):
    return spark.createDataFrame([("v1", i, None, None, None, "VERSE_CALM", v, c, None) for i, v, c in answers], FORM)


def test_write_guard_and_order(spark, manifest, tmp_path):
    path = str(tmp_path / "form")
    form = review_loop.audit_form(manifest, "v1", 2, {("a", "l"): 3}, 5)
    assert review_loop.write_form(form, path) and not review_loop.write_form(form, path)
    back = tables.read_table(spark, path, FORM, "csv").collect()
    assert [r.dataset_id for r in back] == ["a"] * 3 + ["b"] * 2
    assert review_loop.write_form(form, path, force=True)
    answered = form.withColumn("verdict", F.when(F.col("dataset_id") == "b", "correct"))
    tables.write_table(answered, path, FORM, "csv")
    with pytest.raises(FormError, match="2 answers"):
        review_loop.write_form(form, path, force=True)
    assert tables.read_table(spark, path, FORM, "csv").filter("verdict = 'correct'").count() == 2


def test_import_is_all_or_none_and_keeps_a_history(spark, manifest, taxonomy, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "store"))

    def load(answers, name, day):
        return review_loop.import_review(filled(spark, answers), manifest, taxonomy, "v1", name, "expert", store, F.lit(datetime.datetime(2024, 1, day)), aliases={"song": "song"})

    load([("i1", "wrong", "VERSE_STORM"), ("i3", "unusable", None), ("i5", "", None), ("i2", "label", "ANY_OTHER")], "first", 1)
    with pytest.raises(FormError, match="2 faults"):
        load([("i7", "unsure", None), ("i1", "wrong", "SONG_LOUD"), ("i0", "wrong", None)], "second", 2)
    load([("i1", "unsure", None)], "third", 3)
    rows = store.read("decisions", OVERRIDES).collect()
    assert store.state().version == 2
    assert [(r.image_id, r.action, r.class_id, r.reason) for r in rows] == [
        ("i2", "use", "ANY_OTHER", "expert_label:first"), ("i1", "hold", None, "expert_unsure:third"), ("i3", "exclude", None, "expert_unusable:first")]
    kept = store.read("history", OVERRIDES).collect()
    assert sorted((r.image_id, r.decided_at.day) for r in kept) == [("i1", 1), ("i1", 3), ("i2", 1), ("i3", 1)]


def test_split_and_feature_tables(spark, tmp_path):
    splits = spark.createDataFrame([("i2", "b", "k", "val"), ("i1", "a", "k", "train"), ("i3", "a", "j", "unused")], "image_id STRING, dataset_id STRING, class_id STRING, split STRING")
    tables.write_splits(splits, str(tmp_path / "s"), "csv")
    assert [r.image_id for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == ["i3", "i1", "i2"]
    features = spark.createDataFrame([(f"i{n}", [float(n), 0.5]) for n in range(5)], "image_id STRING, features ARRAY<DOUBLE>")
    tables.write_features(features, splits, str(tmp_path / "f"))
    assert sorted((r.image_id, r.features, r.split) for r in tables.read_features(spark, str(tmp_path / "f")).collect()) == [
        ("i1", [1.0, 0.5], "train"), ("i2", [2.0, 0.5], "val")]


def test_other_tables(spark, tmp_path):
    rows = spark.createDataFrame([("C1", "verse", "One", "", True, True, "draft")], TAXONOMY)
    tables.write_table(rows, str(tmp_path / "t"), TAXONOMY, "csv")
    assert [r.class_id for r in tables.read_taxonomy(spark, str(tmp_path / "t")).collect()] == ["C1"]
    old = spark.createDataFrame([("k", "s", "p", 1, 1, "L", True, 1.0, 1.0, None)], "key STRING, sha256 STRING, phash STRING, width INT, height INT, mode STRING, is_grayscale BOOLEAN, sharpness_256 DOUBLE, brightness DOUBLE, error STRING")
    tables.adopt_unversioned_cache(old, str(tmp_path / "c"))
    assert tables.read_cache(spark, str(tmp_path / "c"), "1").count() == 1 and tables.read_cache(spark, str(tmp_path / "c"), "2").count() == 0


def test_registry_helpers(spark, tmp_path):
    doc = {"review": {"audit_per_group": 7, "audit_overrides": [{"dataset_id": "a", "source_label": "l", "sample_size": "3"}]},
           "datasets": [{"id": "a", "crop": "c", "local": {"archives": [{"file": "f", "rules": [{"pattern": "x", "label": "y"}, {"pattern": "z", "skip": "s"}]}]}}]}
    assert registry.audit_sizes(doc) == (7, {("a", "l"): 3}) and registry.audit_sizes({}) == (registry.AUDIT_PER_GROUP, {})
    rules = registry.rule_table(spark, registry.parse_registry(doc, set())).collect()
    assert [(r.ordinal, r.pattern, r.label, r.skip) for r in rules] == [(0, "x", "y", None), (1, "z", None, "s")]
    path = tmp_path / "registry.yaml"
    path.write_text("datasets: []")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            registry.load_registry(str(path), set())
    else:
        assert registry.load_registry(str(path), set()) == []


def test_scratch_tables_are_deleted(spark):
    with scratch(spark):
        written = cut_lineage(spark.range(3))
        path = written.inputFiles()[0].rsplit("/", 1)[0]
        assert tables.table_exists(spark, path) and written.count() == 3
    assert not tables.table_exists(spark, path)
