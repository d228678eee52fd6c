"""Operators on small fixtures."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.functions.geometry import letterbox_columns
from sievework.operators import evaluate, incremental, overrides, probes, profile, quality, review, scoring, splits
from sievework.operators.duplicates import resolve_duplicates
from sievework.operators.quantiles import LINEAR, ORDER, exact_quantiles, narrowed_bands
from sievework.operators.ranks import dense_ids, group_key, hash_ranked, seeded_hash
from sievework.operators.sampling import audit_sample
from sievework.plans import items
from sievework.sources.tables import append_cache, read_cache, read_table, write_table
from sievework.schema import OVERRIDES, SPLITS


def test_labels(spark):
    cases = [("Deep  Water!", [], "deep_water"), ("frost_late_early", ["_early", "_late"], "frost"), ("9%(Q)", [], "9_q"),
             ("--7--", [], "7"), ("_late", ["_late"], "late"), ("mno", ["o", "no"], "mn"), ("k_cd_d", ["_d", "_cd_d"], "k_cd"), ("z_late", ["_late"], "z")]
    for raw, suffixes, expected in cases:
        got = spark.createDataFrame([(raw,)], "r STRING").select(text.normalise_label(F.col("r"), suffixes).alias("l")).first().l
        assert got == expected, raw


def test_paths(spark):
    paths = ["a/b.JPG", ".jpg", "x/.png", "a.tar.gz", "q/none", "a.b/c", "o.zip!/i/p.webp"]
    rows = spark.createDataFrame([(p,) for p in paths], "p STRING").select(
        text.extension(F.col("p")).alias("e"), text.is_image_path(F.col("p")).alias("i"),
        text.outer_path(F.col("p")).alias("o"), text.inner_path(F.col("p")).alias("n")).collect()
    assert [r.e for r in rows] == [".jpg", "", "", ".gz", "", "", ".webp"]
    assert [r.i for r in rows] == [True, False, False, False, False, False, True]
    assert (rows[6].o, rows[6].n, rows[0].n) == ("o.zip", "i/p.webp", None)
    assert text.to_java_pattern(r"(?P<a_b>x)-(?P=a_b)") == (r"(x)-\1", {"a_b": 1})


def test_first_rule_wins_and_data_sets_may_share_an_archive(spark):
    from sievework.operators.classify import classify_members
    from sievework.registry import Archive, Dataset, PathRule
    one = Dataset("one", "c", 0, {"x": "X", "fixed": "drop"}, {"x": 3}, ("_test",), (Archive("a", (
        PathRule("/skip/", skip="s"), PathRule("/out/", exclude="e"), PathRule("/bare/"), PathRule("/fix/(?P<label>.)", label="fixed"),
        PathRule("^(?P<split>tr|te)/(?P<label>[^/]+)/"))), Archive("b", (PathRule("(?P<label>z)"),))))
    two = Dataset("two", "c", 1, {"y": "review"}, {}, (), (Archive("a", (PathRule("^tr/(?P<label>y)/"), PathRule("/skip/(?P<label>k)"))),))
    paths = [("a", p) for p in ["tr/skip/k", "tr/out/1", "te/bare/1", "q/fix/1", "tr/X_test/1", "tr/y/1", "none"]] + [("b", "z"), ("c", "tr/x/1")]
    members = spark.createDataFrame([(*p, 1, 2) for p in paths], "archive STRING, member_path STRING, crc BIGINT, size BIGINT")
    got = {(r.dataset_id, r.member_path): r for r in classify_members(members, [one, two]).collect()}
    state = {k: (r.status, r.reason, r.class_id, r.source_label) for k, r in got.items() if k[0] == "one"}
    assert state == {
        ("one", "tr/out/1"): ("exclude", "e", None, None), ("one", "te/bare/1"): ("exclude", "rule_has_no_label", None, None),
        ("one", "q/fix/1"): ("exclude", "class_dropped", None, "fixed"), ("one", "tr/X_test/1"): ("use", None, "X", "x"),
        ("one", "tr/y/1"): ("hold", "label_not_in_class_map", None, "y"), ("one", "none"): ("exclude", "no_rule_matched", None, None),
        ("one", "z"): ("hold", "label_not_in_class_map", None, "z")}
    assert got[("one", "tr/X_test/1")].severity == 3 and got[("one", "tr/X_test/1")].split_source == "tr"
    assert got[("two", "tr/y/1")].reason == "needs_expert_review" and got[("two", "tr/skip/k")].reason == "label_not_in_class_map"
    assert got[("two", "none")].reason == "no_rule_matched" and len(got) == 14


def test_ranks_hold_for_a_hot_group(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)))
    plain = F.row_number().over(Window.partitionBy("g").orderBy(seeded_hash(1, "id"), "id"))
    assert hash_ranked(df, ["g"], "id", 1, digits=1).withColumn("x", plain).filter("x <> _rank").count() == 0
    assert dense_ids(df, [F.desc("id")], "k").filter("k <> 3000 - id").count() == 0


@pytest.mark.parametrize("band_rows", [50, 10_000])
def test_quantiles(spark, band_rows):
    rows = [(g, float(v)) for g, n in [("a", 5000), ("b", 7), ("c", 1)] for v in np.random.default_rng(n).normal(size=n).round(2)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").withColumn("w", F.col("v") * 2)
    probs = [0.0, .05, .5, .9, 1.0]
    for r in exact_quantiles(df, ["g"], {"v": probs, "w": [.5]}, band_rows=band_rows).collect():
        values = np.array([v for g, v in rows if g == r.g]) * (2 if r.column == "w" else 1)
        assert abs(np.quantile(values, r.prob) - r.value) < 1e-9 and r.n == len(values)
    values = sorted(v for _, v in rows)
    got = {r.prob: r.value for r in exact_quantiles(df, [], {"v": [.5, .05]}, how=ORDER, band_rows=band_rows).collect()}
    assert got == {.5: values[len(values) // 2], .05: values[len(values) // 20]}


def test_split_sizes_and_golden_counts(spark):
    # usable rows per (source, class) of the published report: train 10,366, val 1,626, test 1,626, unused 2,639
    sizes = [3378, 959, 168, 204, 116, 845, 699, 292, 1030, 986, 202, 815, 494, 5173, 896]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "s INT, n INT").select(
        F.lit("d").alias("dataset_id"), F.concat(F.lit("C"), "s").alias("class_id"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")
    ).withColumn("image_id", F.concat_ws("-", "class_id", "k"))
    done = splits.stratified_split(df, 1, caps={("d", "C13"): 1500})
    assert {r.split: r["count"] for r in done.groupBy("split").count().collect()} == {
        "train": 10366, "val": 1626, "test": 1626, "unused": 2639}
    again = splits.stratified_split(df.repartition(7), 1, caps={("d", "C13"): 1500})
    assert done.select("image_id", "split").exceptAll(again.select("image_id", "split")).count() == 0
    small = spark.createDataFrame([(n,) for n in range(1, 8)], "n INT").select(
        "n", *[c.alias(a) for c, a in zip(splits.split_sizes(F.col("n")), ["val", "test"])]).collect()
    assert [(r.val, r.test) for r in small] == [(0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1)]


def test_folds_are_even(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 2).cast("string"))
    counts = splits.stratified_folds(df, 5, 0, "y", "id").groupBy("y", "fold").count().collect()
    assert len(counts) == 10 and {r["count"] for r in counts} <= {10, 11}


def test_audit_sample_limits(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("image_id"), F.lit("d").alias("dataset_id"),
                                 (F.col("id") % 4).cast("string").alias("source_label"), F.lit("use").alias("status"))
    got = {r.source_label: r["count"] for r in audit_sample(df, 5, {("d", "1"): 20, ("d", "2"): 1}, 7).groupBy("source_label").count().collect()}
    assert got == {"0": 5, "1": 20, "2": 1, "3": 5}


def test_quality_rules(spark):
    limits = spark.createDataFrame([("d", 100, 5.0)], "dataset_id STRING, min_short_side INT, min_sharpness DOUBLE")
    rows = [("use", None, 90, 300, 1.0), ("hold", None, 200, 200, 4.9), ("use", None, 100, 100, 5.0), ("exclude", "x", 1, 1, 0.0), ("use", None, None, None, None)]
    df = spark.createDataFrame([(i, "d", *r) for i, r in enumerate(rows)], "i INT, dataset_id STRING, status STRING, reason STRING, width INT, height INT, sharpness_256 DOUBLE")
    assert [r.reason for r in quality.apply_quality_rules(df, limits).orderBy("i").collect()] == ["too_small", "too_blurry", None, "x", None]


def test_overrides(spark):
    manifest = spark.createDataFrame([("i1", "use", None, "A", 1), ("i2", "hold", "p", None, 2), ("i3", "exclude", "augmented", None, None)],
                                     "image_id STRING, status STRING, reason STRING, class_id STRING, phash64 LONG")
    tax = spark.createDataFrame([("A",), ("B",)], "class_id STRING")
    layout = "image_id STRING, action STRING, class_id STRING, reason STRING, seq INT"
    good = spark.createDataFrame([("i1", "use", "B", "r", 1), ("i1", "hold", "", "later", 2), ("i2", "use", "B", None, 3), ("zz", "hold", None, "r", 4)], layout)
    got = {r.image_id: r for r in overrides.apply_overrides(manifest, good, tax, "seq").collect()}
    assert (got["i1"].status, got["i1"].reason, got["i1"].class_id) == ("hold", "review:later", "A")
    assert (got["i2"].status, got["i2"].reason, got["i2"].class_id) == ("use", "review:unspecified", "B")
    assert [r.image_id for r in overrides.unknown_overrides(good, manifest).collect()] == ["zz"]
    assert {r.reason: r["items"] for r in overrides.override_counts(good, manifest).collect()} == {"review:r": 1, "review:later": 1, "review:unspecified": 1}
    for bad in [("i1", "delete", None, "r", 1), ("i1", "use", "NOPE", "r", 1), ("i1", "use", None, "r", 1), ("i3", "use", "A", "r", 1)]:
        with pytest.raises(overrides.OverrideError):
            overrides.apply_overrides(manifest, spark.createDataFrame([bad], layout), tax, "seq")


TAX = [("WHT_RUST", "wheat", True), ("PUL_WILT", "pulses", True), ("OFF", "wheat", False), ("UNKNOWN", "all", True)]


def form_row(verdict="", correct="", image="i1", version="v1", current="WHT_RUST"):
    return (version, image, "d", "wheat", "l", current, verdict, correct, "")


@pytest.mark.parametrize("row,errors,action", [
    (form_row(), [], None), (form_row("correct"), [], None), (form_row(" Wrong ", "UNKNOWN"), [], "use"),
    (form_row("label", "WHT_RUST", current="(none)"), [], "use"), (form_row("not_a_leaf"), [], "exclude"), (form_row("unusable"), [], "exclude"),
    (form_row("wrong_unknown"), [], "exclude"), (form_row("unsure"), [], "hold"), (form_row("wrong"), ["class_required"], None),
    (form_row("unsure", "WHT_RUST"), ["class_must_be_empty"], None), (form_row("correct", "WHT_RUST"), ["class_must_be_empty"], None),
    (form_row("wrong", "PUL_WILT"), ["class_not_valid_for_crop"], None), (form_row("wrong", "OFF"), ["class_not_valid_for_crop"], None),
    (form_row("wrong", "PUL_WILT", image="i2"), [], "use"), (form_row("wrong", "UNKNOWN", image="i3"), [], "use"),
    (form_row("wrong", "WHT_RUST", image="i3"), ["class_not_valid_for_crop"], None), (form_row("maybe"), ["unknown_verdict"], None),
    (form_row("correct", image="none"), ["unknown_item"], None), (form_row("correct", version="v0"), ["other_manifest_version"], None),
    (form_row("correct", version=""), [], None), (form_row("correct", current="(none)"), ["item_has_no_class"], None),
    (form_row("correct", "WHT_RUST", current=""), ["class_must_be_empty", "item_has_no_class"], None)])
def test_form_rows(spark, row, errors, action):
    from sievework.schema import FORM
    manifest = spark.createDataFrame([("i1", "wheat"), ("i2", "chickpea"), ("i3", "rice")], "image_id STRING, crop STRING")
    tax = spark.createDataFrame(TAX, "class_id STRING, crop STRING, in_model BOOLEAN")
    checked = review.check_form(spark.createDataFrame([row], FORM), manifest, tax, "v1")
    got = checked.first()
    assert (got.errors, got.action) == (errors, action)
    if errors:
        with pytest.raises(review.FormError):
            review.import_form(checked, "audit", "me")


def test_upsert_keeps_the_newest(spark):
    day = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    old = spark.createDataFrame([("a", "use", "X", "r", "m", day[2], "approved"), ("b", "hold", None, "r", "m", day[0], "approved")], OVERRIDES)
    new = spark.createDataFrame([("a", "hold", None, "r2", "m", day[1], "approved"), ("c", "exclude", None, "r", "m", day[1], "approved")], OVERRIDES)
    got = {r.image_id: (r.action, r.class_id) for r in overrides.upsert_decisions(old, new).collect()}
    assert got == {"a": ("hold", None), "b": ("hold", None), "c": ("exclude", None)}


def test_audit_error_rate(spark):
    rows = [("d", "l", v) for v in ["correct"] * 19 + ["wrong", "", None]] + [("d", "m", "wrong_unknown"), ("d", "m", "correct")]
    got = {r.source_label: r for r in review.audit_error_rates(spark.createDataFrame(rows, "dataset_id STRING, source_label STRING, verdict STRING")).collect()}
    assert (got["l"].audited, got["l"].wrong, got["l"].review_all) == (20, 1, False) and got["m"].review_all


def test_cache_versions(spark, tmp_path):
    path = str(tmp_path / "cache")
    row = "key STRING, sha256 STRING, phash STRING, width INT, height INT, mode STRING, is_grayscale BOOLEAN, sharpness_256 DOUBLE, brightness DOUBLE, error STRING"
    one = spark.createDataFrame([("k1", "s", "p", 1, 1, "L", True, 1.0, 1.0, None)], row)
    append_cache(one, path, "1")
    append_cache(one.withColumn("key", F.lit("k2")), path, "2")
    append_cache(one.withColumn("key", F.lit("k3")), path, None)
    assert sorted(r.key for r in read_cache(spark, path, "1").collect()) == ["k1", "k3"]
    assert [r.key for r in read_cache(spark, path, "2").collect()] == ["k2"]
    items = spark.createDataFrame([("k1",), ("k9",)], "key STRING")
    assert [r.key for r in incremental.cache_misses(items, read_cache(spark, path, "1")).collect()] == ["k9"]
    assert [r.key for r in incremental.cache_hits(items, read_cache(spark, path, "1")).collect()] == ["k1"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_tables_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([("i", "0", 'say "NA"\n, x', "train", 5), ("j", None, "c", "val", 6)], SPLITS + ", extra INT")
    write_table(df, str(tmp_path / "t"), SPLITS, fmt)
    back = read_table(spark, str(tmp_path / "t"), SPLITS, fmt)
    assert sorted(map(tuple, back.collect()), key=str) == sorted((tuple(r)[:4] for r in df.collect()), key=str)


def test_scoring_gate(spark):
    df = spark.createDataFrame([(1, [0.02, 0.91, 0.05, 0.02]), (2, [0.2, 0.18, 0.15, 0.2])], "id INT, p ARRAY<DOUBLE>")
    best = scoring.top_k(df, "p")
    assert [[t.class_index for t in r.top] for r in best.orderBy("id").collect()] == [[1, 2, 0], [0, 3, 1]]
    labels = spark.createDataFrame([(i, f"C{i}") for i in range(4)], "class_index INT, class_id STRING")
    tax = spark.createDataFrame([(f"C{i}", f"n{i}", "", "wheat", True) for i in range(4)], "class_id STRING, name_en STRING, name_hi STRING, crop STRING, in_model BOOLEAN")
    sure, unsure = scoring.gate(scoring.name_alternatives(best, labels, tax), "id").orderBy("id").collect()
    assert (sure.status, sure.top.class_id, [a.class_id for a in sure.alternatives], sure.message) == ("ok", "C1", ["C2", "C0"], None)
    assert (unsure.status, unsure.top, len(unsure.alternatives)) == ("not_sure", None, 3) and unsure.message
    with pytest.raises(scoring.TaxonomyError):
        scoring.name_alternatives(best, labels, tax.filter("class_id <> 'C0'"))
    rows = spark.createDataFrame([("text/html", 1, True), ("image/png", 20 * 2**20, False), ("image/png", 1, False), ("image/webp", 1, True)], "t STRING, n LONG, ok BOOLEAN")
    assert [r.e for r in rows.select(scoring.input_error(F.col("t"), F.col("n"), F.col("ok")).alias("e")).collect()] == [415, 413, 422, None]


def test_metrics_golden(spark):
    labels = "PUL_CHICKPEA_WILT PUL_HEALTHY SOY_FROGEYE SOY_HEALTHY SOY_RUST SOY_YMV WHT_BLACK_RUST WHT_BROWN_RUST WHT_HEALTHY WHT_POWDERY_MILDEW WHT_SPOT_BLOTCH WHT_YELLOW_RUST".split()
    # fixed values: the published confusion matrix, (true, predicted, n) without zeros
    cells = [(0, 0, 250), (0, 1, 88), (1, 0, 14), (1, 1, 82), (2, 2, 13), (2, 4, 3), (2, 5, 1), (3, 3, 32), (4, 2, 28), (4, 4, 44), (4, 5, 12),
             (5, 2, 4), (5, 4, 3), (5, 5, 63), (6, 6, 21), (6, 7, 4), (6, 10, 4), (7, 6, 3), (7, 7, 98), (7, 8, 2), (8, 6, 3), (8, 7, 5),
             (8, 8, 95), (8, 9, 2), (8, 10, 1), (8, 11, 13), (9, 6, 3), (9, 7, 4), (9, 8, 1), (9, 9, 67), (9, 10, 5), (9, 11, 2), (10, 6, 4),
             (10, 7, 4), (10, 9, 3), (10, 10, 37), (10, 11, 1), (11, 5, 2), (11, 7, 2), (11, 8, 7), (11, 11, 596)]
    scored = spark.createDataFrame([(labels[t], labels[p], n) for t, p, n in cells], "y_true STRING, y_pred STRING, n INT").select(
        "y_true", "y_pred", F.explode(F.sequence(F.lit(1), "n")))
    report = evaluate.class_report(scored)
    assert evaluate.macro_f1(report).first().macro_f1 == 0.7833
    frogeye = report.filter("label = 'SOY_FROGEYE'").first()
    assert (round(frogeye.precision, 2), round(frogeye.recall, 2), round(frogeye.f1, 2), frogeye.support) == (0.29, 0.76, 0.42, 17)
    matrix = {r.y_true: r for r in evaluate.confusion_matrix(scored, labels).collect()}
    assert len(matrix) == 12 and matrix["SOY_RUST"].pred_SOY_FROGEYE == 28 and matrix["SOY_HEALTHY"].pred_SOY_RUST == 0
    never = evaluate.class_report(spark.createDataFrame([("a", "b"), ("b", "b")], "y_true STRING, y_pred STRING"))
    assert {r.label: (r.precision, r.recall) for r in never.collect()} == {"a": (0.0, 0.0), "b": (0.5, 1.0)}


def test_letterbox(spark):
    rows = {(1000, 100): (224, 22, 0, 101), (300, 300): (224, 224, 0, 0), (50, 50): (50, 50, 87, 87), (1, 5000): (1, 224, 111, 0)}
    for (width, height), box in rows.items():
        got = letterbox_columns(spark.createDataFrame([(width, height)], "width INT, height INT")).first()
        assert (got.box_width, got.box_height, got.offset_x, got.offset_y) == box


def test_null_groups_are_groups(spark):
    rows = [(None if i % 3 == 0 else i % 3, i, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "g INT, id INT, v DOUBLE")
    ranked = hash_ranked(df, ["g"], "id", 1).collect()
    assert len(ranked) == 30 and {r._size for r in ranked} == {10}
    assert sorted(r._rank for r in ranked if r.g is None) == list(range(1, 11))
    found = {r.g: r.value for r in exact_quantiles(df, ["g"], {"v": [.5]}).collect()}
    assert found == {None: 13.5, 1: 14.5, 2: 15.5}
    done = splits.stratified_split(df, 3, ["g"], "id", caps={(None,): 2, (1,): 3})
    counts = {(r.g, r.split): r["count"] for r in done.groupBy("g", "split").count().collect()}
    assert counts[None, "train"] == 2 and counts[None, "unused"] == 6 and counts[1, "unused"] == 5 and counts[2, "train"] == 8


@pytest.mark.parametrize("band_rows", [50, 1_000_000])
def test_quantiles_of_one_large_group(spark, band_rows):
    """A continuous ungrouped column: no window partition gets more than `band_rows` values."""
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=20_000), np.full(5_000, 0.25), [np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v DOUBLE").repartition(5)
    probs = [0.0, .01, .25, .5, .6, .999, 1.0]
    for how in (LINEAR, ORDER):
        got = {r.prob: r.value for r in exact_quantiles(df, [], {"v": probs}, how, band_rows).collect()}
        v = np.sort(values)
        for p in probs:
            place = p * (len(v) - 1)
            want = v[min(int(p * len(v)), len(v) - 1)] if how == ORDER else (
                v[int(place)] if place == int(place) else v[int(place)] + (v[int(place) + 1] - v[int(place)]) * (place - int(place)))
            assert got[p] == pytest.approx(want, rel=1e-12), (how, p)
    data = df.filter("v IS NOT NULL").select(group_key([]).alias("_g"), F.col("v").alias("_v0"))
    for b in narrowed_bands(data, [(0, p) for p in probs], LINEAR, band_rows).first()._b:
        assert b.low == b.high or b.inside <= band_rows


@pytest.mark.parametrize("band_rows", [50, 10_000])
def test_quantiles_between_heavy_ties(spark, band_rows):
    """Wanted ranks at the boundary of two tied values, next to each other or with other values between."""
    groups = {"pair": [0.0] * 10_000 + [1.0] * 10_000, "odd": [3.0] * 10_001 + [4.0] * 10_000,
              "gap": [0.0] * 10_000 + [i / 100 for i in range(1, 100)] + [1.0] * 10_000,
              "tenths": np.random.default_rng(4).normal(size=30_000).round(1).tolist(), "one": [7.0] * 20_001}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g STRING, v DOUBLE").repartition(5)
    probs = [0.0, .05, .25, .49, .5, .51, .9, 1.0]
    for how in (LINEAR, ORDER):
        found = exact_quantiles(df, ["g"], {"v": probs}, how, band_rows).collect()
        assert len(found) == len(groups) * len(probs)
        for r in found:
            v = np.sort(groups[r.g])
            want = np.quantile(v, r.prob) if how == LINEAR else v[min(int(r.prob * len(v)), len(v) - 1)]
            assert r.value == pytest.approx(want, abs=1e-9) and r.n == len(v), (how, r)


def test_unknown_sources_stop_the_run(spark):
    columns = ("image_id STRING, dataset_id STRING, status STRING, reason STRING, width INT, height INT, sharpness_256 DOUBLE, class_id STRING, "
               "source_label STRING, split_source STRING, phash64 BIGINT, sha256 STRING, member_path STRING, archive STRING, duplicate_of STRING, dup_group STRING")
    row = ("i1", "d1", "use", None, 10, 10, 9.0, "c", "l", None, 5, "s", "m", "a", None, None)
    other = ("i2", "elsewhere", *row[2:])
    sources = spark.createDataFrame([("d1", 0, 0.0, 1)], "dataset_id STRING, min_short_side INT, min_sharpness DOUBLE, priority INT")
    known, both = spark.createDataFrame([row], columns), spark.createDataFrame([row, other, ("i3", None, *row[2:])], columns)
    assert quality.apply_quality_rules(known, sources).count() == 1
    for run in (lambda: quality.apply_quality_rules(both, sources).collect(), lambda: resolve_duplicates(both, sources.select("dataset_id", "priority")).manifest.collect()):
        with pytest.raises(Exception, match="elsewhere|NULL"):
            run()


def test_values_without_a_column_stop_the_run(spark):
    df = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "a")], "row STRING, col STRING")
    assert {r.row: (r.a, r.b) for r in profile.count_matrix(df, "row", "col", ["a", "b"]).collect()} == {"r": (1, 1), "s": (1, 0)}
    with pytest.raises(Exception, match="b"):
        profile.count_matrix(df, "row", "col", ["a"]).collect()
    pairs = df.select(F.col("col").alias("y_true"), F.lit("a").alias("y_pred"))
    with pytest.raises(Exception, match="b/a"):
        evaluate.confusion_matrix(pairs, ["a"]).collect()


def exchanged_columns(plan):
    """The output columns of every exchange in a physical plan."""
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "Exchange" in node.nodeName():
            output = node.output()
            found.append([output.apply(i).name() for i in range(output.length())])
        children = node.children()
        todo += [children.apply(i) for i in range(children.length())]
    return found


def test_text_is_not_moved(spark, sf_dir):
    """No exchange lies above a scan of the text that still carries it, even if nothing is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (items.items(spark, sf_dir), items.items(spark, sf_dir, prints=True)):
            plan = df._jdf.queryExecution().executedPlan()
            moved = exchanged_columns(plan)
            assert len(moved) >= 2 and not any("text" in columns for columns in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shortcut_report_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(f"i{i}", "c1" if i % 2 else "c2", f"k{i % 3}", f"s{i % 2}", [float(i % 3), float(rng.normal())], 1, 1, 1.0, 1.0, 1.0, i) for i in range(60)]
    df = spark.createDataFrame(rows, "image_id STRING, crop STRING, class_id STRING, dataset_id STRING, features ARRAY<DOUBLE>, width INT, height INT, aspect DOUBLE, "
                                     "brightness DOUBLE, sharpness_256 DOUBLE, file_bytes BIGINT")
    chosen = [p for p in probes.probe_table(trees=3, depth=3) if p.name == "class_by_features"]
    report = {(r.probe, r.scope): r for r in probes.shortcut_report(df, folds=2, probes=chosen).collect()}
    assert set(report) == {("class_by_features", "c1"), ("class_by_features", "c2")}
    assert all(0.3 < r.macro_f1 <= 1 for r in report.values())
    assert report["class_by_features", "c1"].note == "k0 0.333, k1 0.333, k2 0.333"
