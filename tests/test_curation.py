"""Whole runs over generated archives of poems: rules, nested archives, hashes, duplicates, re-runs, reports."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.operators.classify import classify_members
from sievework.plans import curation
from sievework.registry import RegistryError, choose, parse_registry, registry_problems
from sievework.session import small_table
from sievework.sources.archives import read_selected, scan_members
from sievework.sources.tables import read_table
from sievework.schema import MANIFEST

CLASSES = {"VERSE_CALM", "VERSE_STORM", "VERSE_OTHER"}


def poem(seed, words=80, changed=0):
    rng = random.Random(seed)
    text = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    for i in range(changed):
        text[-1 - i] = f"o{i}"
    return " ".join(text)


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    """Two archives: the names end in .webp as only picture names count as items; their content is text."""
    root = tmp_path_factory.mktemp("shelf")
    (root / "north.zip").write_bytes(packed({
        "north/first/Still Water/p1.webp": poem(1, 90), "north/first/Still Water/p1_again.webp": poem(1, 90),
        "north/second/still_water_late/p1 short.webp": poem(1, 90, changed=1), "north/first/Gale/p2.webp": poem(2),
        "north/first/Blank/p3.webp": poem(3), "north/drafts/Gale/p4.webp": poem(4), "north/first/Unclear/p5.webp": poem(5),
        "north/first/Gale/torn.webp": b"\xff\xfe\xff", "north/first/Elsewhere/p6.webp": poem(6), "north/loose.webp": poem(7),
        "north/notes.txt": "notes"}))
    (root / "south.zip").write_bytes(packed({
        "south/sealed/box.zip": packed({"hidden.webp": poem(8)}),
        "south/open/verses.zip": packed({"calm-a.webp": poem(2, changed=1), "storm-b.webp": poem(9), "other-c.webp": poem(10)})}))
    return str(root)


DOC = {"datasets": [
    {"id": "north", "crop": "verse", "class_map": {"Still Water": "VERSE_CALM", "Gale": "VERSE_STORM", "Blank": "drop", "Unclear": None},
     "severity_map": {"GALE": 4}, "local": {"label_strip_suffixes": ["_late"], "archives": [{"file": "north.zip", "downloaded": "2020-02-02", "rules": [
         {"pattern": "/drafts/", "exclude": "draft"}, {"pattern": "^north/(?P<split>first|second)/(?P<label>[^/]+)/"}]}]}},
    {"id": "south", "crop": "verse", "class_map": {"calm": "VERSE_CALM", "storm": "VERSE_STORM", "other": "VERSE_OTHER"}, "local": {"archives": [
        {"file": "south.zip", "rules": [{"pattern": r"verses\.zip!/(?P<label>[a-z]+)-"}, {"pattern": "/sealed/", "skip": "sealed_box"}]}]}}]}


def classes(spark):
    return small_table(spark, [(c, "verse", True) for c in sorted(CLASSES)], "class_id STRING, crop STRING, in_model BOOLEAN")


def by_name(run):
    return {r.member_path.split("/")[-1]: r for r in run.manifest.collect()}


def as_text(df):
    return sorted(map(str, df.collect()))


def test_registry():
    doc = {"datasets": [{"id": "a", "crop": "c"}, {"id": "b", "crop": "c", "class_map": {"x": "NONE_SUCH", "y": "drop", "z": None}, "local": {
        "archives": [{"file": "f", "rules": [{"pattern": "(?P<label>"}, {"pattern": "fine"}, {"skip": "no pattern"}]}]}}]}
    problems = registry_problems(doc, CLASSES)
    assert len(problems) == 4 and ["a" in problems[0], "NONE_SUCH" in problems[1], "rule 0" in problems[2], "rule 2" in problems[3]] == [True] * 4
    with pytest.raises(RegistryError, match="NONE_SUCH"):
        parse_registry(doc, CLASSES)
    assert parse_registry({}, CLASSES) == []
    north, south = parse_registry(DOC, CLASSES)
    assert (north.priority, south.priority, north.archives[0].downloaded, south.archives[0].downloaded) == (0, 1, "2020-02-02", None)
    assert [d.id for d in choose([north, south], ["south"])] == ["south"] and choose([north], None) == [north]
    with pytest.raises(RegistryError):
        choose([north], ["west"])


def test_run_and_repeated_run(spark, shelf, tmp_path):
    datasets, cache = parse_registry(DOC, CLASSES), str(tmp_path / "cache")
    run = curation.curate(spark, shelf, datasets, classes(spark), cache_path=cache)
    rows = by_name(run)
    assert len(rows) == 13
    assert (rows["p1.webp"].status, rows["p1.webp"].class_id, rows["p1.webp"].split_source) == ("use", "VERSE_CALM", "first")
    assert (rows["p1_again.webp"].reason, rows["p1_again.webp"].duplicate_of) == ("exact_duplicate", rows["p1.webp"].image_id)
    assert (rows["p1 short.webp"].reason, rows["p1 short.webp"].source_label) == ("near_duplicate", "still_water")
    assert {rows["p2.webp"].reason, rows["calm-a.webp"].reason} == {"duplicate_label_conflict"}
    assert rows["p2.webp"].dup_group == rows["calm-a.webp"].dup_group is not None and rows["p2.webp"].severity == 4
    assert (rows["p3.webp"].reason, rows["p3.webp"].sha256) == ("class_dropped", None)
    assert (rows["p4.webp"].reason, rows["p4.webp"].phash) == ("draft", None)
    assert (rows["p5.webp"].status, rows["p5.webp"].reason) == ("hold", "pending_taxonomy")
    assert (rows["p6.webp"].status, rows["p6.webp"].reason) == ("hold", "label_not_in_class_map")
    assert rows["loose.webp"].reason == "no_rule_matched"
    assert rows["torn.webp"].reason == "unreadable_image" and rows["torn.webp"].error_detail
    assert rows["other-c.webp"].class_id == "VERSE_OTHER"
    outcome = {r.outcome: r for r in run.duplicates.collect()}
    assert outcome["kept_one"].size == 3 and outcome["kept_one"].cross_split and outcome["label_conflict"].cross_dataset

    again = curation.curate(spark, shelf, datasets, classes(spark), cache_path=cache)
    assert run.hashed == 10 and again.hashed == 0 and as_text(again.manifest) == as_text(run.manifest)

    seen = {(r.kind, r.dataset_id): r.items for r in curation.warnings(run.manifest).collect()}
    assert seen == {("label without a class map entry", "north"): 1, ("unreadable", "north"): 1, ("no rule matched", "north"): 1}

    decided = spark.createDataFrame(
        [(rows["p1.webp"].image_id, "exclude", None, "unfit", 1), (rows["calm-a.webp"].image_id, "use", "VERSE_STORM", None, 2),
         ("nobody", "hold", None, "?", 3)], "image_id STRING, action STRING, class_id STRING, reason STRING, seq INT")
    after = by_name(curation.curate(spark, shelf, datasets, classes(spark), overrides=decided, cache_path=cache))
    assert after["p1_again.webp"].reason == after["p1 short.webp"].reason == "duplicate_of_rejected"
    assert (after["calm-a.webp"].status, after["calm-a.webp"].class_id) == ("use", "VERSE_STORM")
    assert after["p2.webp"].duplicate_of == after["calm-a.webp"].image_id


def test_a_damaged_cache_stops_the_run(spark, shelf, tmp_path):
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="FAILED_READ_FILE|CANNOT_READ"):
        curation.curate(spark, shelf, parse_registry(DOC, CLASSES), classes(spark), cache_path=str(tmp_path / "cache")).manifest.count()


def test_data_sets_that_share_an_archive(spark, shelf, tmp_path):
    """A cached run has the rows of the first one, and a row that one data set leaves out gets no hashes from the other."""
    rules = {"file": "south.zip", "rules": DOC["datasets"][1]["local"]["archives"][0]["rules"]}
    strict = {"file": "south.zip", "rules": [{"pattern": r"verses\.zip!/storm", "exclude": "stormy"}, *rules["rules"]]}
    doc = {"datasets": [{**DOC["datasets"][1], "id": "one", "local": {"archives": [rules]}}, {**DOC["datasets"][1], "id": "two", "local": {"archives": [strict]}}]}
    datasets, cache = parse_registry(doc, CLASSES), str(tmp_path / "cache")
    first = curation.curate(spark, shelf, datasets, classes(spark), cache_path=cache)
    again = curation.curate(spark, shelf, datasets, classes(spark), cache_path=cache)
    assert first.manifest.count() == 6 and (first.hashed, again.hashed) == (3, 0)
    assert as_text(first.manifest) == as_text(again.manifest)
    stormy = first.manifest.filter("reason = 'stormy'").collect()
    assert [(r.dataset_id, r.sha256) for r in stormy] == [("two", None)]


def test_partial_run_and_ordered_output(spark, shelf, tmp_path):
    datasets = parse_registry(DOC, CLASSES)
    part = curation.curate(spark, shelf, datasets, classes(spark), only=["south"])
    assert part.partial and {r.dataset_id for r in part.manifest.collect()} == {"south"}
    target = curation.write_manifest(part, str(tmp_path / "manifest"), "csv")
    assert target.endswith("manifest_partial")
    paths = [r.member_path for r in read_table(spark, target, MANIFEST, "csv").collect()]
    assert paths == sorted(paths) and len(paths) == 3
    with pytest.raises(RegistryError):
        curation.curate(spark, shelf, datasets, classes(spark), only=["south", "east"])


def test_list_only_and_archive_report(spark, shelf):
    datasets = parse_registry(DOC, CLASSES)
    listed = curation.curate(spark, shelf, datasets, classes(spark), list_only=True).manifest
    assert listed.count() == 13 and listed.filter("sha256 IS NOT NULL").count() == 0
    counts, skips, ignored = curation.archive_report(spark, shelf, datasets)
    got = {r.archive: (r.listed, r.skipped, r.ignored, r.unmatched, r.example) for r in counts.collect()}
    assert got == {"north.zip": (10, 0, 1, 1, "north/loose.webp"), "south.zip": (3, 1, 0, 0, None)}
    dated = {r.archive: r.dated for r in counts.collect()}
    assert dated["north.zip"] == "2020-02-02" and len(dated["south.zip"]) == 10
    assert [(r.archive, r.skip_reason, r.members) for r in skips.collect()] == [("south.zip", "sealed_box", 1)]
    assert [(r.archive, r.ext, r.members) for r in ignored.collect()] == [("north.zip", ".txt", 1)]
    with pytest.raises(FileNotFoundError):
        curation.list_members(spark, shelf + "/nowhere", datasets)


def test_a_skipped_nested_archive_stays_closed(spark, shelf):
    """The skip rule stands behind another rule; the outer path alone decides, whether the source or the rules apply it."""
    south = parse_registry(DOC, CLASSES)[1]
    closed = scan_members(spark, f"{shelf}/south.zip", south.archives[0].rules, root=shelf)
    assert "south/sealed/box.zip" in [r.member_path for r in closed.collect()]
    opened = scan_members(spark, f"{shelf}/south.zip", root=shelf)
    assert "south/sealed/box.zip!/hidden.webp" in [r.member_path for r in opened.collect()]
    for members in (closed, opened):
        kept = classify_members(members.filter(F.col("member_path").endswith(".webp")), [south])
        assert sorted(r.member_path.split("/")[-1] for r in kept.collect()) == ["calm-a.webp", "other-c.webp", "storm-b.webp"]
        kinds = [r.member_path for r in curation.member_kinds(members, [south]).filter("kind = 'skipped'").collect()]
        assert kinds == ["south/sealed/box.zip"]


def test_archive_slices_hold_every_member(spark, shelf):
    whole = scan_members(spark, f"{shelf}/*.zip", root=shelf)
    sliced = scan_members(spark, f"{shelf}/*.zip", root=shelf, slice_bytes=500, content=True)
    assert sliced.rdd.getNumPartitions() > 2
    assert sorted(r.member_path for r in whole.collect()) == sorted(r.member_path for r in sliced.collect())
    assert sliced.filter(F.length("content") != F.col("size")).count() == 0


def test_chosen_members_and_errors(spark, shelf):
    wanted = [("plain", "north.zip", "north/notes.txt"), ("inner", "south.zip", "south/open/verses.zip!/storm-b.webp"),
              ("twice", "south.zip", "south/open/verses.zip!/calm-a.webp"), ("member", "north.zip", "north/none.webp"),
              ("nested", "south.zip", "south/none.zip!/x.webp"), ("deep", "south.zip", "south/open/verses.zip!/none.webp"),
              ("bad", "north.zip", "north/notes.txt!/x"), ("archive", "west.zip", "x")]
    rows = spark.createDataFrame(wanted, "image_id STRING, archive STRING, member_path STRING")
    for slice_bytes in (100, 1 << 27):
        got = {r.image_id: r for r in read_selected(rows, shelf, slice_bytes=slice_bytes).collect()}
        assert bytes(got["plain"].content) == b"notes" and bytes(got["inner"].content) == poem(9).encode()
        assert bytes(got["twice"].content) == poem(2, changed=1).encode()
        assert all(got[k].content is None and got[k].error for k in ("member", "nested", "deep", "bad", "archive"))
        assert "nested archive" in got["nested"].error and "no such archive" in got["archive"].error
