"""Indexed archives: ranges inside a stored nested archive, conditions, damage, and URIs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.operators.quality import mark_unreadable
from sievework.registry import PathRule
from sievework.sources import archives
from sievework.sources.archives import member_index, read_places, read_selected, scan_members
from sievework.sources.files import matching


def zipped(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data, compress_type=zipfile.ZIP_STORED if name.endswith(".zip") and method == "nested stored" else
                       zipfile.ZIP_DEFLATED if isinstance(method, str) else method)
    return out.getvalue()


def noise(i, n=900):
    return bytes((i * 131 + k * k * 7 + k // 3) % 256 for k in range(n))


INNER = {f"in/{i:02d}.bin": noise(i) for i in range(40)}


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    (root / "stored.zip").write_bytes(zipped({"a.txt": b"first", "box.zip": zipped(INNER), "z.txt": b"last"}, "nested stored"))
    (root / "packed.zip").write_bytes(zipped({"a.txt": b"first", "box.zip": zipped(INNER), "b.txt": noise(9, 50_000)}))
    (root / "kinds.zip").write_bytes(zipped({"s": b"bz" * 99}, zipfile.ZIP_BZIP2))
    return str(root)


def test_a_stored_nested_archive_is_read_by_several_tasks(spark, store):
    index = archives.cut_lineage(member_index(spark, [f"{store}/stored.zip"], store))
    assert index.filter("within IS NOT NULL OR at IS NULL").count() == 0
    rows = read_places(index, ["member_path", "size"], slice_bytes=4000).withColumn("task", F.spark_partition_id()).collect()
    inner = [r for r in rows if "!/" in r.member_path]
    assert sorted(r.member_path for r in rows) == sorted(["a.txt", "z.txt", *[f"box.zip!/{n}" for n in INNER]])
    assert all(bytes(r.content) == INNER[r.member_path.partition("!/")[2]] and r.error is None for r in inner)
    assert len({r.task for r in inner}) >= 4


def test_a_compressed_nested_archive_is_read_by_one_task(spark, store):
    index = archives.cut_lineage(member_index(spark, [f"{store}/packed.zip"], store))
    rows = read_places(index, ["member_path"], slice_bytes=100).withColumn("task", F.spark_partition_id()).collect()
    inner = [r for r in rows if "!/" in r.member_path]
    assert len(inner) == 40 and len({r.task for r in inner}) == 1 and all(bytes(r.content) == INNER[r.member_path.partition("!/")[2]] for r in inner)


def test_conditions_keep_archives_and_nested_archives_closed(spark, store, monkeypatch):
    everything = {(r.archive, r.member_path): r for r in member_index(spark, [f"{store}/*.zip"], store).collect()}
    for where, keep in (
            ([("archive", "=", "packed.zip")], lambda r: r.archive == "packed.zip"),
            ([("archive", "in", ["stored.zip", "none.zip"]), ("size", ">=", 900)], lambda r: r.archive == "stored.zip" and r["size"] >= 900),
            ([("member_path", "starts", "box.zip!/in/0")], lambda r: r.member_path.startswith("box.zip!/in/0")),
            ([("member_path", "ends", [".txt", ".jpg"]), ("size", "<", 6)], lambda r: r.member_path.endswith(".txt") and r["size"] < 6)):
        got = member_index(spark, [f"{store}/*.zip"], store, where=where)
        assert {(r.archive, r.member_path) for r in got.collect()} == {k for k, r in everything.items() if keep(r)}
        assert got.filter("size > 0").count() == got.count()
    reader = archives.ZipIndexReader({"paths": f'["{store}/*.zip"]', "root": store, "where": '[["archive", "=", "packed.zip"], ["member_path", "starts", "a"]]'})
    parts = reader.partitions()
    assert [p.archive for p in parts] == ["packed.zip"]
    monkeypatch.setattr(archives.ZipIndexReader, "_nested", lambda *_: pytest.fail("opened"))
    assert [b.column("member_path").to_pylist() for b in reader.read(parts[0])] == [["a.txt"]]
    with pytest.raises(ValueError, match="no such condition"):
        member_index(spark, [store], where=[("content", "=", 1)])


def test_the_same_scan_may_be_filtered_again_and_again(spark, store):
    members = scan_members(spark, f"{store}/*.zip", root=store)
    n = members.count()
    assert members.filter(F.col("member_path").endswith(".txt")).count() == 4 and members.count() == n
    assert members.filter("archive = 'kinds.zip'").count() == 1 and members.count() == n


def test_damage(spark, tmp_path):
    good = zipped({"x.txt": b"fine", "y.txt": noise(3)}, zipfile.ZIP_STORED)
    (tmp_path / "bad.zip").write_bytes(good.replace(noise(3)[100:110], b"0123456789"))
    (tmp_path / "none.zip").write_bytes(b"this is no archive")
    (tmp_path / "nest.zip").write_bytes(zipped({"k.zip": b"nor is this", "t.txt": b"ok"}))
    root = str(tmp_path)
    rows = spark.createDataFrame([("1", "bad.zip", "x.txt"), ("2", "bad.zip", "y.txt"), ("3", "none.zip", "x"), ("4", "nest.zip", "t.txt"),
                                  ("5", "nest.zip", "k.zip!/q"), ("6", None, None), ("1", "bad.zip", "x.txt")], "image_id STRING, archive STRING, member_path STRING")
    got = {r.image_id: r for r in read_selected(rows, root).collect()}
    assert bytes(got["1"].content) == b"fine" and bytes(got["4"].content) == b"ok"
    assert "checksum" in got["2"].error and all(got[k].error and got[k].content is None for k in "2356")
    for name in ("none", "nest"):
        with pytest.raises(Exception, match="cannot read"):
            scan_members(spark, f"{root}/{name}.zip", root=root).collect()
    shut = scan_members(spark, f"{root}/nest.zip", [PathRule("k.zip", skip="shut")], root=root, content=True)
    assert {r.member_path: bytes(r.content) for r in shut.collect()} == {"k.zip": b"nor is this", "t.txt": b"ok"}


def test_uris_patterns_and_methods(spark, store):
    assert [f.rpartition("/")[2] for f, _ in matching(f"file://{store}/*ed.zip")] == ["packed.zip", "stored.zip"]
    assert matching(f"{store}/none.zip") == [] and matching(f"{store}/no/*.zip") == []
    rows = scan_members(spark, f"file://{store}/kinds.zip", root=f"file://{store}", content=True).collect()
    assert [(r.archive, r.member_path, bytes(r.content)) for r in rows] == [("kinds.zip", "s", b"bz" * 99)]
    assert scan_members(spark, f"{store}/none*.zip", root=store).count() == 0


def test_errors_are_cut(spark):
    row = spark.createDataFrame([("use", None, "e" * 500), ("use", None, None)], "status STRING, reason STRING, error STRING")
    assert [len(r.error_detail or "") for r in mark_unreadable(row).collect()] == [200, 0]
