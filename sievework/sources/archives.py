"""Zip archives as a Spark source: an index of members by tasks, and their bytes by ranges.

First the directories are read, also those of nested archives, one task for each archive file: the index has a row per
member with the place of its bytes. Members of the outer archive, and of nested archives that are stored without
compression, have a place in the file itself. So their bytes can be read in ranges of `slice_bytes` by as many tasks as there
are ranges, also inside one nested archive. Members of a compressed nested archive can only be reached through its stream;
each such archive is read by one task.

Files are opened through `pyarrow.fs`, by path or by URI. Conditions on archive, path, size and checksum (`where`) are applied
while the directories are read: archives that cannot match are no partition, and nested ones that cannot match stay closed.
They are given with the scan and not taken from the plan: in Spark 4.1 a Python source keeps the filters that were pushed
into it, and a second query on the same DataFrame then loses rows.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from contextlib import ExitStack
from datetime import timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievework.functions.text import NESTED_MARK
from sievework.registry import PathRule
from sievework.schema import MEMBERS, names
from sievework.session import SMALL_TABLE_ROWS, cut_lineage
from sievework.sources.files import described, joined, matching, open_store

SLICE_BYTES = 128 * 1024 * 1024
PLACES = "file STRING, at BIGINT, packed BIGINT, method INT, within BIGINT, inner BIGINT, error STRING"
ENTRIES, BATCH_BYTES, BATCH_MEMBERS = 4096, 8 << 20, 64
UNITS = 10_000  # tasks that read ranges, at most
SHAPE = pa.schema([("archive", pa.string()), ("member_path", pa.string()), ("crc", pa.int64()), ("size", pa.int64()), ("file", pa.string()),
                   ("at", pa.int64()), ("packed", pa.int64()), ("method", pa.int32()), ("within", pa.int64()), ("inner", pa.int64()), ("error", pa.string())])


class ArchiveFile(InputPartition):
    def __init__(self, file: str, archive: str):
        self.file, self.archive = file, archive


class ZipIndex(DataSource):
    """`spark.read.format("zip_index")`: a row per file in the archives that `paths` (a JSON list of paths or patterns) name.

    Options: `root` (archive names are relative to it), `rules` (JSON: archive name, or "*" for all, to a list of [pattern,
    is_skip] in order: a nested zip whose first matching rule is a skip rule is one member and not opened), `where` (JSON list
    of [column, kind, value], see `passes`). Nested zips are opened one level deep as "outer.zip!/inner". What cannot be
    opened is a row with an `error`.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_index"

    def schema(self) -> str:
        return MEMBERS + ", " + PLACES

    def reader(self, schema) -> DataSourceReader:
        return ZipIndexReader(dict(self.options))


class ZipIndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.root = options.get("root") or ""
        self.rules = json.loads(options.get("rules") or "{}")
        self.where = json.loads(options.get("where") or "[]")

    def partitions(self) -> list[ArchiveFile]:
        """One for each archive that can match; its directory is read by the task."""
        archives = {}
        for pattern in self.paths:
            for file, _ in matching(pattern):
                archives[file] = file[len(self.root.rstrip("/")) + 1:] if self.root else file.rpartition("/")[2]
        kept = [ArchiveFile(f, n) for f, n in sorted(archives.items()) if passes(self.where, {"archive": n})]
        return kept or [ArchiveFile("", "")]

    def read(self, part: ArchiveFile) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for entry in self._entries(part) if part.file else ():
            if entry[-1] is not None or passes(self.where, dict(zip(SHAPE.names, entry, strict=True))):
                rows.append(entry)
            if len(rows) == ENTRIES:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def _entries(self, part: ArchiveFile) -> Iterator[tuple]:
        rules = [(re.compile(p), skip) for p, skip in self.rules.get(part.archive, self.rules.get("*", []))]
        store, path = open_store(part.file)

        def broken(member: str | None, err: Exception) -> tuple:
            return (part.archive, member, *[None] * 2, part.file, *[None] * 5, f"{type(err).__name__}: {err}")

        with ExitStack() as stack:
            try:
                file = stack.enter_context(store.open_input_file(path))
                outer = stack.enter_context(zipfile.ZipFile(Window(file, 0, file.size())))
            except (zipfile.BadZipFile, OSError) as err:
                yield broken(None, err)
                return
            for info in in_order(outer):
                shut = next((skip for p, skip in rules if p.search(info.filename)), False)
                if not info.filename.lower().endswith(".zip") or shut:
                    yield (part.archive, info.filename, info.CRC, info.file_size, part.file, info.header_offset, info.compress_size,
                           info.compress_type, None, None, None)
                elif can_hold(self.where, info.filename + NESTED_MARK):
                    try:
                        yield from self._nested(part, file, outer, info)
                    except (zipfile.BadZipFile, OSError, zlib.error, NotImplementedError, RuntimeError) as err:
                        yield broken(info.filename, err)

    def _nested(self, part: ArchiveFile, file, outer: zipfile.ZipFile, info: zipfile.ZipInfo) -> Iterator[tuple]:
        stored = info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 1
        start = data_start(file, info.header_offset) if stored else 0
        with (Window(file, start, info.file_size) if stored else outer.open(info)) as packed, zipfile.ZipFile(packed) as inner:
            for m in in_order(inner):
                place = (start + m.header_offset, m.compress_size, m.compress_type, None, None) if stored else (
                    None, m.compress_size, m.compress_type, info.header_offset, m.header_offset)
                yield (part.archive, info.filename + NESTED_MARK + m.filename, m.CRC, m.file_size, part.file, *place, None)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SHAPE, strict=True)], schema=SHAPE)


TESTS = {"=": lambda a, b: a == b, "in": lambda a, b: a in b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b,
         "<=": lambda a, b: a <= b, "starts": lambda a, b: a.startswith(b), "ends": lambda a, b: a.lower().endswith(tuple(b) if isinstance(b, list) else b)}


def passes(where: Sequence, row: Mapping) -> bool:
    """Whether a row, of which some columns may not be known yet, meets the conditions (column, kind, value) on those that are.

    Kinds: = in > >= < <= starts ends; `ends` takes one ending or a list, in lower case, and ignores the case of the path.
    """
    return all(TESTS[kind](row[column], value) for column, kind, value in where if column in row)


def can_hold(where: Sequence, prefix: str) -> bool:
    """Whether a path that begins with `prefix` can meet the conditions."""
    for column, kind, value in where:
        if column == "member_path" and (
                kind == "=" and not value.startswith(prefix) or kind == "in" and not any(v.startswith(prefix) for v in value)
                or kind == "starts" and not (value.startswith(prefix) or prefix.startswith(value))):
            return False
    return True


class Window(io.RawIOBase):
    """A part of a file as a file of its own."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.position = file, start, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.position

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.position = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.position, io.SEEK_END: self.size}[whence])
        return self.position

    def read(self, size: int = -1) -> bytes:
        left = max(0, self.size - self.position)
        self.file.seek(self.start + self.position)
        data = self.file.read(left if size is None or size < 0 else min(size, left))
        self.position += len(data)
        return data


def in_order(handle: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return sorted((i for i in handle.infolist() if not i.is_dir()), key=lambda i: i.header_offset)


def data_start(file, header: int) -> int:
    """Where the bytes of the member begin whose local header is at `header`."""
    file.seek(header)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no member at byte {header}")
    return header + 30 + sum(struct.unpack("<HH", head[26:30]))


def member_index(spark: SparkSession, paths: Sequence[str], root: str = "", rules: Mapping[str, Sequence[PathRule]] | None = None,
                 where: Sequence[tuple] = ()) -> DataFrame:
    """Members of the archives that `paths` name and that meet the conditions `where`, with their places. Rules (by archive, "*"
    for all) only say which nested zips stay closed."""
    spark.dataSource.register(ZipIndex)
    unknown = [w for w in where if w[0] not in names(MEMBERS) or w[1] not in TESTS]
    if unknown:
        raise ValueError(f"no such condition: {unknown}")
    listed = {a: [[r.pattern, bool(r.skip)] for r in rs] for a, rs in (rules or {}).items()}
    return (spark.read.format("zip_index").option("paths", json.dumps(list(paths))).option("root", root).option("rules", json.dumps(listed))
            .option("where", json.dumps([list(w) for w in where])).load())


def scan_members(spark: SparkSession, path: str, rules: Sequence[PathRule] = (), content: bool = False, root: str = "",
                 slice_bytes: int = SLICE_BYTES, where: Sequence[tuple] = ()) -> DataFrame:
    """Members of the archives under `path` that meet `where`, with `content` also their bytes. What cannot be read stops the job.

    `classify_members` applies the rules to all members.
    """
    index = member_index(spark, [path], root, {"*": rules}, where)
    if not content:
        return readable_members(index)
    return read_places(cut_lineage(index), names(MEMBERS), slice_bytes).filter(_readable()).drop("error")


def readable_members(index: DataFrame) -> DataFrame:
    """The members of an index; what could not be opened stops the job."""
    return index.filter(_readable()).select(*names(MEMBERS))


def _readable() -> Column:
    stop = F.raise_error(F.concat_ws(" ", F.lit("cannot read"), "archive", "member_path", "error")).cast("boolean")
    return F.when(F.col("error").isNotNull(), stop).otherwise(True)


def archive_files(spark: SparkSession, root: str, files: Sequence[tuple[str, str | None]]) -> DataFrame:
    """(archive, file_bytes, modified, downloaded) of named archive files; there are as many rows as names."""
    rows = []
    for file, downloaded in files:
        found = described(joined(root, file))
        if found is None:
            raise FileNotFoundError(joined(root, file))
        rows.append((file, found.size, found.mtime.astimezone(timezone.utc).date(), downloaded))
    return spark.createDataFrame(rows, "archive STRING, file_bytes BIGINT, modified DATE, downloaded STRING")


def range_of(slice_bytes: int) -> Column:
    """The range that reads a member: that where it starts, or its compressed nested archive as a whole."""
    return F.coalesce(-F.col("within") - 1, F.floor(F.col("at") / slice_bytes))


def read_places(index: DataFrame, keep: Sequence[str], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The columns `keep` of index rows with `content` and `error`, read in ranges of `slice_bytes`.

    `index` is read twice and should be a written table. A bad member gives a row with an error.
    """
    units = index.select("file", range_of(slice_bytes).alias("_range")).distinct().count()
    dealt = index.withColumn("_range", range_of(slice_bytes)).repartition(max(1, min(units, UNITS)), "file", "_range")
    ordered = dealt.sortWithinPartitions("file", "_range", F.coalesce("at", "inner"))
    places = [f.name for f in SHAPE if f.name not in ("archive", "member_path")]
    rows = ordered.select(F.struct(*keep).alias("_kept"), *places)
    kind = rows.schema["_kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with PlaceReader() as reader:
            for batch in batches:
                start, contents, errors, held = 0, [], [], 0
                for i, row in enumerate(batch.select(places).to_pylist(), 1):
                    content, error = (None, row["error"]) if row["error"] is not None else reader.read(row)
                    contents.append(content)
                    errors.append(error)
                    held += len(content or b"")
                    if held > BATCH_BYTES or len(contents) == BATCH_MEMBERS or i == batch.num_rows:
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(contents)), pa.array(contents, pa.binary()),
                                                          pa.array(errors, pa.string())], ["_kept", "content", "error"])
                        start, contents, errors, held = i, [], [], 0

    return rows.mapInArrow(run, f"_kept {kind}, content BINARY, error STRING").select("_kept.*", "content", "error")


class PlaceReader:
    """Reads members by their places. The last file and the last compressed nested archive stay open: in sorted order each is
    opened once and its stream is read forward only."""

    def __init__(self):
        self.files, self.nested = ExitStack(), ExitStack()
        self.file = self.inner = None
        self.open: tuple = (None, None)

    def __enter__(self) -> PlaceReader:
        return self

    def __exit__(self, *_) -> None:
        self.nested.close()
        self.files.close()

    def _file(self, name: str) -> None:
        if self.open[0] != name:
            self.nested.close()
            self.files.close()
            self.open = (None, None)
            store, path = open_store(name)
            self.file = self.files.enter_context(store.open_input_file(path))
            self.open = (name, None)

    def read(self, row: Mapping) -> tuple[bytes | None, str | None]:
        try:
            self._file(row["file"])
            if row["within"] is not None:
                return self._inside(row["within"], row["inner"]), None
            self.file.seek(data_start(self.file, row["at"]))
            return unpacked(self.file.read(row["packed"]), row["method"], row["crc"], row["size"]), None
        except (zipfile.BadZipFile, OSError, zlib.error, EOFError, NotImplementedError, RuntimeError, KeyError) as err:
            return None, f"{type(err).__name__}: {err}"

    def _inside(self, within: int, inner: int) -> bytes:
        if self.open[1] != within:
            self.nested.close()
            self.open = (self.open[0], None)
            outer = self.nested.enter_context(zipfile.ZipFile(Window(self.file, 0, self.file.size())))
            packed = self.nested.enter_context(outer.open(next(i for i in outer.infolist() if i.header_offset == within)))
            handle = self.nested.enter_context(zipfile.ZipFile(packed))
            self.inner = handle, {i.header_offset: i for i in handle.infolist()}
            self.open = (self.open[0], within)
        handle, infos = self.inner
        return handle.read(infos[inner])


def unpacked(data: bytes, method: int, crc: int, size: int) -> bytes:
    """The bytes of a member, checked against its checksum."""
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif method == zipfile.ZIP_BZIP2:
        import bz2
        data = bz2.decompress(data)
    elif method != zipfile.ZIP_STORED:
        raise NotImplementedError(f"compression method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("wrong length or checksum")
    return data


def read_selected(rows: DataFrame, root: str, key: str = "image_id", index: DataFrame | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(key, content, error) of chosen members (key, archive, member_path); a bad row never stops the job.

    Members are found in `index`, or in one made of the archives that the rows name (few: more than SMALL_TABLE_ROWS are
    refused). Their bytes are read in ranges, so that a large archive, nested or not, is not read by one task.
    """
    spark = rows.sparkSession
    work = rows.select(key, "archive", "member_path")
    if index is None:
        archives = [r[0] for r in work.select("archive").filter("archive IS NOT NULL").distinct().limit(SMALL_TABLE_ROWS + 1).collect()]
        if len(archives) > SMALL_TABLE_ROWS:
            raise ValueError("too many archives")
        index = member_index(spark, [joined(root, a) for a in archives], root)
    index = cut_lineage(index)
    known = index.select("archive").distinct().withColumn("_known", F.lit(True))
    # a path that occurs twice in an archive counts once, its last occurrence, as zip readers have it
    last = index.filter("member_path IS NOT NULL").groupBy("archive", "member_path").agg(
        F.max_by(F.struct(*names(MEMBERS + ", " + PLACES)[2:]), F.coalesce("at", "inner", F.lit(0))).alias("_place"))
    found = work.join(known, "archive", "left").join(last, ["archive", "member_path"], "left").select("*", "_place.*").drop("_place")
    nested = F.col("member_path").contains(NESTED_MARK)
    missing = (F.when(F.col("_known").isNull(), F.concat(F.lit("no such archive: "), F.lit(joined(root, "")), F.coalesce("archive", F.lit("NULL"))))
               .when(F.col("file").isNull(), F.concat(F.coalesce("archive", F.lit("NULL")), F.when(nested, " has no such member of a nested archive: ")
                                                      .otherwise(" has no member "), F.coalesce("member_path", F.lit("NULL")))))
    placed = found.withColumn("error", F.coalesce("error", missing)).drop("_known")
    return read_places(cut_lineage(placed), [key], slice_bytes)
