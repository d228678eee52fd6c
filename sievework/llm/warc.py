"""WARC archives: a writer that records repeated payloads once, and a splittable reader.

Every record is a gzip member of its own. A reading task gets a byte range, looks for the gzip magic, accepts a
position only if the header decodes and the content starts with a WARC version line, and then walks from member to
member. It owns the records that start inside its range and reads the last one to its end, so ranges need no index
and every record is read once.

Nothing is passed over: a member that does not decode, ends early, fails its checksum, states another length than it has or
another digest than its payload, and a place where a record should start and none does, is damage. Damage stops the job
with the file and the byte, or, with the option damaged=keep, becomes a row with an `error`; reading goes on at the next
member. The task that reads a record also looks at the place after it, so damage at the edge of a range is seen once.

Both sides are Spark data sources: `write.format("warc_pages")` puts one file per task under an own name and
publishes it when the job commits, so a repeated task leaves no record behind; `read.format("warc")` lists the
files once and plans ranges. Folders are opened through `pyarrow.fs`, by path or by URI.

Null payloads count as empty, null addresses are left out of the record, null page ids give records without an id
that are never shared. Repeated page ids are written as often as they occur. Extra columns are not read. A payload is
held whole in one task, and rows are handed on after every 8 MB. An empty table writes no file; an empty or missing
folder reads as an empty table.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from sievework.llm.common import attach, bounded_batches
from sievework.session import cut_lineage

MAGIC = b"\x1f\x8b\x08"
SHARED_BYTES = 100
RANGE_BYTES = 32 << 20
BLOCK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORD = ("page_id BIGINT, url STRING, record_type STRING, refers_to BIGINT, payload_digest STRING, "
          "payload_bytes BIGINT")


def open_folder(uri: str):
    """File system and path of a folder given as a path or a URI."""
    from pyarrow import fs
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:/*", "file:///", uri))
    return fs.LocalFileSystem(), uri


# ---------------------------------------------------------------- writing

def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit carries the HTTP head with the length of the full payload only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_record_id(page_id)}>", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_record_id(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    block = head + (payload if refers_to is None else b"")
    lines.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"), pack.flush()])


def _record_id(page_id: int | None) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"


class WarcPages(DataSource):
    """`df.write.format("warc_pages").option("path", folder)`: columns page_id, url, html, digest, refers_to."""

    @classmethod
    def name(cls) -> str:
        return "warc_pages"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"])


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        name, out = f"{uuid.uuid4().hex}.warc.gz", None
        for batch in batches:
            if out is None and batch.num_rows:
                store, root = open_folder(self.folder)
                store.create_dir(f"{root}/_written", recursive=True)
                out = store.open_output_stream(f"{root}/_written/{name}", compression=None, buffer_size=BLOCK)
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                payload = (html.as_py() or "").encode("utf-8")
                out.write(encode_record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py()))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages) -> None:
        store, root = open_folder(self.folder)
        store.create_dir(root, recursive=True)
        for message in messages:
            if message is not None and message.name:
                store.move(f"{root}/_written/{message.name}", f"{root}/{message.name}")

    def abort(self, messages) -> None:
        store, root = open_folder(self.folder)
        for message in messages:
            if message is not None and message.name:
                store.delete_file(f"{root}/_written/{message.name}")


def with_references(pages: DataFrame) -> DataFrame:
    """Add digest and refers_to: of equal payloads of at least SHARED_BYTES bytes, the smallest page_id is kept."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"))
    known = pages.filter((F.octet_length("html") >= SHARED_BYTES) & F.col("page_id").isNotNull())
    shared = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    spread = F.concat(F.lit("~"), F.xxhash64("page_id").cast("string"))
    joined = attach(pages, cut_lineage(shared), "digest", "n", spread)
    # the first row of a repeated page id is as good as the others: all of them are responses
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Write a record per row of pages (page_id, url, html) to new files under `folder`."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcPages)
    bounded_batches(spark)
    with_references(pages).write.format("warc_pages").mode("append").option("path", folder).save()


# ---------------------------------------------------------------- reading

class ByteSource:
    """A file read forward from any position, a block at a time."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, count: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(count, max(0, self.size - at)))


def find_member(source: ByteSource, at: int, end: int) -> int | None:
    """The first position in [at, end) where a gzip member with a WARC record starts."""
    while at < end:
        data = source.read(at, BLOCK + len(MAGIC) - 1)
        hit = data.find(MAGIC)
        while 0 <= hit < BLOCK:
            if at + hit >= end:
                return None
            if _is_record(source.read(at + hit, 4096)):
                return at + hit
            hit = data.find(MAGIC, hit + 1)
        at += BLOCK
    return None


def _is_record(data: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data, 5) == b"WARC/"
    except zlib.error:
        return False


def read_member(source: ByteSource, at: int) -> tuple[bytes, int]:
    """The content of the member at `at`, and where the next one starts."""
    unpack, parts, position = zlib.decompressobj(31), [], at
    while not unpack.eof:
        data = source.read(position, BLOCK // 8)
        if not data:
            raise EOFError(f"a record at byte {at} is cut off")
        parts.append(unpack.decompress(data))
        position += len(data)
    return b"".join(parts), position - len(unpack.unused_data)


def records(source: ByteSource, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """Position, headers, block and damage (None for a sound record) of the records that start in [start, end)."""
    at = start if start == 0 and source.size else find_member(source, start, end)
    while at is not None and (at < end or at < source.size and not _is_record(source.read(at, 4096))):
        after = None
        try:
            if not _is_record(source.read(at, 4096)):
                raise ValueError("no record starts here")
            data, after = read_member(source, at)
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode("utf-8").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            block = rest[:-4]
            if int(fields["content-length"]) != len(block) or rest[-4:] != b"\r\n\r\n":
                raise ValueError("the record has not the length it states")
            yield at, fields, block, None
        except (zlib.error, EOFError, KeyError, ValueError) as damage:
            yield at, {}, b"", f"{type(damage).__name__}: {damage}"
        at = after if after is not None else find_member(source, at + 1, end)


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class Warc(DataSource):
    """`spark.read.format("warc").option("path", folder)`: a row per record; option content=true adds the payload, option
    damaged=keep the file, the position, and the error of what is damaged."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD + (", payload BINARY" if self._content() else "") + (
            ", file STRING, position BIGINT, error STRING" if self._keep() else "")

    def _content(self) -> bool:
        return self.options.get("content", "false") == "true"

    def _keep(self) -> bool:
        return self.options.get("damaged", "fail") == "keep"

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), self._content(), self._keep())


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, content: bool, keep: bool):
        self.folder, self.range_bytes, self.content, self.keep = folder, range_bytes, content, keep

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs
        store, root = open_folder(self.folder)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        files = sorted((f for f in found if f.is_file and f.path.endswith(".warc.gz")), key=lambda f: f.path)
        return [ByteRange(f.path, at, min(at + self.range_bytes, f.size), f.size)
                for f in files for at in range(0, f.size, self.range_bytes)] or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, _ = open_folder(self.folder)
        with store.open_input_file(part.path) as file:
            rows, held = [], 0
            for at, fields, block, error in records(ByteSource(file, part.size), part.start, part.end):
                row: tuple = (None,) * 6 + (b"",)
                if error is None:
                    try:
                        row = describe(fields, block)
                    except (KeyError, TypeError, ValueError) as damage:
                        error = f"{type(damage).__name__}: {damage}"
                if error is not None and not self.keep:
                    raise ValueError(f"damaged record in {part.path} at byte {at}: {error}")
                held += len(row[-1])
                rows.append((row if self.content else row[:-1]) + ((part.path, at, error) if self.keep else ()))
                if held > 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                 ("payload_digest", pa.string()), ("payload_bytes", pa.int64())] + [("payload", pa.binary())] * self.content
        kinds += [("file", pa.string()), ("position", pa.int64()), ("error", pa.string())] * self.keep
        return pa.RecordBatch.from_arrays([pa.array(c, k[1]) for c, k in zip(zip(*rows), kinds, strict=True)],
                                          [k[0] for k in kinds])


def describe(fields: dict[str, str], block: bytes) -> tuple:
    """The row of a record. A response's digest and length come from its payload; a wrong digest is an error."""
    from urllib.parse import unquote
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"].partition(":")[2]
    length = len(payload)
    if fields["warc-type"] == "response":
        digest = hashlib.sha256(payload).hexdigest()
        if digest != stated:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    else:
        digest = stated
        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    url = fields.get("warc-target-uri")
    return (_page_id(fields["warc-record-id"]), None if url is None else unquote(url), fields["warc-type"],
            _page_id(fields.get("warc-refers-to", "")), digest, length, payload)


def _page_id(record_id: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id)
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, folder: str, content: bool = False, range_bytes: int = RANGE_BYTES,
                  damaged: str = "fail") -> DataFrame:
    """Every record under `folder`: page_id, url, record_type, refers_to, payload_digest, payload_bytes [, payload]; with
    damaged="keep" also file, position and error, and a row for all that is damaged."""
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("path", folder).option("range_bytes", str(range_bytes)).option(
        "content", str(content).lower()).option("damaged", damaged).load()
