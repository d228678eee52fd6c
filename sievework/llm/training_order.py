"""Token ids as fixed-stride shards in training order.

Documents are tokenised once, closed with an end id and cut into sequences of at most `seq_len` ids. Sequences are
numbered without gaps: by the task that wrote them and their place in it. A keyed Feistel network permutes the
numbers; a value that falls outside their range is sent through again until it is inside, so every number gets one slot
of a gapless range. A shard is a range of slots and a file: record i lies at byte i * stride, so training reads files
from front to back and resumes at any slot by a division. Rows travel to their shard in packed groups, and a shard is
filled in place without sorting.

Null texts count as empty and give one sequence with the end id. Rows without an id are marked as such in the record and
read back without one; ids that are no integers are refused. Repeated rows are written as often as they occur. Very long
texts are cut into sequences like others; a task holds the ids of one text. Extra columns are not read. An empty table writes
no file. The same written numbering and key give the same files, so a repeated task replaces its file by an equal one.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievework.llm.common import bounded_batches, once_per_worker, whole_encoder
from sievework.llm.warc import open_folder
from sievework.session import shared_folder

ROUNDS = 6
# The top bit of start marks a record without an id.
HEAD = np.dtype([("doc_id", "<i8"), ("start", "<u4"), ("length", "<u2")])
NO_ID = 1 << 31
ZSTD_LEVEL = 9
GROUP_BYTES = 16 << 20


# ---------------------------------------------------------------- permutation

def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function of values and a round key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(values: np.ndarray, size: int, key: int) -> np.ndarray:
    """Where the keyed permutation of range(size) sends each of `values`."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(k) for k in np.random.default_rng(key).integers(0, 1 << 63, ROUNDS)]
    out = np.array(values, np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        x = out[walking]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        out[walking] = left << shift | right
        walking = out >= np.uint64(max(size, 1))
    return out.astype(np.int64)


# ---------------------------------------------------------------- tokens

def _encoder(rank_file: str, pattern: str):
    import tiktoken
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return whole_encoder(tiktoken.Encoding("order", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), pattern)


def write_tokens(docs: DataFrame, folder: str, rank_file: str, pattern: str, end_id: int, seq_len: int,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents: their ids, sizes (negative for a document without an id) and tokens, packed, and the place of their
    sequences: part, and number of the first within the part."""
    spark = docs.sparkSession
    kind = dict(docs.select(id_col).dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids in training order must be integers, and {id_col} is {kind}")
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext
        encode = once_per_worker(f"order {rank_file}", lambda: _encoder(rank_file, pattern))
        pack = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
        part, done = TaskContext.get().partitionId(), 0
        documents, ids, held = [], [], 0

        def group() -> pa.RecordBatch:
            size = np.array([len(i) for i in ids], "<i8")
            signed = np.where([d is None for d in documents], -size, size)
            columns = (np.array([d or 0 for d in documents], "<i8").tobytes(), signed.tobytes(), pack.compress(np.concatenate(ids).tobytes()))
            return pa.RecordBatch.from_arrays(
                [*(pa.array([c], pa.binary()) for c in columns), pa.array([part], pa.int32()), pa.array([done], pa.int64()),
                 pa.array([int((-(-size // seq_len)).sum())], pa.int64())], ["documents", "sizes", "ids", "part", "first", "sequences"])

        for batch in batches:
            for document, text in zip(batch.column(0), batch.column(1), strict=True):
                documents.append(document.as_py())
                ids.append(np.array([*encode(text.as_py()), end_id], "<u2"))
                held += ids[-1].nbytes
                if held >= GROUP_BYTES:
                    out = group()
                    done += out.column(5)[0].as_py()
                    documents, ids, held = [], [], 0
                    yield out
        if ids:
            yield group()

    rows = docs.select(F.col(id_col).cast("bigint"), F.coalesce(text_col, F.lit("")).alias("_t"))
    tokens = rows.mapInArrow(run, "documents BINARY, sizes BINARY, ids BINARY, part INT, first BIGINT, sequences BIGINT")
    tokens.write.option("compression", "uncompressed").parquet(folder)
    return spark.read.parquet(folder)


# ---------------------------------------------------------------- shards

def write_shards(docs: DataFrame, folder: str, rank_file: str, pattern: str, end_id: int, seq_len: int, shard_rows: int,
                 key: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards of all documents under `folder`; a row per shard: shard, file, rows."""
    if end_id >= 1 << 16 or seq_len >= 1 << 16:
        raise ValueError("ids and lengths are stored in 16 bits")
    spark = docs.sparkSession
    tokens = write_tokens(docs, f"{shared_folder(spark)}/{uuid.uuid4().hex}", rank_file, pattern, end_id, seq_len, id_col, text_col)
    counts = tokens.groupBy("part").agg(F.sum("sequences").alias("n"))  # one row per task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    placed = tokens.join(F.broadcast(bases), "part").select("documents", "sizes", "ids", (F.col("base") + F.col("first")).alias("first"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        pack, unpack = zstandard.ZstdCompressor(level=ZSTD_LEVEL), zstandard.ZstdDecompressor()
        for batch in batches:
            for documents, sizes, ids, first in zip(*batch.columns, strict=True):
                documents, signed = np.frombuffer(documents.as_buffer(), "<i8"), np.frombuffer(sizes.as_buffer(), "<i8")
                size = np.abs(signed)
                ids = np.frombuffer(unpack.decompress(ids.as_buffer()), "<u2")
                count = -(-size // seq_len)
                doc = np.repeat(np.arange(len(size)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * seq_len
                length = np.minimum(size[doc] - start, seq_len)
                at = np.repeat(np.cumsum(size) - size, count) + start
                marked = start | (signed[doc] < 0) * NO_ID
                slot = permute(first.as_py() + np.arange(len(doc)), total, key)
                order = np.argsort(slot)
                out = []
                for part in np.split(order, np.flatnonzero(np.diff(slot[order] // shard_rows)) + 1):
                    body = [(slot[part] % shard_rows).astype("<u4"), documents[doc[part]], marked[part].astype("<u4"), length[part].astype("<u2"),
                            *(ids[a:a + n] for a, n in zip(at[part].tolist(), length[part].tolist(), strict=True))]
                    out.append((int(slot[part[0]] // shard_rows), len(part), pack.compress(b"".join([b.tobytes() for b in body]))))
                shard, rows, body = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(rows, pa.int64()), pa.array(body, pa.binary())],
                                                 ["shard", "rows", "body"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        record = np.dtype([("head", HEAD), ("ids", "<u2", seq_len)])
        current, held, written = None, None, []

        def close() -> None:
            rows = min(shard_rows, total - current * shard_rows)
            name = f"shard-{current:010d}.tokens"
            draft = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(memoryview(held[:rows]).cast("B") if rows else b"")
            store.move(draft, f"{root}/{name}")
            written.append((current, name, rows))

        for batch in batches:
            for shard, rows, body in zip(*batch.columns, strict=True):
                if shard.as_py() != current:
                    if current is not None:
                        close()
                    current, held = shard.as_py(), np.zeros(shard_rows, record)
                n, data = rows.as_py(), unpack.decompress(body.as_buffer())
                row, length = np.frombuffer(data, "<u4", n), np.frombuffer(data, "<u2", n, 16 * n).astype(np.int64)
                held["head"]["doc_id"][row] = np.frombuffer(data, "<i8", n, 4 * n)
                held["head"]["start"][row] = np.frombuffer(data, "<u4", n, 12 * n)
                held["head"]["length"][row] = length
                ids = np.frombuffer(data, "<u2", -1, 18 * n)
                held["ids"][np.repeat(row, length), np.arange(len(ids)) - np.repeat(np.cumsum(length) - length, length)] = ids
        if current is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in written], pa.int64()), pa.array([w[1] for w in written], pa.string()),
                                          pa.array([w[2] for w in written], pa.int64())], ["shard", "file", "rows"])

    groups = placed.mapInArrow(deal, "shard BIGINT, rows BIGINT, body BINARY")
    tasks = min(-(-total // shard_rows) or 1, 100_000)
    shards = groups.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(fill, "shard BIGINT, file STRING, rows BIGINT")
    done = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    shards.write.parquet(done)
    return spark.read.parquet(done)


class RowRange(InputPartition):
    def __init__(self, path: str, shard: int, start: int, end: int):
        self.path, self.shard, self.start, self.end = path, shard, start, end


class TokenShards(DataSource):
    """`spark.read.format("token_shards")`; options path, seq_len, shard_rows, start_slot, ids ("true" adds them)."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return ("slot BIGINT, shard BIGINT, doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT"
                + ", ids ARRAY<INT>" * (self.options.get("ids", "false") == "true"))

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(self.options)


class ShardReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.seq_len = options["path"], int(options["seq_len"])
        self.shard_rows, self.start = int(options["shard_rows"]), int(options.get("start_slot", "0"))
        self.ids = options.get("ids", "false") == "true"
        self.record = HEAD.itemsize + 2 * self.seq_len

    def partitions(self) -> list[RowRange]:
        """Row ranges of the shards from `start_slot` on; earlier shards are not opened."""
        from pyarrow import fs
        store, root = open_folder(self.folder)
        out, step = [], max(1, (32 << 20) // self.record)
        for f in sorted(store.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda f: f.path):
            if not f.base_name.startswith("shard-"):
                continue
            shard = int(f.base_name[6:16])
            first = max(0, self.start - shard * self.shard_rows)
            rows = f.size // self.record
            out += [RowRange(f.path, shard, at, min(rows, at + step)) for at in range(first, rows, step)]
        return out or [RowRange("", 0, 0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, _ = open_folder(self.folder)
        kind = np.dtype([("head", HEAD), ("ids", "<u2", self.seq_len)])
        with store.open_input_file(part.path) as file:
            for at in range(part.start, part.end, 8192):
                file.seek(at * self.record)
                rows = np.frombuffer(file.read(self.record * min(8192, part.end - at)), kind)
                length = rows["head"]["length"].astype(np.int64)
                crc = [zlib.crc32(ids[:n].astype("<u4").tobytes()) for ids, n in zip(rows["ids"], length.tolist(), strict=True)]
                columns = [pa.array(part.shard * self.shard_rows + at + np.arange(len(rows))), pa.array(np.full(len(rows), part.shard)),
                           pa.array(rows["head"]["doc_id"], mask=rows["head"]["start"] >= NO_ID),
                           pa.array(rows["head"]["start"].astype(np.int64) % NO_ID), pa.array(length), pa.array(crc, pa.int64())]
                names = ["slot", "shard", "doc_id", "start", "length", "ids_crc32"]
                if self.ids:
                    columns.append(pa.array([i[:n].astype(np.int32) for i, n in zip(rows["ids"], length.tolist(), strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)


def read_shards(spark: SparkSession, folder: str, seq_len: int, shard_rows: int, start_slot: int = 0, ids: bool = False) -> DataFrame:
    """The sequences in the shards from `start_slot` on: slot, shard, doc_id, start, length, ids_crc32 [, ids]."""
    spark.dataSource.register(TokenShards)
    options = {"path": folder, "seq_len": seq_len, "shard_rows": shard_rows, "start_slot": start_slot, "ids": str(ids).lower()}
    return spark.read.format("token_shards").options(**options).load()
