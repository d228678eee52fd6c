"""Packing documents into sequences by shortest-pack-first over the length histogram.

Every document is tokenised, closed with an end id and cut into pieces: whole sequences first, then what remains. The
histogram of piece lengths has at most `seq_len` rows, so the packing itself is made on the driver whatever the number of documents: lengths are
placed longest first, each into the least filled pattern that has room, and pattern counts are updated. Pieces then
find their place by their rank among the pieces of the same length.

Null texts count as empty and give one piece with the end id. Extra columns are not read. Repeated rows are packed
as often as they occur; equal rows are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import bounded_batches, once_per_worker, whole_encoder
from sievework.session import cut_lineage

# Slices of the pieces of one length; ranks are counted inside slices.
SLICES = 512


def fast_encoder(tokenizer_file: str) -> Callable[[str], list[int]]:
    """The ids that `tokenizers` gives for a byte-level BPE file, without special tokens.

    The merges run in tiktoken over the same vocabulary, which is several times faster. A text that holds the
    string of an added token goes through `tokenizers` itself; one with a very long run of whitespace is split by `regex`.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(tokenizer_file)
    with open(tokenizer_file, encoding="utf-8") as file:
        spec = json.load(file)
    added = [t["content"] for t in spec["added_tokens"]]
    shown = _shown_bytes()
    ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    quick = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = whole_encoder(quick, public_tokenizers.PATTERN)

    def encode(text: str) -> list[int]:
        if any(a in text for a in added):
            return own.encode(text, add_special_tokens=False).ids
        return whole(text)
    return encode


def _shown_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary of a byte-level tokenizer file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def cuts(tokens: int, seq_len: int) -> list[int]:
    """Piece lengths of a document: whole sequences, then the rest."""
    return [seq_len] * (tokens // seq_len) + [tokens % seq_len] * (tokens % seq_len > 0)


def token_pieces(docs: DataFrame, tokenizer_file: str, seq_len: int, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, and the ids themselves with `keep_ids`."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once_per_worker(f"packing {tokenizer_file}", lambda: fast_encoder(tokenizer_file))
        for batch in batches:
            row, start, length, crc, total, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py()), end_id], dtype="<u4")
                at = 0
                for size in cuts(len(ids), seq_len):
                    part = ids[at:at + size]
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
                    at += size
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
                      pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{id_col}` {kind}, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT" + ", ids ARRAY<INT>" * keep_ids
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], seq_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (count, [(length, copies), …]) that hold every piece of the histogram {length: pieces}.

    `free[s]` lists the patterns with s free places. A length goes to the patterns with the most room; a group of
    patterns larger than the pieces left is split in two.
    """
    free: dict[int, list[tuple[int, tuple]]] = {}
    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        left = histogram[length]
        while left:
            room = max((s for s in free if s >= length), default=None)
            if room is None:
                free.setdefault(seq_len - length, []).append((left, ((length, 1),)))
                break
            count, pattern = free[room].pop()
            if not free[room]:
                del free[room]
            used = min(count, left)
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            free.setdefault(room - length, []).append((used, grown))
            if used < count:
                free.setdefault(room, []).append((count - used, pattern))
            left -= used
    return [(count, list(pattern)) for room in sorted(free) for count, pattern in free[room]]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, sequences, offset), sorted by length and first rank."""
    rows, taken, sequence = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            first = taken.get(length, 0)
            rows.append((length, first, count * copies, sequence, count, offset))
            taken[length] = first + count * copies
            offset += length * copies
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, seq_len: int, order: list[str], length: str = "length") -> DataFrame:
    """Add sequence_id and offset to pieces with a length from 1 to `seq_len`. `pieces` is read three times."""
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most seq_len rows
    plan = slots(shortest_pack_first(histogram, seq_len))
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)).cast("int"))
    counts = sliced.groupBy(length, "_slice").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(length).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(length, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(length, "_slice").orderBy(*order))
    ranked = sliced.withColumn("_in", inside).join(starts, [length, "_slice"])
    ranked = ranked.select(*pieces.columns, (F.col("_start") + F.col("_in") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            size, rank = batch.column(length).to_numpy(), batch.column("_rank").to_numpy()
            slot = plan[np.searchsorted(key, size << 44 | rank, side="right") - 1]
            nth = rank - slot[:, 1]
            sequence = slot[:, 3] + nth % np.maximum(slot[:, 4], 1)
            offset = slot[:, 5] + size * (nth // np.maximum(slot[:, 4], 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                                             [*batch.schema.names[:-1], "sequence_id", "offset"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, columns + ", sequence_id BIGINT, offset BIGINT")


def pack_documents(docs: DataFrame, tokenizer_file: str, seq_len: int = 2048, end_id: int = 1,
                   id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset. Tokenised pieces are written once."""
    pieces = cut_lineage(token_pieces(docs, tokenizer_file, seq_len, end_id, id_col, text_col, keep_ids=keep_ids))
    return pack(pieces, seq_len, [id_col, "start", "ids_crc32"])
