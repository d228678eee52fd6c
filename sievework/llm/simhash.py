"""Near-duplicate documents by SimHash, with pivot distance tables.

A document's fingerprint has a bit set where more than half of its shingle hashes have it. Equal fingerprints form
one class. Classes that may link meet by the pigeonhole principle: 64 bits are cut into `blocks` parts, and two
fingerprints with at most `distance` differing bits agree on `blocks - distance` whole parts, so each class is
listed once for every choice of that many parts. Where classes meet, their precomputed distances to reference
fingerprints are compared: by the triangle inequality a pair with any coordinate further apart than
`distance` is no link. Survivors are verified on the fingerprints. A meeting point gives at most one edge per
class, whatever the number of pairs in it, and one with many classes is cut into blocks that meet pairwise.

The number of parts should grow with the corpus: 5 parts make 10 lists keyed by some 25 bits, 7 make 35 keyed by 36.

Null texts count as empty; a text without words has fingerprint zero and links like any other. Rows without an id
get their fingerprint and the component of equal fingerprints, but are never named and make no link. Repeated rows are
repeated in the result. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import attach, block_pairs, bounded_batches, components, forest, whole_units
from sievework.session import cut_lineage

SEED = 42
PIVOTS = 16
UNIT_ROWS = 2048
SEGMENT = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: str, words: int = 3) -> Iterator[np.ndarray]:
    """XXH64 of every run of `words` words of the text in ASCII lower case, a segment of the text at a time."""
    data = text.encode("utf-8").lower()
    at, held, first = 0, [], True
    while at < len(data):
        stop = _SPACE.search(data, min(len(data), at + SEGMENT))
        end = stop.start() if stop else len(data)
        held += data[at:end].split()
        at = end
        if len(held) >= words:
            runs = zip(*(held[i:] for i in range(words)), strict=False)
            yield np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64)
            held, first = held[len(held) - words + 1:], False
    if first and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    """The fingerprint as a signed 64-bit number."""
    set_bits, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * set_bits > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [id_col, "fp"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, fp BIGINT")


def pivot_columns() -> list[Column]:
    """The distances of `fp` to PIVOTS reference fingerprints, eight to a long."""
    chosen = np.random.default_rng(SEED).integers(-(1 << 63), 1 << 63, PIVOTS, dtype=np.int64).tolist()
    packed = []
    for start in range(0, PIVOTS, 8):
        parts = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("bigint"), 8 * i)
                 for i, p in enumerate(chosen[start:start + 8])]
        total = parts[0]
        for part in parts[1:]:
            total = total.bitwiseOR(part)
        packed.append(total.alias(f"p{start // 8}"))
    return packed


def meeting_keys(distance: int, blocks: int) -> Column:
    """An array of (list, key): the bits of every choice of `blocks - distance` parts."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(parts, blocks - distance)):
        mask = sum(chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).alias("list"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*keys)


def unit_edges(fp: np.ndarray, table: np.ndarray, starts: np.ndarray, distance: int) -> np.ndarray:
    """For each row the first row of its unit that it reaches by links within the unit."""
    n = len(fp)
    unit = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
    left, shift = np.arange(n), 0
    found, held = [], 0
    while len(left):
        shift += 1
        left = left[left + shift < n]
        left = left[unit[left] == unit[left + shift]]
        a, b = left, left + shift
        near = np.abs(table[a, 0] - table[b, 0]) <= distance
        a, b = a[near], b[near]
        near = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= distance
        a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        found.append((a[near], b[near]))
        held += int(near.sum())
        if held > 1 << 20:
            label = _labels(n, found)
            found, held = [(label, np.arange(n))], 0
    return _labels(n, found)


def _labels(n: int, found: list) -> np.ndarray:
    return forest(n, np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else np.arange(n)


def class_links(classes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """Edges (a, b) between the `rep`s of classes (fp, rep, p0, p1) that join the same classes as all links do."""
    rows = classes.filter("rep IS NOT NULL").select(
        F.explode(meeting_keys(distance, blocks)).alias("_k"), "fp", "rep", "p0", "p1")
    rows = rows.select("_k.list", "_k.key", "fp", "rep", "p0", "p1")
    unit = ["list", "key", "_i", "_j"]
    dealt = block_pairs(rows, ["list", "key"], "fp", UNIT_ROWS).drop("_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_units(batches, unit):
            fp = rows.column("fp").to_numpy().view(np.uint64)
            table = np.stack([rows.column(c).to_numpy() for c in ("p0", "p1")], axis=1)
            table = np.ascontiguousarray(table).view(np.int8).reshape(len(fp), PIVOTS)
            label = unit_edges(fp, table, starts, distance)
            other = np.flatnonzero(label != np.arange(len(fp)))
            rep = rows.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rep[other]), pa.array(rep[label[other]])], ["a", "b"])

    return dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "a BIGINT, b BIGINT")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    distance: int = 3, blocks: int = 5) -> DataFrame:
    """Per row: id, fp, and component_id, the smallest id that is reached over links."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("n")).select(
        "fp", "rep", "n", *pivot_columns()))
    reached = components(class_links(classes, distance, blocks))
    named = cut_lineage(classes.join(reached, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"), "n"))
    spread = F.xxhash64(F.lit("spread"), id_col)
    return attach(prints, named, "fp", "n", spread).select(id_col, "fp", "component_id")


# Words of 64 bits in the filter of dropped rows: at most so many rows are broadcast.
FILTER_WORDS = 1 << 20


def placed_rows(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """`docs` with the file and the position of every row; a table that is no file scan is written first."""
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at["row_index"])
    except AnalysisException:
        docs = cut_lineage(docs)
        at = docs.metadataColumn("_metadata")
    return docs, at["file_path"], at["row_index"]


def dropped_rows(docs: DataFrame, file: Column, position: Column, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                 distance: int = 3, blocks: int = 5) -> DataFrame:
    """(file, position) of the rows that do not stay when one row of each component does: that with the smallest id, rows
    without an id last, and of several such rows any one."""
    at = F.struct(file.alias("file"), position.alias("position"), F.col(id_col).alias("id"))
    prints = fingerprints(docs.select(at.alias("_at"), F.col(text_col).alias("_text")), "_at", "_text", words)
    prints = cut_lineage(prints.select("_at.file", "_at.position", "_at.id", "fp", F.monotonically_increasing_id().alias("row")))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("first")
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("row").alias("rep"), F.count("*").alias("n"), first).select(
        "fp", "rep", "n", "first", *pivot_columns()))
    reached = components(class_links(classes, distance, blocks))
    named = cut_lineage(classes.join(reached, F.col("rep") == F.col("node"), "left").select(
        "fp", "n", "first", F.coalesce("component", "rep").alias("component")))
    kept = named.groupBy("component").agg(F.min("first")["row"].alias("kept"), F.sum("n").alias("_all")).filter("_all > 1")
    shared = cut_lineage(named.join(kept, "component").select("fp", "n", "kept"))
    spread = F.xxhash64(F.lit("spread"), "row")
    return attach(prints.select("file", "position", "row", "fp"), shared, "fp", "n", spread).filter("row <> kept").select("file", "position")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3,
                       blocks: int = 5, filter_words: int = FILTER_WORDS) -> DataFrame:
    """The rows of `docs`, one of each component of near-duplicates: that with the smallest id.

    Decisions are made for rows, by file and position, so repeated ids and missing ones lose no text of their own, and of equal
    rows one stays. Texts are not shuffled: rows whose bit in a filter of the dropped rows is not set stay at once, and only
    the others are held against the dropped rows themselves. The filter is broadcast; it has `filter_words` rows at most.
    """
    docs, file, position = placed_rows(docs)
    dropped = cut_lineage(dropped_rows(docs, file, position, id_col, text_col, words, distance, blocks))
    columns = docs.columns
    word, bit = (lambda f, p: F.pmod(F.xxhash64(f, p), F.lit(filter_words))), (lambda f, p: F.pmod(F.xxhash64(p, f), F.lit(64)).cast("int"))
    one = F.expr("shiftleft(1L, _bit)")
    bits = dropped.select(word("file", "position").alias("_word"), bit("file", "position").alias("_bit")).groupBy("_word").agg(
        F.bit_or(one).alias("_bits"))
    packed = docs.select(F.struct(*columns).alias("_row"), file.alias("_file"), position.alias("_position"))
    marked = packed.withColumns({"_word": word("_file", "_position"), "_bit": bit("_file", "_position")}).join(
        F.broadcast(bits), "_word", "left")
    listed = F.coalesce(F.col("_bits").bitwiseAND(one) != 0, F.lit(False))
    checked = marked.filter(listed).join(dropped, (F.col("_file") == F.col("file")) & (F.col("_position") == F.col("position")), "left_anti")
    return marked.filter(~listed).select("_row.*").union(checked.select("_row.*"))
