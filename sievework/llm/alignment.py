"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

A is a byte-level BPE read from a `tokenizers` file and applied to a space and the text; B is a sentencepiece model, which
puts that space itself. Both cut the same bytes. Every token points to its farthest-right overlapping token: a token of A
to the token of B that holds its last byte, a token of B to that of A, or to itself where both end. Successors are
doubled, all tokens of many documents at once, until every token points to the last one of its component. Components
are the groups between offsets where both tokenizers end a token; all pairs of a group's A and B tokens are its links.

How many documents hold a pair of ids linked is counted over all documents. Pairs held by more than one in `hot_pairs` of
all (document, pair) rows are fewer than `hot_pairs` and travel to every task; the others meet their counts in a join.

Null and empty texts, and texts whose tokens do not join to their bytes (those with U+2581, which B reads as a space),
have no tokens: zeros and an empty digest. Strings of special tokens are plain text. Very long texts are encoded in parts
cut between a word and the space after it, which no piece of B crosses, and their groups are expanded in slices.
Repeated rows count as documents of their own, rows without an id too. Ties for the highest count are all best. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import bounded_batches, once_per_worker, text_groups, whole_encoder
from sievework.llm.packing import _shown_bytes
from sievework.session import cut_lineage

GROUP_CHARS = 1_000_000
PART_CHARS = 1 << 18
SLICE_LINKS = 1 << 21
HOT_PAIRS = 1 << 19
SPACE = "▁"


class Tokenizers:
    """Both encoders, and the bytes of every id."""

    def __init__(self, a_file: str, b_file: str):
        import json

        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(a_file, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"] for t in spec["added_tokens"]}
        shown = _shown_bytes()
        ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        quick = tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode_a = whole_encoder(quick, public_tokenizers.PATTERN)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece of B crosses from a word into the space after it")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE, " ").encode()
                        for p in pieces]
        self.size_a = np.array([len(t) for t in self.bytes_a])
        self.size_b = np.array([len(t) for t in self.bytes_b])
        # the decimal ids with what may follow them in a digest
        self.shown_a = np.array([f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))], object)
        self.shown_b = np.array([f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))], object)

    def encode_b(self, text: str) -> list[int]:
        if len(text) <= PART_CHARS:
            return self.model.encode(text, num_threads=1)
        return [i for part in parts(text) for i in self.model.encode(part, num_threads=1)]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of both, or two empty lists where their bytes are not those of the text."""
        if not text or SPACE in text:
            return [], []
        want = b" " + text.encode("utf-8")
        a, b = self.encode_a(" " + text), self.encode_b(text)
        same = b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want
        return (a, b) if same else ([], [])


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Parts of a text whose encodings follow each other: each is cut at a space after something else, and loses that
    space, which the model puts back."""
    start, cut = 0, re.compile(r"(?<=[^ ]) ")
    while start < len(text):
        found = cut.search(text, start + size)
        # an empty last part would not get its space back
        if not found or found.end() == len(text):
            break
        yield text[start:found.start()]
        start = found.end()
    yield text[start:]


def groups_of(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of A and of B, and their number. Both lists of ascending ends close at the same byte."""
    n = len(end_a)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    holds_a = np.searchsorted(end_a, end_b)  # the token of A with the last byte of each token of B
    own = np.arange(n, n + len(end_b))
    successor = np.concatenate([n + np.searchsorted(end_b, end_a), np.where(end_a[holds_a] == end_b, own, holds_a)])
    while True:
        doubled = successor[successor]
        if np.array_equal(doubled, successor):
            break
        successor = doubled
    number = np.cumsum(successor[n:] == own) - 1  # terminal tokens, numbered from the left
    label = number[successor - n]
    return label[:n], label[n:], int(number[-1]) + 1


def pair_counts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc: np.ndarray,
                width: int, slice_links: int = SLICE_LINKS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (document, id of A, id of B), ascending, and the links of each.

    `doc` is the document of each group, and a key is doc * 2**40 + a * width + b. Groups are expanded in slices of at most
    2 * `slice_links` links; a group with more than one slice is counted by its distinct ids.
    """
    size_a, size_b = np.bincount(group_a, minlength=len(doc)), np.bincount(group_b, minlength=len(doc))
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    links = size_a * size_b
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in np.flatnonzero(links > slice_links):
        ids_a, n_a = np.unique(a[first_a[g]:first_a[g] + size_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[first_b[g]:first_b[g] + size_b[g]], return_counts=True)
        keys.append((doc[g] << 40) + np.add.outer(ids_a * width, ids_b).ravel())
        counts.append(np.multiply.outer(n_a, n_b).ravel())
    small = np.flatnonzero(links <= slice_links)
    slices = (np.cumsum(links[small]) - 1) // slice_links
    for part in np.split(small, np.flatnonzero(np.diff(slices)) + 1):
        group = np.repeat(part, links[part])
        inside = np.arange(len(group)) - np.repeat(np.cumsum(links[part]) - links[part], links[part])
        left, right = a[first_a[group] + inside // size_b[group]], b[first_b[group] + inside % size_b[group]]
        key, count = np.unique((doc[group] << 40) + left * width + right, return_counts=True)
        keys.append(key)
        counts.append(count)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return key, total


def align(tools: Tokenizers, texts: Sequence[str]) -> dict[str, list]:
    """Columns with a value per text: n_a, n_b, n_groups, n_links, groups (as written), and the linked pairs of ids a and
    b with their links n."""
    ids = [tools.encode(t) for t in texts]
    n_a, n_b = np.array([len(a) for a, _ in ids]), np.array([len(b) for _, b in ids])
    a = np.array([i for x, _ in ids for i in x], np.int64)
    b = np.array([i for _, x in ids for i in x], np.int64)
    group_a, group_b, groups = groups_of(np.cumsum(tools.size_a[a]), np.cumsum(tools.size_b[b]))
    doc = np.zeros(groups, np.int64)
    doc[group_a] = np.repeat(np.arange(len(texts)), n_a)
    width = len(tools.bytes_b)
    key, links = pair_counts(a, b, group_a, group_b, doc, width)
    edges = np.searchsorted(key >> 40, np.arange(len(texts) + 1))
    pair = key & ((1 << 40) - 1)
    total = np.concatenate([[0], np.cumsum(links)])

    # every token is written with what follows it: A's tokens of a group, a bar, B's tokens, a semicolon
    last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    shown = np.empty(len(a) + len(b), object)
    shown[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = tools.shown_a[a + last_a * len(tools.bytes_a)]
    shown[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = tools.shown_b[b + last_b * len(tools.bytes_b)]
    ends = np.cumsum(n_a + n_b)
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc, minlength=len(texts)), "n_links": np.diff(total[edges]),
            "groups": ["".join(shown[e - n:e])[:-1] for e, n in zip(ends, n_a + n_b, strict=True)],
            "a": np.split(pair // width, edges[1:-1]), "b": np.split(pair % width, edges[1:-1]), "n": np.split(links, edges[1:-1])}


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()).cast(kind))


def aligned_documents(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text",
                      keep_groups: bool = False) -> DataFrame:
    """A row per document: id, n_a, n_b, n_groups, n_links, groups_sha256, arrays a, b, n of its linked pairs of ids, and
    the written groups themselves with `keep_groups`."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = once_per_worker(f"alignment {a_file} {b_file}", lambda: Tokenizers(a_file, b_file))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in text_groups(texts, GROUP_CHARS):
                found = align(tools, texts[start:end])
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found["groups"]]
                arrays = [batch.column(0).slice(start, end - start), *[pa.array(found[c], pa.int64()) for c in numbers],
                          pa.array(digests, pa.string()), _lists(found["a"], pa.int32()), _lists(found["b"], pa.int32()),
                          _lists(found["n"], pa.int64())]
                names = [id_col, *numbers, "groups_sha256", "a", "b", "n"]
                if keep_groups:
                    arrays.append(pa.array(found["groups"], pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} BIGINT" for c in numbers) +         ", groups_sha256 STRING, a ARRAY<INT>, b ARRAY<INT>, n ARRAY<BIGINT>" + ", groups STRING" * keep_groups
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(run, schema)


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def pair_table(aligned: DataFrame) -> DataFrame:
    """(a, b, docs, best): how many documents hold a pair linked, and whether no other pair of that a is held by more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, docs = np.unique(_key(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 32, pa.int32()), pa.array(key & 0xFFFFFFFF, pa.int32()), pa.array(docs, pa.int64())],
                                             ["a", "b", "docs"])

    counts = aligned.select("a", "b").mapInArrow(count, "a INT, b INT, docs BIGINT").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    # an id of A has as many rows here as B has ids, at most
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def cross_align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text",
                hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair is held by as many documents as any of its A id; count_sum sums those numbers of
    documents over the links.
    """
    aligned = cut_lineage(aligned_documents(docs, a_file, b_file, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    pairs = cut_lineage(pair_table(aligned))
    limit = (pairs.agg(F.sum("docs")).first()[0] or 0) / hot_pairs
    hot = pairs.filter(F.col("docs") > limit).toArrow()  # fewer than hot_pairs rows
    key = _key(hot.column("a").to_numpy(), hot.column("b").to_numpy())
    order = np.argsort(key)
    key = key[order]
    held, best = hot.column("docs").to_numpy()[order], hot.column("best").to_numpy()[order]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (batch.column(c).flatten().to_numpy() for c in ("a", "b", "n"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("a").offsets.to_numpy()))
            own = _key(a, b)
            place = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
            known = key[place] == own if len(key) else np.zeros(len(own), bool)
            at, links = place[known], n[known]
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row[known], links * best[at])
            np.add.at(sums[1], row[known], links * held[at])
            edges = np.searchsorted(row[~known], np.arange(1, batch.num_rows))
            rest = [_lists(np.split(c[~known], edges), k) for c, k in ((a, pa.int32()), (b, pa.int32()), (n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *map(pa.array, sums), *rest], ["_row", "n_best", "count_sum", "a", "b", "n"])

    weighed = cut_lineage(aligned.select("_row", "a", "b", "n").mapInArrow(
        weigh, "_row BIGINT, n_best BIGINT, count_sum BIGINT, a ARRAY<INT>, b ARRAY<INT>, n ARRAY<BIGINT>"))
    rare = weighed.select("_row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("_row", "p.a", "p.b", "p.n")
    rare = rare.join(pairs.filter(F.col("docs") <= limit), ["a", "b"]).select(
        "_row", F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("docs")).alias("count_sum"))
    sums = weighed.select("_row", "n_best", "count_sum").union(rare).groupBy("_row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("a", "b", "n").join(sums, "_row").select(
        id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
