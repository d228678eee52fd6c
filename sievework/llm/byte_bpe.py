"""Byte-level BPE encoding and decoding by rank files.

Every match of the split pattern is encoded alone. A segment tree over its byte positions keeps, for each
position that starts a live token, the rank of the pair with its right neighbour; the root holds the leftmost
pair of least rank. A merge changes three leaves (the merged pair, its left neighbour, the position that dies), so
it costs O(log n). Short pieces are merged many at a time, one tree per row of a matrix; a piece of any length
has its own tree.

Null texts count as empty: no ids, and empty bytes. Extra columns are kept out of the way: only the id and
text columns are read. An empty table gives an empty result; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import bounded_batches, once_per_worker, text_groups

NONE = np.int64(1) << 62
# Pieces up to this many bytes are merged in matrices.
MATRIX_BYTES = 64
CACHED_PIECES = 300_000
GROUP_CHARS = 2_000_000


def narrow_pattern(pattern: str) -> str:
    """The pattern with its Unicode classes written out for code points below 256, for the faster `re`."""
    import regex
    members = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        members[name] = "".join(f"\\x{c:02x}" for c in range(256) if regex.fullmatch(name, chr(c)))
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((m for m in members if pattern.startswith(m, i)), None)
        if name:
            out.append(members[name] if inside else f"[{members[name]}]")
            i += len(name)
            continue
        if pattern.startswith(r"\S", i) and not inside:
            out.append(f"[^{members[chr(92) + 's']}]")
            i += 2
            continue
        inside = pattern[i] == "[" or (inside and pattern[i] != "]")
        out.append(pattern[i])
        i += 1
    return "".join(out)


class ByteBpe:
    def __init__(self, rank_file: str, pattern: str):
        import re

        import regex
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.split_any = regex.compile(pattern).findall
        self.split_narrow = re.compile(narrow_pattern(pattern)).findall
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.pairs = pairs
        self.known: dict[str, str] = {}

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_texts([text])[0].split(",") if i]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_narrow(text)

    def encode_texts(self, texts: list[str]) -> list[str]:
        """The ids of each text as decimals joined by commas."""
        pieces = [self.split(t) for t in texts]
        known = self.known
        missing = set().union(*pieces) - known.keys()
        fresh = self._encode_pieces(missing) if missing else {}
        known.update(fresh)
        joined = [",".join(map(known.__getitem__, words)) for words in pieces]
        if len(known) > CACHED_PIECES:
            for old in list(islice(known, len(known) - CACHED_PIECES // 2)):
                del known[old]
        return joined

    def _encode_pieces(self, pieces: set[str]) -> dict[str, str]:
        out, by_size = {}, {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            rank = self.ranks.get(raw)
            if rank is not None:
                out[piece] = str(rank)
            elif len(raw) > MATRIX_BYTES:
                out[piece] = ",".join(map(str, self._merge_one(raw)))
            else:
                by_size.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for size, rows in by_size.items():
            for i in range(0, len(rows), 8192):
                part = rows[i:i + 8192]
                for (piece, _), ids in zip(part, self._merge_many([r for _, r in part], size), strict=True):
                    out[piece] = ids
        return out

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of token pairs, NONE where the two do not merge; b < 0 means no right neighbour."""
        keys = a << 32 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((b >= 0) & (self.pair_keys[at] == keys), self.pair_rank[at], NONE)

    def _merge_many(self, raws: list[bytes], size: int) -> list[str]:
        n, bits = len(raws), size.bit_length()
        lengths = np.array([len(r) for r in raws])
        flat = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in raws), np.uint8).reshape(n, size)
        place = np.arange(size)
        live = place < lengths[:, None]
        token = np.where(live, self.byte_id[flat], -1)
        right = np.where(place + 1 < lengths[:, None], place + 1, size)
        left = np.tile(place - 1, (n, 1))
        after = np.full((n, size), -1, dtype=np.int64)
        after[:, :-1] = token[:, 1:]
        rank = self._rank_of(np.maximum(token, 0), np.where(live, after, -1))
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        tree[:, size:] = np.where(rank < NONE, rank << bits | place, NONE)
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            at = tree[rows, 1] & ((1 << bits) - 1)
            dead = right[rows, at]
            token[rows, at] = tree[rows, 1] >> bits
            token[rows, dead] = -1
            follow = right[rows, dead]
            right[rows, at] = follow
            has = follow < size
            left[rows[has], follow[has]] = at[has]
            self._set(tree, rows, dead, np.full(len(rows), NONE), size, bits)
            self._set(tree, rows, at, self._rank_of(
                token[rows, at], np.where(has, token[rows, np.minimum(follow, size - 1)], -1)), size, bits)
            before = left[rows, at]
            has = before >= 0
            r, p = rows[has], before[has]
            self._set(tree, r, p, self._rank_of(token[r, p], token[r, at[has]]), size, bits)
            rows = rows[tree[rows, 1] < NONE]
        words = token.tolist()
        return [",".join([str(i) for i in w if i >= 0]) for w in words]

    @staticmethod
    def _set(tree, rows, place, rank, size, bits) -> None:
        """Point update of one leaf in each of the given trees, up to the root."""
        node = place + size
        tree[rows, node] = np.where(rank < NONE, rank << bits | place, NONE)
        while size > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            size >>= 1

    def _merge_one(self, raw: bytes) -> list[int]:
        n = len(raw)
        size = 1 << (n - 1).bit_length()
        none, pairs = (1 << 62, 0), self.pairs
        token = self.byte_id[np.frombuffer(raw, np.uint8)].tolist()
        right, left = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = pairs.get(token[i] << 32 | token[i + 1])
            if rank is not None:
                tree[size + i] = (rank, i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(place: int) -> None:
            rank = None
            if token[place] >= 0 and right[place] >= 0:
                rank = pairs.get(token[place] << 32 | token[right[place]])
            node = size + place
            tree[node] = none if rank is None else (rank, place)
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            rank, at = tree[1]
            dead = right[at]
            token[at], token[dead] = rank, -1
            right[at] = right[dead]
            if right[at] >= 0:
                left[right[at]] = at
            put(dead)
            put(at)
            if left[at] >= 0:
                put(left[at])
        return [t for t in token if t >= 0]


def encode_table(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 keep_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded
    bytes, and with `keep_ids` the ids. `rank_file` must be readable on every executor."""
    bounded_batches(docs.sparkSession)
    key = f"bpe {rank_file} {pattern}"
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once_per_worker(key, lambda: ByteBpe(rank_file, pattern))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            count, ids_hash, bytes_hash, kept = [], [], [], []
            for start, end in text_groups(texts, GROUP_CHARS):
                for joined in bpe.encode_texts(texts[start:end]):
                    ids = list(map(int, joined.split(","))) if joined else []
                    count.append(len(ids))
                    ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                    bytes_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()),
                       pa.array(bytes_hash, pa.string())] + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING" + (", ids ARRAY<INT>" * keep_ids)
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(run, schema)
