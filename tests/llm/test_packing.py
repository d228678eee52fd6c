"""Shortest-pack-first: whole pieces, gapless sequences, ids as the tokenizer gives them."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievework.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 300), max_size=30))
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.shortest_pack_first(dict(histogram), 64)
    held = defaultdict(int)
    for count, pattern in patterns:
        assert sum(n * c for n, c in pattern) <= 64 and count > 0
        for length, copies in pattern:
            held[length] += count * copies
    assert held == {k: v for k, v in histogram.items() if v}


def test_cuts():
    assert packing.cuts(1, 8) == [1] and packing.cuts(16, 8) == [8, 8] and packing.cuts(19, 8) == [8, 8, 3]


def check_layout(rows, seq_len):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_sequence) == set(range(len(by_sequence)))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= seq_len


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, FILE, seq_len=256).collect()
    check_layout(rows, 256)
    own = Tokenizer.from_file(FILE)
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a <|endoftext|> b", 3), (3, "a <|endoftext|> b", 3),
                                  (None, "x", 0)], "doc_id BIGINT, text STRING, length INT")
    rows = packing.pack_documents(docs, FILE, seq_len=16, keep_ids=True).collect()
    check_layout(rows, 16)
    own = Tokenizer.from_file(FILE)
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted(
        (str(d), [*own.encode(t, add_special_tokens=False).ids, 1])
        for d, t in [(1, ""), (2, ""), (3, "a <|endoftext|> b"), (3, "a <|endoftext|> b"), (None, "x")])
    assert packing.pack_documents(docs.limit(0), FILE).count() == 0


@pytest.mark.parametrize("run", [" " * 3_000_000, "\n" * 3_000_000, "\u3000" * 1_200_000, " \n" * 1_000_000])
def test_long_runs_of_whitespace(run):
    encode, own = packing.fast_encoder(FILE), Tokenizer.from_file(FILE)
    text = f"It's a run:{run}x{run[:300_000]}é 12 !?{run[:5]}"
    assert encode(text) == own.encode(text, add_special_tokens=False).ids
