"""Byte-level BPE against the tiktoken library, and its table form on odd rows."""

import base64
import hashlib

import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import byte_bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    own = byte_bpe.ByteBpe(FILE, public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return own, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = "aabcdeée ñ\n\t\x1c\x85\xa0　012²½'sl日本語𝒳🙂.,!_ªº"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=200) | st.text(max_size=60))
def test_same_ids_as_the_library(pair, text):
    own, library = pair
    text = text.encode("utf-8", "ignore").decode()
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["ab" * 20000, "a" * 65, "é" * 33, "x" * 64, "\n" * 5000])
def test_long_pieces(pair, text):
    assert pair[0].encode(text) == pair[1].encode_ordinary(text)


def test_cache_may_overflow(pair, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 5)
    texts = [f"word{i} other{i % 3} zz{i}" for i in range(50)]
    assert [[int(i) for i in t.split(",")] for t in pair[0].encode_texts(texts)] == [
        pair[1].encode_ordinary(t) for t in texts]


def test_table(spark, pair):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "Zwölf Boxer", None)],
                                 "doc_id BIGINT, text STRING, n_tokens STRING")
    rows = sorted(byte_bpe.encode_table(docs, FILE, public_tokenizers.PATTERN, keep_ids=True).collect(), key=str)
    nothing = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id] == [
        (1, 0, nothing, nothing), (2, 0, nothing, nothing), (2, 0, nothing, nothing)]
    last = next(r for r in rows if r.doc_id is None)
    assert last.ids == pair[1].encode_ordinary("Zwölf Boxer")
    assert last.decoded_sha256 == hashlib.sha256("Zwölf Boxer".encode()).hexdigest()
    assert byte_bpe.encode_table(docs.limit(0), FILE, public_tokenizers.PATTERN).count() == 0
