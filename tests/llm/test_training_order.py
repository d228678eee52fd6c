"""Token shards: a permutation, files of fixed stride, resumed reads, odd rows."""

import base64
import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
import tiktoken

from sievework.llm import training_order as order
from sievework.llm.byte_bpe import ByteBpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_a_permutation(size):
    got = order.permute(np.arange(size), size, 5)
    assert sorted(got.tolist()) == list(range(size))
    parts = np.concatenate([order.permute(p, size, 5) for p in np.array_split(np.arange(size), 3)])
    assert parts.tolist() == got.tolist()
    if size > 10:
        assert got.tolist() != order.permute(np.arange(size), size, 6).tolist() and got.tolist() != list(range(size))


def write(docs, folder, seq_len=16, shard_rows=50, key=3):
    return order.write_shards(docs, folder, FILE, public_tokenizers.PATTERN, 50256, seq_len, shard_rows, key)


def library_ids():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: [*encoding.encode_ordinary(text), 50256]


def test_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = str(tmp_path / "s")
    shards = write(docs.repartition(5), folder, 64, 300).collect()
    rows = order.read_shards(spark, folder, 64, 300, ids=True).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert sum(s.rows for s in shards) == len(rows) and {s.rows for s in shards if s.shard < len(shards) - 1} == {300}
    pieces = defaultdict(dict)
    for r in rows:
        assert r.shard == r.slot // 300 and len(r.ids) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id][r.start] = r.ids
    encode = library_ids()
    for d in docs.collect():
        assert [i for s in sorted(pieces[d.doc_id]) for i in pieces[d.doc_id][s]] == encode(d.text)
    resumed = order.read_shards(spark, folder, 64, 300, start_slot=451).collect()
    assert sorted(r.slot for r in resumed) == list(range(451, len(rows)))
    stride = order.HEAD.itemsize + 2 * 64
    sizes = {n: os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.startswith("shard-")}
    assert sizes == {s.file: s.rows * stride for s in shards}
    a = next(r for r in rows if r.slot == 451)
    with open(f"{folder}/shard-{1:010d}.tokens", "rb") as f:
        f.seek(151 * stride + order.HEAD.itemsize)
        assert np.frombuffer(f.read(2 * a.length), "<u2").tolist() == a.ids


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x", 0), (-1, "y", 0), (4, "la " * 40, 0), (4, "la " * 40, 0)],
                                 "doc_id BIGINT, text STRING, slot INT")
    folder = str(tmp_path / "s")
    write(docs, folder)
    rows = order.read_shards(spark, folder, 16, 50, ids=True).collect()
    encode = library_ids()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert sorted(r.ids for r in rows if r.doc_id in (1, 2)) == [encode("")] * 2
    assert [r.ids for r in rows if r.doc_id is None] == [encode("x")] and [r.ids for r in rows if r.doc_id == -1] == [encode("y")]
    assert sorted(r.start for r in rows if r.doc_id is None or r.doc_id < 4) == [0] * 4
    with pytest.raises(TypeError, match="doc_id is string"):
        write(docs.withColumn("doc_id", F.lit("a")), str(tmp_path / "t"))
    parts = encode("la " * 40)
    want = [parts[i:i + 16] for i in range(0, len(parts), 16)]
    assert sorted(r.ids for r in rows if r.doc_id == 4) == sorted(want * 2)


def test_empty_table_and_wide_ids(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    folder = str(tmp_path / "s")
    assert write(docs, folder).count() == 0
    assert order.read_shards(spark, folder, 16, 50).count() == 0
    with pytest.raises(ValueError):
        order.write_shards(docs, folder, FILE, public_tokenizers.PATTERN, 1 << 16, 16, 50, 1)


@pytest.mark.parametrize("run", [" " * 1_100_000, "\n" * 1_100_000])
def test_long_runs_of_whitespace(run):
    """As the merges of op3 give them, which share nothing with the library."""
    text = f"It's a run:{run}x"
    assert order._encoder(FILE, public_tokenizers.PATTERN)(text) == ByteBpe(FILE, public_tokenizers.PATTERN).encode(text)
