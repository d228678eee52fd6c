"""Token groups by pointer jumping against byte offsets, and corpus counts against plain ones."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from sievework.llm import alignment, queries

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id BIGINT, text STRING, n_a STRING, a STRING"


@pytest.fixture(scope="module")
def plain():
    own = Tokenizer.from_file(A_FILE)
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    back = {chr(b): b for b in printable}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}

    def groups(text):
        """[(ids of A, ids of B)] by common end offsets, with the libraries' own encoders."""
        if not text:
            return []
        a = own.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        bytes_a = [bytes(back[c] for c in own.id_to_token(i)) for i in a]
        bytes_b = []
        for i in b:
            piece = model.id_to_piece(i)
            is_byte = len(piece) == 6 and piece.startswith("<0x")
            bytes_b.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode())
        want = (" " + text).encode()
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        place_a, place_b = ({e: k + 1 for k, e in enumerate(x.tolist())} for x in (ends_a, ends_b))
        both = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        cut_a, cut_b = [0, *(place_a[e] for e in both)], [0, *(place_b[e] for e in both)]
        return [(a[cut_a[k]:cut_a[k + 1]], b[cut_b[k]:cut_b[k + 1]]) for k in range(len(both))]
    return groups


def digest(texts, plain):
    """The contract's columns of every text, by plain loops."""
    found = [plain(t) for t in texts]
    held = Counter()
    for groups in found:
        held.update({(a, b) for x, y in groups for a in x for b in y})
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for groups in found:
        links = [(a, b) for x, y in groups for a in x for b in y]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(written.encode()).hexdigest() if written else ""))
    return out


def odd_texts(seed=5, n=60):
    rng = random.Random(seed)
    words = ["the", "unbelievable", "<|endoftext|>", "<s>", "</s>", "don't", "naïve", "東京都", "🙂🙂", "x" * 40, "   ", "\n\n\t", "12345",
             "=====", "a_b", "ÄÖ", " ", "　", "е́", "\x00", "\r\n", "'s"]
    return ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("hot_pairs", [1, 40, 1 << 19])
def test_matches_plain_version(spark, plain, hot_pairs):
    texts = [None, "", " ", "a", "one ▁ two", *odd_texts(), "again and again", "again and again"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "again and again", None, None), (3, "b", None, None)]
    got = alignment.cross_align(spark.createDataFrame(rows, DOCS).repartition(5), A_FILE, B_FILE, hot_pairs=hot_pairs).collect()
    want = [(r[0], *d) for r, d in zip(rows, digest([r[1] for r in rows], plain), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_whole_table(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: d for r, d in zip(docs, digest([r.text for r in docs], plain), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op11_pointer_jumping(spark, sf_dir).collect()} == want


def test_empty_table(spark):
    found = alignment.cross_align(spark.createDataFrame([], DOCS), A_FILE, B_FILE)
    assert found.count() == 0 and found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_long_texts_in_parts(monkeypatch):
    tools = alignment.Tokenizers(A_FILE, B_FILE)
    texts = [*odd_texts(seed=8), "word " * 400, " " * 500 + "end  ", "no" * 600, "a  b   " * 90]
    whole = [tools.model.encode(t) for t in texts]
    monkeypatch.setattr(alignment, "parts", lambda t, f=alignment.parts: f(t, 7))
    monkeypatch.setattr(alignment, "PART_CHARS", 7)
    assert [tools.encode_b(t) for t in texts] == whole


def test_very_long_whitespace():
    tools = alignment.Tokenizers(A_FILE, B_FILE)
    text = "start" + " " * 1_500_000 + "end\n" + "\n" * 500_000
    found = alignment.align(tools, [text, "b"])
    assert found["n_links"][0] == sum(found["n"][0]) and found["n_groups"][1] == 1


@pytest.mark.parametrize("slice_links", [1, 5, 1 << 21])
def test_pair_counts(slice_links):
    rng = np.random.default_rng(2)
    groups = 30
    size_a, size_b = rng.integers(1, 6, groups), rng.integers(1, 6, groups)
    group_a, group_b = np.repeat(np.arange(groups), size_a), np.repeat(np.arange(groups), size_b)
    a, b, doc = rng.integers(0, 4, len(group_a)), rng.integers(0, 4, len(group_b)), np.sort(rng.integers(0, 5, groups))
    want = Counter((int(doc[g]) << 40) + int(x) * 10 + int(y) for g in range(groups) for x in a[group_a == g] for y in b[group_b == g])
    key, count = alignment.pair_counts(a, b, group_a, group_b, doc, 10, slice_links)
    assert dict(zip(key.tolist(), count.tolist(), strict=True)) == want and np.all(np.diff(key) > 0)


def test_pointers_reach_far():
    """Tokens that never end together but at the end are one group."""
    end_a, end_b = np.append(np.arange(2, 4000, 2), 4001), np.append(np.arange(1, 4000, 2), 4001)
    group_a, group_b, n = alignment.groups_of(end_a, end_b)
    assert n == 1 and not group_a.any() and not group_b.any()
