"""Personal data: rules against plain regular expressions, decoding against enumeration, added spans, odd rows."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import pii, queries

FORMS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
         r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def plain_base(text):
    spans = []
    for kind, form in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == 2 and 14 <= len(digits) <= 19 and plain_luhn(digits) or kind == 3 and 10 <= len(digits) <= 15):
                spans.append((kind, *m.span()))
    return sorted(spans, key=lambda s: (s[1], s[0]))


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("a1234567890.@-+ ()é_,"), max_size=60) | st.lists(st.sampled_from(
    ["1.2.3.4", "255.256.1.2", "007.0.0.1", "4111 1111-1111 1111", "+1 (415) 555-2671", "a.b@c-d.e", "@x.y", "x@y", " ", ",", "0", "."]), max_size=12).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_base(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " 2" * 100_000, "a@" * 100_000, "@a.b" * 50_000])
def test_base_spans_of_long_runs(text):
    pii.base_spans(text)


@pytest.fixture(scope="module")
def tagger():
    """Random weights: every tag occurs."""
    tagger = pii.Tagger(seed=3)
    rng = np.random.default_rng(4)
    tagger.p["step"] = rng.normal(0, 0.5, tagger.p["step"].shape)
    tagger.p["bias"][0] = 0.3
    for side in "fb":
        tagger.p["o" + side] *= 3
    return tagger


def plain_tags(tagger, codes):
    """The best path of one sequence by trying all allowed ones, on the emissions of the training pass."""
    x = np.array(codes)[:, None]
    emit = (np.matmul(tagger.p["of"], tagger._pass("f", x)["out"][1:]) + np.matmul(tagger.p["ob"], tagger._pass("b", x[::-1])["out"][1:])[::-1]
            + tagger.p["bias"])[:, :, 0]
    best, top = None, -np.inf
    for path in itertools.product(range(pii.TAGS), repeat=len(codes)):
        if all(tagger.allowed[a, b] for a, b in itertools.pairwise(path)):
            value = sum(emit[t, s] for t, s in enumerate(path)) + sum(tagger.p["step"][a, b] for a, b in itertools.pairwise(path))
            best, top = (path, value) if value > top else (best, top)
    return list(best)


def test_decoding_matches_enumeration(tagger, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    rng = np.random.default_rng(6)
    lengths = np.array([7, 7, 6, 4, 2, 1])
    x = np.full((7, 6), pii.CLASSES)
    for w, n in enumerate(lengths):
        x[:n, w] = rng.integers(0, pii.CLASSES, n)
    some, tags = tagger.decode(x, lengths)
    got = {w: row[:lengths[w]].tolist() for w, row in zip(some.tolist(), tags, strict=True)}
    for w, n in enumerate(lengths):
        assert got.get(w, [0] * n) == plain_tags(tagger, x[:n, w].tolist())


def test_gradients(tagger):
    """Numerical derivatives of the training loss, where no gate is near a corner."""
    rng = np.random.default_rng(8)
    x, tags = rng.integers(0, pii.CLASSES, (5, 3)), np.array([[0, 1, 1, 0, 2], [0, 0, 0, 3, 3], [4, 4, 0, 0, 0]]).T

    def loss():
        emit = (np.matmul(tagger.p["of"], tagger._pass("f", x)["out"][1:]) + np.matmul(tagger.p["ob"], tagger._pass("b", x[::-1])["out"][1:])[::-1]
                + tagger.p["bias"])
        total = 0.0
        for r in range(x.shape[1]):
            score = {p: sum(emit[t, s, r] for t, s in enumerate(p)) + sum(tagger.p["step"][a, b] for a, b in itertools.pairwise(p))
                     for p in itertools.product(range(pii.TAGS), repeat=5) if all(tagger.allowed[a, b] for a, b in itertools.pairwise(p))}
            total += np.log(sum(np.exp(v) for v in score.values())) - score[tuple(tags[:, r])]
        return total / x.size

    saved = {"f": tagger._pass("f", x), "b": tagger._pass("b", x[::-1])}
    emit = (np.matmul(tagger.p["of"], saved["f"]["out"][1:]) + np.matmul(tagger.p["ob"], saved["b"]["out"][1:])[::-1] + tagger.p["bias"])
    down, d_step = tagger._crf(emit, tags)
    grad = {**tagger._back("f", saved["f"], down), "bias": down.sum(axis=(0, 2))[:, None], "step": d_step}
    for name in ("of", "bias", "step"):
        at = tuple(0 for _ in tagger.p[name].shape)
        held, step = tagger.p[name][at], 1e-5
        tagger.p[name][at] = held + step
        up = loss()
        tagger.p[name][at] = held - step
        low = loss()
        tagger.p[name][at] = held
        assert abs((up - low) / (2 * step) - grad[name][at]) < 1e-6


def test_windows_meet_without_a_seam(tagger, monkeypatch):
    monkeypatch.setattr(pii, "WINDOW", 64)
    monkeypatch.setattr(pii, "OVERLAP", 32)
    texts = ["mail bob@x.org 1.2.3.4 and +1 415 555 2671 " * 9, "", "a", "x" * 64, "y" * 65, "z 12 " * 40]
    together = tagger.spans(texts)
    assert together == [tagger.spans([t])[0] for t in texts]
    for text, spans in zip(texts, together, strict=True):
        assert all(0 <= a < b <= len(text) for _, a, b in spans)
        assert all(x[2] <= y[1] for x, y in itertools.pairwise(spans))


@pytest.fixture(scope="module")
def fitted(spark):
    return pii.fit_tagger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_learned_spans(fitted):
    """The network alone finds nearly all rule spans of texts it has not seen, and further written forms."""
    import pyarrow.parquet as pq
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()[5000:7000]
    decoded = [set(s) for t in range(0, 2000, 500) for s in fitted.spans(texts[t:t + 500])]
    base = [(s in d) for t, d in zip(texts, decoded, strict=True) for s in pii.base_spans(t)]
    assert len(base) > 50 and sum(base) / len(base) >= 0.9
    both = fitted.all_spans(texts)
    assert all(set(b) <= set(a) for b, a in both)
    assert sum(len(a) > len(b) for b, a in both) <= 10
    further = fitted.all_spans(["Please call (415) 555-2671 today.", "Ask ann.lee (at) site.org for it."])
    assert sum(len(a) for _, a in further) >= 1


def test_checked_spans():
    text = "see 1.2.3.4x and (415) 555-2671, 12"
    assert pii.checked(1, text, 4, 11) is None
    at = text.index("(")
    assert pii.checked(3, text, at - 1, at + 15) == (3, at, at + 14)
    assert pii.checked(3, text, len(text) - 2, len(text)) is None
    assert pii.checked(0, "...", 0, 3) is None


def test_query_and_odd_rows(spark, sf_dir, fitted):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_bilstm_crf(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert {pii.joined([s]) for s in base} <= set(r.spans.split(","))
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a@b.c", 0), (4, "🙂 1.2.3.4", 0), (4, "🙂 1.2.3.4", 0),
                                  (5, "w " * 90_000 + "a@b.c", 0)], "doc_id BIGINT, text STRING, base INT")
    found = sorted((str(r.doc_id), [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in pii.find_spans(docs, fitted).collect())
    ip, mail, late = [("ip", 2, 9)], [("email", 0, 5)], [("email", 180_000, 180_005)]
    assert found == [("1", [], []), ("2", [], []), ("4", ip, ip), ("4", ip, ip), ("5", late, late), ("None", mail, mail)]
    masked = {str(r.doc_id): r.text for r in pii.redact(docs, fitted).collect()}
    assert masked["1"] is None and masked["2"] == "" and masked["None"] == "<email>" and masked["4"] == "🙂 <ip>"
    assert pii.find_spans(docs.limit(0), fitted).count() == 0
    assert pii.fit_tagger(docs.limit(0)) is None
    assert pii.redact(docs, None).count() == 6


def test_mask():
    assert pii.mask("abcdefgh", [(1, 1, 4), (2, 3, 6), (0, 7, 8)]) == "a<ip>g<email>"


def test_sample_is_bounded_by_ids(spark):
    """An id that holds most rows gives one text to the sample, the smallest, so its other rows change nothing."""
    rows = [(i, f"Write to mail{i}@site{i}.example.org or call +49 30 {1000000 + i} about item {i}") for i in range(60)]
    one = pii.fit_tagger(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    more = pii.fit_tagger(spark.createDataFrame(rows + [(7, f"{rows[7][1]} and more of it, part {k}") for k in range(300)], "doc_id BIGINT, text STRING"))
    text = "Reach me at ann@site.org please"
    assert one.all_spans([text]) == more.all_spans([text])
