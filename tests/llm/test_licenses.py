"""License scans: alignment by definition, matches by trying every window, odd rows."""

import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import licenses

TEMPLATES = [licenses.Template(*n) for n in licenses.NOTICES]
WORDS = st.lists(st.sampled_from("abcdefgh"), max_size=9)


def plain_align(a, b):
    """Patience alignment by its definition, the best anchor subsequence by trying all."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in plain_align(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return plain_align(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    unique = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == b.count(w) == 1]
    best = max((s for n in range(len(unique) + 1) for s in itertools.combinations(unique, n)
                if all(x[1] < y[1] for x, y in itertools.pairwise(s))), key=len)
    return list(best)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_alignment(a, b):
    got = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))
    anchors = plain_align(a, b)
    assert len(got) >= len(anchors)
    if a and b and a[0] != b[0] and a[-1] != b[-1] and not anchors:
        assert got == []


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(8)))
def test_longest_increasing_subsequence(order):
    pairs = list(enumerate(order))
    got = licenses.increasing(pairs)
    best = max(n for n in range(1, 9) for s in itertools.combinations(pairs, n) if all(x[1] < y[1] for x, y in itertools.pairwise(s)))
    assert len(got) == best and set(got) <= set(pairs) and all(x[1] < y[1] for x, y in itertools.pairwise(got))


def plain_matches(words, template):
    """Every window in turn, without counts or skips."""
    out, at = [], 0
    while at < len(words):
        if words[at] in template.count:
            found = licenses.align(words[at:at + template.window], template.words)
            if len(found) >= template.need and template.must <= {template.words[j] for _, j in found}:
                out.append((at + found[0][0], at + found[-1][0] + 1, len(found)))
                at = out[-1][1]
                continue
        at += 1
    return out


def test_matches_as_by_trying_all_windows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    texts = [r.text for r in rows] + [n[2] * 2 + " between " + m[2] for n, m in itertools.pairwise(licenses.NOTICES)]
    for text in texts:
        words = licenses.words_of(text)
        present = set(words)
        for template in TEMPLATES:
            want = plain_matches(words, template) if present & template.must else []
            got = list(template.matches(words)) if template.possible(present) else []
            assert got == want


def test_stated_notices_are_found(spark, sf_dir):
    form = {"GPL-3.0": r"GNU General Public License, version 3", "CC-BY-NC-4.0": "CC BY-NC", "MIT": "MIT License",
            "Apache-2.0": "Apache License, Version"}
    rows = licenses.scan_table(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows:
        for name, pattern in form.items():
            assert sum(m.license == name for m in r.matches) == len(re.findall(pattern, texts[r.doc_id]))


def test_odd_rows(spark):
    mit = "released UNDER the\nMIT license"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, f"İ {mit}!", 0), (4, f"{mit} {mit}", 0), (4, f"{mit} {mit}", 0),
                                  (5, "x " * 50_000 + mit, 0), (6, "released under the license", 0)], "doc_id BIGINT, text STRING, matches INT")
    rows = licenses.scan_table(docs).collect()
    found = sorted(((str(r.doc_id), [(m.license, m.start, m.end, m.coverage) for m in r.matches]) for r in rows))
    n = len(mit)
    twice = [("MIT", 0, n, 1.0), ("MIT", n + 1, 2 * n + 1, 1.0)]
    assert found == [("1", []), ("2", []), ("4", twice), ("4", twice), ("5", [("MIT", 100_000, 100_000 + n, 1.0)]), ("6", []),
                     ("None", [("MIT", 2, 2 + n, 1.0)])]
    assert licenses.scan_table(docs.limit(0)).count() == 0


def test_the_most_specific_license_wins():
    def names(text):
        return [m[0] for m in licenses.scan(text, TEMPLATES)]
    for name, _, text in licenses.NOTICES:
        assert names(f"before {text} after") == [name], text
    assert names("Licensed under CC BY-NC-SA 4.0") == ["CC-BY-NC-SA-4.0"]
    assert names("Released under the MIT License. Licensed under the Apache License, Version 2.0.") == ["Apache-2.0", "MIT"]
