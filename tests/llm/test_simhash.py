"""SimHash near-duplicates against brute force, and on odd rows and large groups."""

import re

import numpy as np
import pytest
import xxhash

from sievework.llm import common, queries, simhash


def plain_fingerprint(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(found[i:i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)] * bool(found)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=3):
    """{id: smallest id reached} for {id: fingerprint}."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    values = np.array([prints[i] for i in ids], np.uint64)
    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(values[n + 1:] ^ values[n]) <= distance) + n + 1:
            a, b = find(i), find(ids[m])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    reached = plain_components(prints)
    rows = queries.op2_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{prints[i]:016x}", reached[i]) for i in texts}


def test_segments_of_a_long_text(monkeypatch):
    text = " ".join(f"Wörter{i % 97}\t{i * 7919 % 1013}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SEGMENT", 100)
    assert simhash.fingerprint(text) == whole
    assert whole % (1 << 64) == plain_fingerprint(text)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(5, None, 1), (3, " \n", 2), (9, "one two", 3), (9, "one two", 3), (None, "one two", 4),
                                  (8, "One TWO", 5)], "doc_id BIGINT, text STRING, fp INT")
    rows = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == sorted(
        [(5, 3), (3, 3), (9, 8), (9, 8), (None, 8), (8, 8)], key=str)
    assert {r.fp for r in rows if r.component_id == 3} == {0}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_links_of_chosen_fingerprints(spark, monkeypatch, blocks):
    """Tight balls that overfill their meeting points, chains, and random values."""
    monkeypatch.setattr(simhash, "UNIT_ROWS", 20)
    rng = np.random.default_rng(2)
    values = set(rng.integers(0, 1 << 64, 150, dtype=np.uint64).tolist())
    for centre in rng.integers(0, 1 << 64, 3, dtype=np.uint64).tolist():
        for _ in range(60):
            at = centre
            for bit in rng.integers(0, 64, int(rng.integers(0, 6))).tolist():
                at ^= 1 << bit
            values.add(at)
    prints = dict(enumerate(values))
    signed = [(v - (1 << 64) if v >= 1 << 63 else v, i) for i, v in prints.items()]
    classes = spark.createDataFrame(signed, "fp BIGINT, rep BIGINT").select("fp", "rep", *simhash.pivot_columns())
    edges = simhash.class_links(classes, 3, blocks)
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert {i: got.get(i, i) for i in prints} == plain_components(prints)


LONG_A, LONG_B, LONG_C = (" ".join(f"{w}{i * k % 997}" for i in range(200)) for w, k in (("a", 3), ("b", 7), ("c", 11)))


@pytest.mark.parametrize("filter_words", [1, 4, simhash.FILTER_WORDS])
def test_one_row_of_each_group_stays(spark, tmp_path, filter_words):
    rows = [(1, LONG_A, "x", "p"), (5, LONG_A, "y", "q"), (5, LONG_B, "y", "r"), (7, LONG_C, "z", "s"), (7, LONG_C, "z", "s"),
            (None, LONG_A, "n", "t"), (None, "no other text is like this one", None, None), (None, "nor like this", None, None),
            (2, None, None, None), (3, "", None, None), *[(100 + i, LONG_B, "copy", "u") for i in range(1500)]]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, fp STRING, _row STRING")
    docs.repartition(7).write.parquet(str(tmp_path / "docs"))
    want = sorted([(1, LONG_A, "x", "p"), (5, LONG_B, "y", "r"), (7, LONG_C, "z", "s"), (2, None, None, None), *rows[6:8]], key=str)
    for table in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        got = simhash.distinct_documents(table, filter_words=filter_words)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == want
    assert simhash.distinct_documents(docs.limit(0)).count() == 0


def test_texts_that_stay_are_not_shuffled(spark, tmp_path):
    """Of two scans of the documents only that of the rows listed by the filter feeds an exchange."""
    spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(str(tmp_path / "docs"))
    plan = simhash.distinct_documents(spark.read.parquet(str(tmp_path / "docs")))._jdf.queryExecution().sparkPlan().toString()
    first = plan[:plan.index("LeftAnti")]
    assert "NOT coalesce" in first and "Exchange hash" not in first and "SortMergeJoin" not in first.split("LeftAnti")[0].split("Union")[0]
