"""Skewed joins, block pairs and components."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import common
from sievework.session import cut_lineage


@pytest.mark.parametrize("hot", [0, 1500])
def test_attach_keeps_every_row(spark, hot):
    rows = [("h", i) for i in range(hot)] + [(f"k{i % 40}", i) for i in range(200)] + [(None, -1), ("unknown", -2)]
    big = spark.createDataFrame(rows, "key STRING, i BIGINT")
    counts = {}
    for k, _ in rows:
        counts[k] = counts.get(k, 0) + 1
    small = cut_lineage(spark.createDataFrame([(k, f"v{k}", n) for k, n in counts.items() if k and k != "unknown"],
                                              "key STRING, value STRING, n BIGINT"))
    got = common.attach(big, small, "key", "n", F.col("i").cast("string")).collect()
    assert sorted((str(r.key), r.i, r.value) for r in got if r.value) == sorted((k, i, f"v{k}") for k, i in rows if k in counts and k not in (None, "unknown"))
    assert sorted(r.i for r in got if not r.value) == [-2, -1]


def test_block_pairs_let_all_rows_meet(spark):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(5)] + [("c", 1)], "k STRING, item BIGINT")
    units = {}
    for r in common.block_pairs(rows, ["k"], "item", 10).collect():
        units.setdefault((r.k, r._i, r._j), []).append((r._b, r.item))
    pairs = []
    for (k, i, j), members in units.items():
        pairs += [(k, a[1], b[1]) for a in members for b in members if a[1] < b[1] and {a[0], b[0]} == {i, j}]
    assert sorted(pairs) == sorted((k, a, b) for k, n in (("a", 50), ("b", 5)) for a in range(n) for b in range(a + 1, n))
    assert max(map(len, units.values())) < 50
    assert {r.k for r in common.block_pairs(rows, ["k"], "item", 10, least=2).collect()} == {"a", "b"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, pairs):
    edges = spark.createDataFrame(pairs or [(0, 0)], "a BIGINT, b BIGINT")
    label = common.forest(26, np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int))
    want = {i: int(label[i]) for p in pairs for i in p if p[0] != p[1]}
    assert {r.node: r.component for r in common.components(edges).collect()} == want


def test_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star, "a BIGINT, b BIGINT")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1300), 1000)}


def test_text_groups():
    texts = ["aaa", "", "bb", "c" * 50, "d"]
    assert [texts[a:b] for a, b in common.text_groups(texts, 6)] == [["aaa", "", "bb"], ["c" * 50], ["d"]]
    assert list(common.text_groups([], 6)) == []
