"""Hard negatives by the threshold algorithm against SQL and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import hard_negatives as hn

VECTORS = "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, id STRING, v INT"
NAN, INF = float("nan"), float("inf")


def plain(rows, anchor, positives=5, negatives=10):
    """All results by plain loops over distinct rows (id, integers, label)."""
    known = sorted({(i, tuple(math.floor(256 * x) for x in v), c) for i, v, c in rows
                    if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, v, c in known:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, d) for j, w, d in known if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == c][:positives]:
            kept = [(n, k) for n, k, d in scored if d != c and -30 * p <= -100 * n <= -90 * p][:negatives]
            out += [(i, j, rank + 1, k, -p, -n) for rank, (n, k) in enumerate(kept)]
    return sorted(out)


def spark_result(spark, rows, every, **options):
    table = spark.createDataFrame([(i, v, c, "x", 0) for i, v, c in rows], VECTORS)
    found = hn.hard_negatives(table, F.col("id") % every == 0, F.col("label"), **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("seed,shard_rows", [(0, 8192), (1, 50), (2, 7)])
def test_random(spark, seed, shard_rows):
    rng = np.random.default_rng(seed)
    rows = [(int(i), v.tolist(), int(c)) for i, v, c in zip(rng.permutation(900)[:300], rng.normal(0.2, 1, (300, 6)), rng.integers(0, 4, 300))]
    assert spark_result(spark, rows, 10, shard_rows=shard_rows) == plain(rows, lambda i: i % 10 == 0)


def test_ties_copies_and_small_numbers(spark):
    """Few different vectors: most scores tie and ids decide; a third of the rows are one vector."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-1, 2, 3) / 256).tolist() if i % 3 else [0.5, 0.25, -0.5], int(i % 2)) for i in range(240)]
    assert spark_result(spark, rows, 12, shard_rows=30) == plain(rows, lambda i: i % 12 == 0)


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.random(4).tolist(), i % 3) for i in range(60)]
    rows += [(100, None, 1), (110, [0.1, None, 0.2, 0.3], 1), (120, [NAN, 0.0, 0.0, 0.0], 1), (130, [INF, 0.0, 0.0, 0.0], 1),
             (140, [0.1] * 4, None), (None, [0.2] * 4, 1), (150, [0.0] * 4, 1), (160, [-0.5] * 4, 2), (170, [], 1), (180, [], 2), (190, [], 1),
             (200, [0.3, 0.4], 0), (210, [0.3, 0.5], 0), (211, [0.1, 0.2], 1), (20, [0.9] * 4, 1), (20, [0.9] * 4, 1), *rows[:9]]
    got = spark_result(spark, rows, 10, shard_rows=16)
    assert got == plain(rows, lambda i: i % 10 == 0)
    assert {150, 170, 190} <= {r[0] for r in got}
    assert spark_result(spark, [], 10) == []


def test_too_large(spark):
    with pytest.raises(ValueError, match="64 bits"):
        spark_result(spark, [(0, [1e12, 1.0], 1), (1, [1e12, 1.0], 1)], 10)


def test_stops_early_and_finds_all():
    """On lists with a clear head the threshold ends the reading, and nothing in the windows is lost."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.exponential(1, (4000, 3)) ** 3).astype(np.int64)
    lists, anchor, eligible = hn.SortedLists(x), np.array([300, -20, 100]), rng.random(4000) < 0.7
    score = x @ anchor
    top = np.sort(score[eligible])[::-1]
    windows = [(-np.inf, np.inf), (int(top[0]) // 2, int(top[0]) * 9 // 10)]
    met, found, depth = lists.best(anchor, eligible, windows, 5)
    assert depth < 2000 and np.array_equal(found, score[met]) and eligible[met].all()
    for low, high in windows:
        want = [s for s in top if low <= s <= high][:5]
        assert sorted((s for s in found if low <= s <= high), reverse=True)[:5] == want
