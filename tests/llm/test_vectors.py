"""Cross-polytope near-duplicates and pruned-graph search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import cross_polytope, pruned_graph, queries

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def clustered(seed=3, n=40, d=16):
    """Random directions, a tight ball, exact copies and a scaled copy; ids in no order."""
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(n, d)))
    centre = rng.normal(size=d)
    rows += [centre + rng.normal(size=d) * 0.05 for _ in range(60)]
    rows += [rows[3]] * 30 + [rows[5] * 2]
    ids = rng.permutation(len(rows) * 3)[:len(rows)].tolist()
    return {i: np.asarray(r, np.float32).astype(float) for i, r in zip(ids, rows, strict=True)}


def plain_links(vectors, threshold=0.95):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    label = np.arange(len(ids))
    for _ in ids:
        label = np.array([label[near[i]].min() for i in range(len(ids))])
    return {i: (int(near[n].sum()) - 1, ids[label[n]]) for n, i in enumerate(ids)}


def as_rows(vectors):
    return [(i, [float(x) for x in v], 0) for i, v in vectors.items()]


@pytest.mark.parametrize("unit", [8, 1024])
def test_near_duplicates(spark, monkeypatch, unit):
    monkeypatch.setattr(cross_polytope, "UNIT_ROWS", unit)
    vectors = clustered()
    rows = cross_polytope.near_duplicate_vectors(spark.createDataFrame(as_rows(vectors), VECTORS)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == plain_links(vectors)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_near_duplicates_odd_rows(spark):
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [NAN, 1.0], 0), (5, [INF, 1.0], 0), (6, [None, 1.0], 0),
            (7, [1.0, 0.0], 0), (8, [1.0, -0.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [2.0, 0.1], 0), (11, [1.0], 0), (None, [1.0, 0.0], 0)]
    got = cross_polytope.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id} == {
        **{i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 11)}, 7: (3, 7, True), 8: (3, 7, False), 10: (3, 7, False)}
    assert [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(3, 7)]
    assert cross_polytope.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_at_the_threshold():
    """Pairs right at cosine 0.95 still share a bucket."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * b
    t, h, p = cross_polytope.TABLES, cross_polytope.HASHES, cross_polytope.PROBES
    ka, kb = cross_polytope.probe_keys(a, t, h, p), cross_polytope.probe_keys(b, t, h, p)
    met = (ka[:, :, :, None] == kb[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() >= 0.995


def test_near_duplicates_match_sql(spark, tmp_path):
    from compare import connect, duck_rows, spark_rows
    spark.createDataFrame(as_rows(clustered(seed=4)), VECTORS).coalesce(1).write.parquet(str(tmp_path / "spark"))
    file = next((tmp_path / "spark").glob("part-*.parquet"))
    file.rename(tmp_path / "embeddings.parquet")
    want, _ = duck_rows(connect(str(tmp_path)), queries.OP5_SQL)
    assert spark_rows(queries.op5_cross_polytope(spark, str(tmp_path))) == want


def test_hadamard_is_orthogonal():
    m = cross_polytope.hadamard(np.eye(8))
    assert np.allclose(m @ m.T, np.eye(8))


def plain_nearest(vectors, query, k):
    score = {i: float(np.dot(vectors[query], v)) for i, v in vectors.items() if i != query}
    return sorted(score, key=lambda i: (-score[i], i))[:k], score


def test_search_query_recall(spark, sf_dir):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    rows = queries.op9_pruned_graph(spark, sf_dir).collect()
    asked = [i for i in vectors if i % 20 == 0]
    assert len(rows) == 20 * len(asked)
    hits = 0
    for q in asked:
        best, score = plain_nearest(vectors, q, 20)
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & set(best))
    assert hits >= 0.95 * 20 * len(asked)


def lengths(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    if kind == "log-normal":
        x *= np.exp(rng.normal(size=(n, 1)))
    if kind == "one long":
        x[5] *= 2000
    return x.astype(np.float32)


@pytest.mark.parametrize("kind,n", [("normal", 2000), ("log-normal", 2000), ("one long", 2000), ("normal", 8192), ("log-normal", 8192)])
def test_recall_whatever_the_lengths(spark, kind, n):
    x = lengths(kind, n)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    rows = pruned_graph.nearest(table, F.col("id") % 40 == 0).collect()
    asked = np.arange(0, n, 40)
    score = x[asked].astype(float) @ x.T.astype(float)
    score[np.arange(len(asked)), asked] = -np.inf
    want = {(int(q), int(i)) for q, s in zip(asked, score, strict=True) for i in np.argsort(-s)[:20]}
    got = {(r.query_id, r.vec_id) for r in rows}
    assert len(rows) == len(want) and len(got & want) >= 0.97 * len(want)


def test_search_in_tight_balls():
    """Points a hundred-thousandth apart far from the origin keep their own neighbours."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 32))[rng.integers(0, 20, 1500)] + 1e-5 * rng.normal(size=(1500, 32))
    u = pruned_graph.directions(x)
    order = pruned_graph.spread_first(u)
    assert sorted(order) == list(range(1500))
    graph = pruned_graph.build_graph(u[order])
    found = pruned_graph.walk_shard(x[order], graph, x[:100], 20, pruned_graph.BEAM)
    hits = sum(len(set(np.argsort(-(x[order] @ q))[:20]) & set(sorted(f[f >= 0], key=lambda i: -(x[order][i] @ q))[:20]))
               for q, f in zip(x[:100], found, strict=True))
    assert hits >= 0.95 * 2000


def test_rarer_dimensions_are_searched_and_linked(spark):
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=3 if i < 30 else 5 if i < 40 else 2) for i in range(44)}
    vectors[33], vectors[41] = vectors[30] * 2, vectors[40] * 3
    table = spark.createDataFrame(as_rows(vectors), "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")
    got = pruned_graph.nearest(table, F.col("id") % 10 == 0, k=4).collect()
    for q in range(0, 44, 10):
        same = {i: v for i, v in vectors.items() if len(v) == len(vectors[q])}
        best, score = plain_nearest(same, q, 4)
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in own] == best and all(abs(r.score - score[r.vec_id]) < 1e-12 for r in own)
    want = {}
    for d in (2, 3, 5):
        want |= plain_links({i: v for i, v in vectors.items() if len(v) == d})
    links = cross_polytope.near_duplicate_vectors(table).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in links} == want
    assert want[33][0] >= 1 and want[41][0] >= 1


def test_search_ties_copies_and_shards(spark):
    vectors = clustered(seed=9)
    table = spark.createDataFrame(as_rows(vectors), VECTORS)
    rows = pruned_graph.nearest(table, F.col("id") % 2 == 0, k=7, shard_rows=40).collect()
    for q in (i for i in vectors if i % 2 == 0):
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        exact, score = plain_nearest(vectors, q, 7)
        assert [round(r.score, 9) for r in own] == [round(score[i], 9) for i in exact]


def test_search_odd_rows(spark):
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (20, [NAN, 1.0], 0), (40, [1.0, 0.0], 0), (41, [1.0, 0.0], 0), (42, [0.5, 0.5], 0),
            (60, [0.0, 3.0], 0), (43, [1.0], 0), (None, [1.0, 1.0], 0), (40, [1.0, 0.0], 0)]
    got = pruned_graph.nearest(spark.createDataFrame(rows, VECTORS), F.col("id") % 20 == 0, k=20).collect()
    assert sorted({(r.query_id, r["rank"], r.vec_id, r.score) for r in got}) == [
        (40, 1, 41, 1.0), (40, 2, 42, 0.5), (40, 3, 60, 0.0), (60, 1, 42, 1.5), (60, 2, 40, 0.0), (60, 3, 40, 0.0), (60, 4, 41, 0.0)]
    assert pruned_graph.nearest(spark.createDataFrame([], VECTORS), F.col("id") % 20 == 0).count() == 0
