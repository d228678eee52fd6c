"""Nearest neighbours by largest inner product, over robust-pruned directed graphs.

Distinct vectors are dealt to bands by dimension and length, a band's longest vector being BAND times its shortest, and
the vectors of a band to shards of about `shard_rows` (a third of the table within bounds). A shard's graph joins directions: vectors are scaled to length one
and inserted in batches; a greedy search over the graph so far proposes neighbours, and relaxed pruning keeps a
neighbour only if no kept one is closer to it by the factor `alpha`. Back edges are added and pruned the same way. Inside a
band the lengths are alike, so that walks over directions lead to the largest products, whatever the lengths in the table.

A query walks every shard of its dimension with a beam from several entries, the shard's middle and the points farthest from
each other. Its beam is doubled until the k best found no longer change, and a shard that is small against the beam is
scored whole. What was found is scored in double precision on the original vectors, and the nearest over all shards are
ranked. Queries and shards meet in blocks, so no task holds all queries.

A copy of a vector is no point of its own: a point lists its `k` + 1 smallest ids, and no query can need another. Equal
scores are ranked by the smaller id; which of many points with the same score near the last rank are found depends on the walk.

Vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do rows without an id. Vectors of
different dimensions do not meet. Repeated ids are separate candidates; a query leaves out every row with its own id, and is
asked once for each distinct vector of its id. Extra columns are not read. Fewer than `k` candidates give fewer rows, an
empty table none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import bounded_batches
from sievework.llm.cross_polytope import _matrix, valid_vector, vector_key
from sievework.session import cut_lineage

DEGREE, ALPHA, BUILD_BEAM, BEAM = 32, 1.2, 96, 64
BAND = 1.25
ENTRIES = 8
# A shard holds a third of the vectors, but not fewer and not more than this: fewer shards are fewer walks.
SHARD_ROWS, MOST_ROWS = 8192, 65536
QUERY_BLOCK = 2048
AHEAD = 4


def spread_first(u: np.ndarray, count: int = ENTRIES) -> np.ndarray:
    """An order of unit vectors that starts with the one nearest to the mean and then, again and again, the one farthest
    from those before; the rest keep their order."""
    order = [int((u @ u.mean(axis=0)).argmax())]
    far = np.square(u - u[order[0]]).sum(axis=1)
    while len(order) < min(count, len(u)) and far.max() > 0:
        order.append(int(far.argmax()))
        far = np.minimum(far, np.square(u - u[order[-1]]).sum(axis=1))
    return np.concatenate([order, np.setdiff1d(np.arange(len(u)), order)]).astype(np.int64)


def beam_search(points: np.ndarray, graph: np.ndarray, queries: np.ndarray, beam: int, settle: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The points with the largest products found for each query, best first, and their products; -1 where there are fewer.

    `graph` lists the neighbours of each point, -1 where there are fewer. The first ENTRIES points are the entries. The best
    `beam` points found are opened. With `settle`, as many again are kept, and a walk that has come to its end goes on with
    twice the beam, until the best `settle` products no longer change.
    """
    n, q = len(points), len(queries)
    width = 2 * beam if settle else beam
    out = np.full((q, width), -1, np.int64), np.full((q, width), -np.inf, np.float32)
    entries = min(ENTRIES, n, beam)
    rows, last = np.arange(q), None
    ids, score = np.full((q, width), -1, np.int64), np.full((q, width), -np.inf, np.float32)
    ids[:, :entries], score[:, :entries] = np.arange(entries), queries @ points[:entries].T
    opened, seen = np.zeros((q, width), bool), np.zeros((q, n + 1), bool)
    seen[:, :entries] = seen[:, n] = True
    while len(rows):
        _walk(points, graph, queries[rows], beam, ids, score, opened, seen)
        order = np.argsort(-score, axis=1, kind="stable")
        best = np.take_along_axis(score, order[:, :settle], axis=1)
        done = np.full(len(rows), True) if not settle or 2 * beam >= n else (best == last).all(axis=1) if last is not None else np.full(len(rows), False)
        for whole, own in zip(out, (ids, score), strict=True):
            whole[rows[done]] = np.take_along_axis(own[done], order[done], axis=1)[:, :width]
        rows, last, beam = rows[~done], best[~done], 2 * beam
        grow = ((0, 0), (0, 2 * beam - ids.shape[1]))
        ids, score = np.pad(ids[~done], grow, constant_values=-1), np.pad(score[~done], grow, constant_values=-np.inf)
        opened, seen = np.pad(opened[~done], grow), seen[~done]
    return out


def _walk(points, graph, queries, beam, ids, score, opened, seen) -> None:
    """Open the best `beam` points of each list (changed in place) until all of them are opened. The first `beam` places of a
    list hold its best."""
    n = len(points)
    best = np.argpartition(-score, beam - 1, axis=1)
    for own in (ids, score, opened):
        own[:] = np.take_along_axis(own, best, axis=1)
    rows = np.arange(len(queries))
    while True:
        waiting = np.where(opened[rows, :beam] | (ids[rows, :beam] < 0), -np.inf, score[rows, :beam])
        pick = np.argpartition(-waiting, min(AHEAD, beam) - 1, axis=1)[:, :AHEAD]
        live = np.take_along_axis(waiting, pick, axis=1) > -np.inf
        some = live.any(axis=1)
        rows, pick, live = rows[some], pick[some], live[some]
        if not len(rows):
            return
        opened[rows[:, None], pick] |= live
        near = np.where(live[:, :, None], graph[ids[rows[:, None], pick]], -1).reshape(len(rows), -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        fresh = ~seen[rows[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[rows[:, None], near] = True
        width = int(fresh.sum(axis=1).max())
        if not width:
            continue
        first = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        near, fresh = np.take_along_axis(near, first, axis=1), np.take_along_axis(fresh, first, axis=1)
        value = np.matmul(points[np.minimum(near, n - 1)], queries[rows][:, :, None])[:, :, 0]
        value[~fresh] = -np.inf
        all_score = np.concatenate([score[rows], value], axis=1)
        all_ids = np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1)
        all_open = np.concatenate([opened[rows], np.zeros(near.shape, bool)], axis=1)
        best = np.argpartition(-all_score, (beam - 1, score.shape[1] - 1), axis=1)[:, :score.shape[1]]
        ids[rows] = np.take_along_axis(all_ids, best, axis=1)
        score[rows] = np.take_along_axis(all_score, best, axis=1)
        opened[rows] = np.take_along_axis(all_open, best, axis=1)


def robust_prune(points: np.ndarray, of: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbour lists of points `of`, chosen from candidates `near` (-1 for none).

    Distances are squared lengths of differences from the own point in double precision, so points that lie close together
    far from the origin keep theirs.
    """
    near = np.sort(near, axis=1)
    bad = (near < 0) | (near == of[:, None])
    bad[:, 1:] |= near[:, 1:] == near[:, :-1]
    offset = points[np.maximum(near, 0)].astype(np.float64) - points[of][:, None]
    square = np.square(offset).sum(axis=2)
    product = np.matmul(offset, offset.transpose(0, 2, 1))
    far = np.where(bad, np.inf, square)
    out = np.full((len(of), degree), -1, np.int64)
    rows = np.arange(len(of))
    left = far.copy()
    for k in range(degree):
        best = left.argmin(axis=1)
        some = left[rows, best] < np.inf
        if not some.any():
            break
        out[some, k] = near[rows[some], best[some]]
        between = np.maximum(square + square[rows, best][:, None] - 2 * product[rows, best], 0)
        left[(alpha * alpha * between <= far) & some[:, None]] = np.inf
        left[rows, best] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> np.ndarray:
    """Neighbour lists of unit vectors, inserted in their order."""
    n = len(points)
    graph = np.full((n, degree), -1, np.int64)
    single = points.astype(np.float32)
    at = 1
    while at < n:
        end = min(n, at + min(max(at, 1), 512))
        new = np.arange(at, end)
        found, _ = beam_search(single[:at], graph[:at], single[new], min(beam, at))
        found = np.concatenate([found, np.tile(new, (len(new), 1))], axis=1) if at < degree else found
        for start in range(0, len(new), 256):
            part = slice(start, start + 256)
            graph[new[part]] = robust_prune(points, new[part], found[part], degree, alpha)
        _add_back_edges(points, graph, new, degree, alpha)
        at = end
    return graph


def _add_back_edges(points, graph, new, degree, alpha) -> None:
    to, source = graph[new].ravel(), np.repeat(new, degree)
    source, to = source[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    source, to = source[order], to[order]
    targets, start, count = np.unique(to, return_index=True, return_counts=True)
    held = (graph[targets] >= 0).sum(axis=1)
    by_width = np.argsort(count, kind="stable")
    for part in np.array_split(by_width, max(1, len(by_width) // 256)):
        if not len(part):
            continue
        width = count[part].max()
        place = start[part][:, None] + np.arange(width)
        incoming = np.where(np.arange(width) < count[part][:, None], source[np.minimum(place, len(source) - 1)], -1)
        room = held[part] + count[part] <= degree
        both = np.concatenate([graph[targets[part]], incoming], axis=1)
        first = np.argsort(both[room] < 0, axis=1, kind="stable")[:, :degree]
        graph[targets[part][room]] = np.take_along_axis(both[room], first, axis=1)
        if not room.all():
            graph[targets[part][~room]] = robust_prune(points, targets[part][~room], both[~room], degree, alpha)


def directions(x: np.ndarray) -> np.ndarray:
    """The vectors scaled to length one, whatever their size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def walk_shard(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, k: int, beam: int) -> np.ndarray:
    """Points found for each query, -1 where there are fewer: the best of the whole shard where it is small against the beam,
    else the best of a walk whose beam grows until the k best products stay the same."""
    keep = max(2 * beam, 4 * k)
    if len(x) > 4 * beam:
        single = (x / np.abs(x).max()).astype(np.float32)
        turned = (queries / np.abs(queries).max(axis=1, keepdims=True)).astype(np.float32)
        return beam_search(single, graph, turned, max(beam, k), settle=k)[0]
    out = np.full((len(queries), keep), -1, np.int64)
    for start in range(0, len(queries), 64):
        part = slice(start, start + 64)
        score = queries[part] @ x.T
        best = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if len(x) > keep else np.tile(np.arange(len(x)), (len(score), 1))
        out[part, :best.shape[1]] = best
    return out


def search_shard(x, ids, graph, query_ids, queries, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, score) of the best k ids for each query; ids[i] lists the rows of point i, ascending."""
    sizes = np.array([len(i) for i in ids])
    out = []
    for start in range(0, len(queries), 256):
        part = slice(start, start + 256)
        found = walk_shard(x, graph, queries[part], k, beam)
        row, place = np.nonzero(found >= 0)
        point = found[row, place]
        score = products(queries[part][row], x[point])
        size = sizes[point]
        row, score = np.repeat(row, size), np.repeat(score, size)
        vec_id = np.concatenate([ids[p] for p in point])
        other = query_ids[part][row] != vec_id
        row, score, vec_id = row[other], score[other], vec_id[other]
        order = np.lexsort((vec_id, -score, row))
        row, score, vec_id = row[order], score[order], vec_id[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < k
        out.append((start + row[best], vec_id[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def build_index(points: DataFrame, degree: int = DEGREE, alpha: float = ALPHA) -> DataFrame:
    """A row per shard of points (d, band, shard, vkey, v, ids): vectors, neighbour lists and ids as binary and arrays."""
    def build(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("vkey").to_numpy(zero_copy_only=False)))).combine_chunks()
        x = _matrix(rows.column("v"))
        u = directions(x)
        order = spread_first(u)
        graph = build_graph(u[order], degree, alpha).astype(np.int32)
        ids = rows.column("ids").to_pylist()
        return pa.table({**{c: rows.column(c).slice(0, 1) for c in ("d", "band", "shard")}, "x": pa.array([x[order].tobytes()], pa.binary()),
                         "graph": pa.array([graph.tobytes()], pa.binary()),
                         "ids": pa.array([[ids[i] for i in order]], pa.list_(pa.list_(pa.int64()))),
                         "n": pa.array([len(x)], pa.int64())})

    return points.groupBy("d", "band", "shard").applyInArrow(
        build, "d INT, band INT, shard INT, x BINARY, graph BINARY, ids ARRAY<ARRAY<BIGINT>>, n BIGINT")


def length_band(column: str, ratio: float = BAND) -> Column:
    """The number of the band of a vector's length; half a band is added so that vectors of length one lie inside theirs."""
    def number(longest: Column) -> Column:
        square = F.aggregate(column, F.lit(0.0), lambda s, x: s + (x / longest) * (x / longest))
        return F.floor((F.log(longest) + F.log(square) / 2) / float(np.log(ratio)) + 0.5).cast("int")

    # an array of one binds the largest component, which would else be sought for every component again
    return F.get(F.transform(F.array(F.array_max(F.transform(column, F.abs))), number), F.lit(0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int | None = None, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row where `is_query` holds (over `id`)."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & valid_vector("v"))
    keyed = rows.withColumn("vkey", vector_key("v"))
    # the group limit of Spark cuts the copies of a vector to k + 1 before they are shuffled
    place = F.row_number().over(Window.partitionBy("vkey").orderBy("id"))
    few = keyed.withColumn("_rn", place).filter(F.col("_rn") <= k + 1)
    points = few.groupBy("vkey").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    points = cut_lineage(points.select("*", F.size("v").alias("d"), length_band("v").alias("band")))
    shard_rows = shard_rows or min(MOST_ROWS, max(SHARD_ROWS, -(-points.count() // 3)))
    sizes = cut_lineage(points.groupBy("d", "band").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")))
    dealt = points.join(sizes, ["d", "band"]).withColumn("shard", F.pmod(F.xxhash64("vkey"), "shards").cast("int"))
    index = cut_lineage(build_index(dealt, degree, alpha))
    queries = rows.filter(is_query).withColumn("asked", F.xxhash64("v")).dropDuplicates(["id", "asked"])
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def walk(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("asked", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        n = right.column("n")[0].as_py()
        x = np.frombuffer(right.column("x")[0].as_py(), np.float64).reshape(n, -1)
        graph = np.frombuffer(right.column("graph")[0].as_py(), np.int32).reshape(n, -1)
        ids = [np.array(i, np.int64) for i in right.column("ids")[0].as_py()]
        own = left.column("id").to_numpy()
        query, vec_id, score = search_shard(x, ids, graph, own, _matrix(left.column("v")), k, beam)
        return pa.table([pa.array(own[query]), pa.array(left.column("asked").to_numpy()[query]), pa.array(vec_id), pa.array(score)],
                        schema=schema)

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    # bands and dimensions are few, so a list of shards fits beside each query
    listed = sizes.groupBy("d").agg(F.collect_list(F.struct("band", "shards")).alias("bands"))
    asked = queries.withColumn("d", F.size("v")).join(listed, "d").select("id", "v", "asked", "d", block, F.explode("bands").alias("_b"))
    asked = asked.select("id", "v", "asked", "d", "block", "_b.band", F.explode(F.sequence(F.lit(0), F.col("_b.shards") - 1)).alias("shard"))
    graphs = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    unit = ["d", "band", "shard", "block"]
    found = asked.groupBy(*unit).cogroup(graphs.groupBy(*unit)).applyInArrow(
        walk, "query_id BIGINT, asked BIGINT, vec_id BIGINT, score DOUBLE")
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
