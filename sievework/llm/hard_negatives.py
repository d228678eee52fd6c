"""Hard negatives for anchors by Fagin's threshold algorithm.

Every component becomes the integer floor(256 * x), and a row's score for an anchor is their integer inner product. The
candidates are dealt to shards; a shard holds one list per dimension, sorted by that component. An anchor reads the lists
of its non-zero components, from the large end where its component is positive and from the small end where it is
negative. Every row met is scored at once over all its components (random access). The threshold, the score that a row
with the last values read from every list would have, bounds all rows not met yet: reading ends once it is strictly below
the k-th score of every window, or below the window's lower bound where that has fewer than k rows.

First the `positives` best other rows of an anchor's own label are found (one window without bounds), then, for each of
them, the `negatives` best rows of other labels whose score lies in the window `low` to `high` percent of the positive's.
The best of all shards are ranked by score, then by the smaller id. Windows of negative positives are empty.

Rows that agree in integers, label and id count once. Of those that agree in integers and label, only the rows with the
smallest ids can be among the first and only they enter a shard: one more than the larger of `positives` and `negatives`.

Rows without an id, label or vector, or with a null or non-finite component take no part. Rows meet rows of their own
dimension only. Repeated ids with different vectors or labels are rows of their own, and no row is the positive or
negative of an anchor with its own id. Zero vectors and empty ones take part with score 0. Numbers too large for a score
in 64 bits stop the job with an error. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import bounded_batches
from sievework.session import cut_lineage

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SHARD_ROWS = 8192
ANCHOR_BLOCK = 1024
FIRST_DEPTH = 16
LIMIT = 2.0 ** 62


class SortedLists:
    """The integer vectors of a shard with their list per dimension, from the smallest component to the largest."""

    def __init__(self, x: np.ndarray, lists: np.ndarray | None = None):
        self.x = x
        self.lists = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32)) if lists is None else lists

    def best(self, anchor: np.ndarray, eligible: np.ndarray, windows: Sequence[tuple[float, float]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows met, their scores, depth read). The rows contain, for each window, the k best eligible rows with a score
        inside its bounds (all, if fewer), and every row that ties with the last of them."""
        n = len(self.x)
        rising, falling = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(rising) and not len(falling):
            new = np.flatnonzero(eligible)
            return new, np.zeros(len(new), np.int64), n
        met = np.zeros(n, bool)
        rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held = [np.zeros(0, np.int64) for _ in windows]  # the best k scores of each window so far
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            end = min(n, depth + step)
            seen = np.zeros(n, bool)
            seen[self.lists[rising, n - end:n - depth].ravel()] = True
            seen[self.lists[falling, depth:end].ravel()] = True
            new = np.flatnonzero(seen & ~met & eligible)
            met |= seen
            score = self.x[new] @ anchor
            rows.append(new)
            scores.append(score)
            last = np.concatenate([self.x[self.lists[rising, n - end], rising], self.x[self.lists[falling, end - 1], falling]])
            threshold = int(last @ np.concatenate([anchor[rising], anchor[falling]]))
            done = True
            for w, (low, high) in enumerate(windows):
                held[w] = np.sort(np.concatenate([held[w], score[(score >= low) & (score <= high)]]))[::-1][:k]
                done &= threshold < (held[w][-1] if len(held[w]) == k else low)
            depth, step = end, step * 2
            if done or met.all():
                break
        return np.concatenate(rows), np.concatenate(scores), depth


def bounds(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and largest integer score n with low * positive <= 100 * n <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def integer_rows(vectors: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, label, v, same): the rows that take part, once each; `same` names equal integers and dimension."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("d"), label.alias("label"))
    fine = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select("id", "label", F.transform("d", lambda x: F.floor(x * 256)).alias("v"))
    # 128 bits of hash name a vector
    same = F.concat_ws("-", F.size("v"), F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit("second"), "v")))
    return rows.withColumn("same", same)


def shard_table(rows: DataFrame, keep: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(d, shards) for each dimension, and a row per shard of (id, label, v, same): d, shard, n, top (largest absolute
    component), labels, and as binary x (integers), lists and ids."""
    once = rows.groupBy("same", "label", "id").agg(F.first("v").alias("v"))
    # the group limit of Spark cuts each group before it is shuffled
    place = F.row_number().over(Window.partitionBy("same", "label").orderBy("id"))
    few = cut_lineage(once.withColumn("_rn", place).filter(F.col("_rn") <= keep).select("id", "label", "v", F.size("v").alias("d")))
    sizes = cut_lineage(few.groupBy("d").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")))
    dealt = few.join(sizes, "d").withColumn("shard", F.pmod(F.xxhash64("id", "label"), "shards").cast("int"))

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by([("id", "ascending"), ("label", "ascending")]).combine_chunks()
        x = _integers(part.column("v"))
        one = part.slice(0, 1).select(["d", "shard"])
        for name, value in (("n", len(x)), ("top", float(np.abs(x).max(initial=0)))):
            one = one.append_column(name, pa.array([value]))
        for name, value in (("x", x), ("lists", SortedLists(x).lists), ("ids", part.column("id").to_numpy())):
            one = one.append_column(name, pa.array([np.ascontiguousarray(value).tobytes()], pa.binary()))
        return one.append_column("labels", pa.array([part.column("label").to_pylist()], pa.list_(part.schema.field("label").type)))

    kind = dict(rows.dtypes)["label"]
    return sizes, dealt.groupBy("d", "shard").applyInArrow(
        build, f"d INT, shard INT, n BIGINT, top DOUBLE, x BINARY, lists BINARY, ids BINARY, labels ARRAY<{kind}>")


def _integers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def meet(asked: DataFrame, shards: DataFrame, blocks: int, search, schema: str) -> DataFrame:
    """Every row of `asked` (with d and shards) meets every shard of its dimension; `search` gets the shard's lists, ids,
    labels and the rows of one block."""
    def walk(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in shape})
        row = right.slice(0, 1).to_pylist()[0]
        x = np.frombuffer(row["x"], np.int64).reshape(row["n"], -1)
        lists = SortedLists(x, np.frombuffer(row["lists"], np.int32).reshape(-1, row["n"]))
        found = search(lists, np.frombuffer(row["ids"], np.int64), np.array(row["labels"]), left)
        return pa.table([pa.array(c, f.type) for c, f in zip(found, shape, strict=True)], schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    shape = to_arrow_schema(StructType.fromDDL(schema))
    block = F.pmod(F.xxhash64("id", "same"), F.lit(blocks)).cast("int").alias("block")
    left = asked.select("*", block, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    right = shards.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    key = ["d", "shard", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(walk, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   id_col: str = "vec_id", vector_col: str = "embedding", low: int = LOW, high: int = HIGH,
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `is_anchor` holds
    (over `id`). `label` is an expression over the columns of `vectors`."""
    bounded_batches(vectors.sparkSession)
    rows = integer_rows(vectors, label, id_col, vector_col)
    kind = dict(rows.dtypes)["label"]
    sizes, shards = shard_table(rows, max(positives, negatives) + 1, shard_rows)
    shards = cut_lineage(shards)
    top = shards.agg(F.max(F.col("top") * F.col("top") * F.col("d"))).first()[0] or 0
    if top > LIMIT:
        raise ValueError("the components are too large for scores in 64 bits")
    anchors = rows.filter(is_anchor).groupBy("same", "label", "id").agg(F.first("v").alias("v"))
    anchors = cut_lineage(anchors.withColumn("d", F.size("v")).join(sizes, "d"))
    blocks = max(1, -(-anchors.count() // ANCHOR_BLOCK))

    def find_positives(lists, ids, labels, left):
        out = [[], [], [], [], []]
        v = _integers(left.column("v"))
        for i, (own, same, name) in enumerate(zip(*(left.column(c).to_pylist() for c in ("id", "same", "label")), strict=True)):
            met, score, _ = lists.best(v[i], (labels == name) & (ids != own), [(-np.inf, np.inf)], positives)
            order = np.lexsort((ids[met], -score))[:positives]
            for column, values in zip(out, ([own] * len(order), [same] * len(order), [name] * len(order), ids[met[order]], score[order]), strict=True):
                column.extend(values)
        return out

    def find_negatives(lists, ids, labels, left):
        out = [[], [], [], [], [], [], []]
        v = _integers(left.column("v"))
        for i, (own, same, name, found) in enumerate(zip(*(left.column(c).to_pylist() for c in ("id", "same", "label", "positives")), strict=True)):
            windows = [bounds(p["score"], low, high) for p in found]
            open_windows = [w for w in windows if w[0] <= w[1]]
            if not open_windows:
                continue
            met, score, _ = lists.best(v[i], (labels != name) & (ids != own), open_windows, negatives)
            order = np.lexsort((ids[met], -score))
            met, score = met[order], score[order]
            for p, (least, most) in zip(found, windows, strict=True):
                inside = np.flatnonzero((score >= least) & (score <= most))[:negatives]
                one = [own, same, name, p["place"], p["id"], p["score"]]
                for column, value in zip(out, one, strict=False):
                    column.extend([value] * len(inside))
                out[-1].extend(zip(ids[met[inside]].tolist(), score[inside].tolist(), strict=True))
        return [*out[:6], [a for a, _ in out[6]], [s for _, s in out[6]]]

    anchor = ["id", "same", "label"]
    near = meet(anchors, shards, blocks, find_positives, f"id BIGINT, same STRING, label {kind}, positive_id BIGINT, score BIGINT")
    place = F.row_number().over(Window.partitionBy(*anchor).orderBy(F.desc("score"), "positive_id"))
    near = near.withColumn("place", place).filter(F.col("place") <= positives)
    listed = near.groupBy(*anchor).agg(F.sort_array(F.collect_list(F.struct("place", F.col("positive_id").alias("id"), "score"))).alias("positives"))
    asked = cut_lineage(anchors.join(listed, anchor))
    found = meet(asked, shards, blocks, find_negatives,
                 f"id BIGINT, same STRING, label {kind}, place INT, positive_id BIGINT, positive_score BIGINT, negative_id BIGINT, negative_score BIGINT")
    rank = F.row_number().over(Window.partitionBy(*anchor, "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= negatives).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
